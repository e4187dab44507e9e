"""One table, assessed once.

The passes and what they cost:

1. scan        every column once; with distinct counts one shuffle of distinct
               (column, value) pairs, long text as digests, else none
2. quartiles   numeric columns only; ranked in parts (see operators.quantiles)
3. limits      only columns whose extremes pass a fence or a length limit
4. row copies  one shuffle of row keys: numbers as they are, text as a digest

A pass runs when a result first needs it and is kept as one row of scalars per
column, so nothing that grows with the data reaches the driver. Everything
downstream (issues, score, insights, report) is DataFrame work on those facts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as k
from plumbline.functions import exprs as X
from plumbline.functions import names
from plumbline.operators import duplicates, issues, missing, outliers, profile, score
from plumbline.operators import facts as fx
from plumbline.operators import quantiles as qt
from plumbline.operators import insights, report, texture, uniqueness, validity
from plumbline.session import materialize

SCANS = ("types", "lengths", "bytes", "validity", "texture", "numbers", "unique")


def assess(df: DataFrame, dataset_id: str = "dataset", **options) -> Assessment:
    return Assessment(df, dataset_id, **options)


class Assessment:
    """Lazily computed quality results of one DataFrame.

    order_by names the columns that define row order, columns the ones to assess: all
    when omitted. Rows are then compared without the columns of order_by, as in cleaning.
    strict_first_format lets the first value
    of a column fix the date format of all its values; the default reads each on its
    own. Without order_by, all columns define the order.
    """

    def __init__(
        self,
        df: DataFrame,
        dataset_id: str = "dataset",
        *,
        columns: Sequence[str] | None = None,
        order_by: Sequence[str] = (),
        file_format: str = "parquet",
        min_values: int = outliers.MIN_VALUES,
        strict_first_format: bool = False,
    ):
        self.spark = df.sparkSession
        self.dataset_id = dataset_id
        self.file_format = file_format
        self.order_by = list(order_by)
        self.min_values = min_values
        self.strict_first_format = strict_first_format
        self.source = df
        self.columns = list(columns or df.columns)
        self.row_columns = duplicates.data_columns(df, columns, order_by)
        self.cells = fx.scalar_cells(df.select(*[X.ref(c) for c in self.columns]))
        self._rows: int | None = None
        self._known: dict[int, dict] = {i: {} for i in range(len(self.columns))}
        self._done: set[str] = set()
        self._profiles: dict[int, DataFrame] = {}

    # ---- facts ----------------------------------------------------------------------

    def facts(self, *needs: str) -> DataFrame:
        """One row per column holding at least the facts asked for."""
        self._scan([n for n in needs if n in SCANS])
        for need, run in (
            ("unique_identifiers", self._identifier_cardinality),
            ("quartiles", self._quartiles),
            ("outliers", self._outliers),
            ("long", self._long),
            ("shown", self._shown),
        ):
            if need in needs:
                run()
        rows = []
        for i, f in enumerate(self.cells.schema.fields):
            name = self.columns[i]
            known = {
                "dataset_id": self.dataset_id,
                "ordinal": i,
                "column": name,
                "kind": fx.kind_of(f.dataType),
                "original_dtype": self.source.schema[name].dataType.simpleString(),
                "named_identifier": names.is_identifier(name),
                "named_non_negative": names.is_non_negative(name),
                "named_percentage": names.is_percentage(name),
                "named_phone": names.is_phone(name),
                "named_dated": names.is_dated(name),
                "named_date": "date" in name.lower(),
                "named_email": names.is_email(name),
                "rows": self._rows,
                **self._known[i],
            }
            rows.append(tuple(known.get(c) for c in fx.FACTS.names))
        return self.spark.createDataFrame(rows, fx.FACTS)

    def _merge(self, found: dict[int, dict]) -> None:
        for i, values in found.items():
            self._known[i] |= values

    def _scan(self, groups: Sequence[str] = ()) -> None:
        groups = [g for g in groups if g not in self._done]
        if self._rows is not None and not groups:
            return
        self._rows, found = fx.scan(self.cells, groups)
        self._merge(found)
        if self.strict_first_format and {"types", "validity"} & set(groups):
            order = self.order_by or self.source.columns
            self._merge(fx.first_format_facts(self.cells, order, self.source))
        self._done |= set(groups)

    def _cardinality(self, ordinals: Sequence[int] | None = None) -> None:
        ordinals = range(len(self.columns)) if ordinals is None else ordinals
        missing_ones = [i for i in ordinals if "unique" not in self._known[i]]
        self._merge(fx.cardinality(self.cells, missing_ones))

    def _identifier_cardinality(self) -> None:
        self._cardinality([i for i, c in enumerate(self.columns) if names.is_identifier(c)])

    def _numeric(self) -> list[int]:
        return fx.by_kind(self.cells, *fx.NUMERIC)

    def _quartiles(self) -> None:
        if "quartiles" in self._done:
            return
        self._scan()
        counts = {i: self._known[i]["non_null"] for i in self._numeric()}
        found = qt.quantiles(self.cells, counts)
        self._merge({i: dict(zip(("q25", "q50", "q75"), q, strict=True)) for i, q in found.items()})
        self._done.add("quartiles")

    def _outliers(self) -> None:
        if "outliers" in self._done:
            return
        self._scan(["numbers"])
        self._quartiles()
        fences = {}
        for i in self._numeric():
            f = self._known[i]
            if f["non_null"] < self.min_values or "q25" not in f or f["q75"] <= f["q25"]:
                continue
            reach = 1.5 * (f["q75"] - f["q25"])
            f["lower"], f["upper"], f["outliers"] = f["q25"] - reach, f["q75"] + reach, 0
            if f["mn"] < f["lower"] or f["mx"] > f["upper"]:
                fences[i] = (f["lower"], f["upper"])
        self._merge(
            {i: {"outliers": n} for i, n in fx.beyond_limits(self.cells, fences, {}).items()}
        )
        self._done.add("outliers")

    def _long(self) -> None:
        if "long" in self._done:
            return
        self._scan(["lengths"])
        limits = {}
        for i in fx.by_kind(self.cells, fx.STRING):
            f = self._known[i]
            if not f["non_null"]:
                continue
            sd = f.get("len_sd") or 0.0
            f["length_limit"] = max(500, math.floor(f["len_mean"] + 3 * sd)) if sd > 0 else 500
            f["too_long"] = 0
            if f["len_max"] >= f["length_limit"]:
                limits[i] = f["length_limit"]
        self._merge(
            {i: {"too_long": n} for i, n in fx.beyond_limits(self.cells, {}, limits).items()}
        )
        self._done.add("long")

    def _shown(self) -> None:
        self._scan(["unique"])
        wanted = [
            i
            for i, f in self._known.items()
            if f["unique"] == 1 and f["non_null"] > 1 and "shown" not in f
        ]
        self._merge({i: {"shown": v} for i, v in fx.constant_values(self.cells, wanted).items()})

    # ---- profile --------------------------------------------------------------------

    def dimensions(self) -> DataFrame:
        """One row: rows, columns, cells, null cells and format."""
        facts = self.facts()
        return profile.dimensions(facts, self.file_format)

    def footprint(self) -> DataFrame:
        return profile.footprint(self.facts("bytes"))

    def typed_facts(self, *needs: str) -> DataFrame:
        return profile.with_types(self.facts("types", "unique", *needs))

    def top_values(self, top_n: int = 10) -> DataFrame:
        return profile.top_values(self.cells, self.typed_facts(), top_n)

    def profile(self, top_n: int = 10) -> DataFrame:
        """One row per column in source order."""
        if top_n not in self._profiles:
            facts = self.typed_facts("lengths", "numbers", "quartiles")
            top = profile.top_values(self.cells, facts, top_n)
            self._profiles[top_n] = materialize(profile.assemble(facts, top))
        return self._profiles[top_n]

    # ---- issues and score -----------------------------------------------------------

    @cached_property
    def _row_copies(self) -> tuple:
        return tuple(duplicates.duplicate_counts(self.cells.select(*[X.ref(c) for c in self.row_columns])).first())

    def row_copies(self) -> DataFrame:
        """One row: exact and normalised duplicate counts."""
        return self.spark.createDataFrame(
            [(self.dataset_id, *self._row_copies)],
            "dataset_id string, rows bigint, exact_affected bigint, exact_extra bigint, "
            "loose_affected bigint, loose_extra bigint",
        )

    def issues(self) -> DataFrame:
        """All issues in detection order."""
        return self.spark.createDataFrame(self._issues, issues.SCHEMA)

    @cached_property
    def _issues(self) -> list:
        """At most one row per column and rule, so it is kept like the facts."""
        self._scan(("validity", "texture", "lengths", "numbers", "unique"))
        facts = self.facts("shown", "outliers", "long")
        by_column = (
            missing.RULES
            + uniqueness.IDENTIFIER_RULES
            + validity.RULES
            + outliers.RULES
            + texture.RULES
        )
        found = issues.apply_rules(facts, by_column).unionByName(
            uniqueness.row_issues(self.row_copies())
        )
        return issues.number(found).collect()

    def find(self, rules: Sequence, *needs: str) -> DataFrame:
        """The issues of some rules only, computing no more facts than they need."""
        return issues.number(issues.apply_rules(self.facts(*needs), rules))

    def issues_by_severity(self) -> DataFrame:
        return issues.count_by_severity(self.issues(), self.dimensions())

    def score(self, weights: dict = k.SCORE_WEIGHTS, penalties: dict = k.SCORE_PENALTIES):
        """Dimension scores, overall score and explanation."""
        return score.score(self.issues(), self.dimensions(), weights, penalties)

    # ---- insights and report --------------------------------------------------------

    def samples(self) -> DataFrame:
        return insights.redacted_samples(self.source, self.issues(), self.order_by)

    def executive_summary(self) -> DataFrame:
        return insights.executive_summary(self.score(), self.dimensions())

    def priorities(self) -> DataFrame:
        return insights.priorities(self.issues(), self.dimensions())

    def cleaning_plan(self) -> DataFrame:
        return insights.cleaning_plan(self.issues(), self.dimensions())

    def text_observations(self) -> DataFrame:
        return insights.text_observations(self.issues())

    def client_summary(self) -> DataFrame:
        return insights.client_summary(self.issues(), self.dimensions(), self.score())

    def report(
        self, audit: DataFrame | None = None, cleaning_summary: DataFrame | None = None
    ) -> DataFrame:
        """The twelve report sections as rows."""
        self._scan(SCANS)  # all that the sections need, in one scan
        issues_, dims = self.issues(), self._one_row(self.dimensions())
        scores = self._one_row(score.score(issues_, dims))
        return report.report(
            dimensions=dims,
            footprint=self._one_row(self.footprint()),
            scores=scores,
            profile=self.profile(),
            issues=issues_,
            summary=insights.executive_summary(scores, dims),
            priorities=insights.priorities(issues_, dims),
            plan=insights.cleaning_plan(issues_, dims),
            observations=insights.text_observations(issues_),
            audit=audit,
            cleaning_summary=cleaning_summary,
        )

    def _one_row(self, df: DataFrame) -> DataFrame:
        """A one-row result that several sections use, computed once."""
        return self.spark.createDataFrame([df.first()], df.schema)
