"""Safe cleaning with an audit of every change.

Steps, each seeing the previous result: drop identical rows, trim, collapse
inner gaps, lower-case e-mails, turn placeholders into nulls. After the
duplicates are gone the text steps are one projection, and everything the audit
and the warnings need comes from one aggregate over it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as k
from plumbline.functions import exprs as X
from plumbline.functions import names
from plumbline.functions import sqltext as Q
from plumbline.operators import facts as fx
from plumbline.operators.duplicates import data_columns, keep_first
from plumbline.session import keep

TEXT_STEPS = (
    "trim_whitespace",
    "normalize_whitespace",
    "normalize_email_casing",
    "standardize_missing",
)
# Share of rows with an @ from which a column is treated as e-mail.
EMAIL_SHARE = 0.3
OUTLIER_MIN_VALUES = 5
MOSTLY_NULL = 60

AUDIT = (
    "dataset_id string, step int, type string, description string, affected_rows bigint, "
    "cells_modified bigint, affected_columns array<string>"
)
WARNINGS = "dataset_id string, ordinal int, kind string, column string, affected_rows bigint, warning string"


def trim(c: Column) -> Column:
    return X.strip(c)


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, k.WIDE_GAP, " ")


def lower_email(c: Column) -> Column:
    bare = X.strip(c)
    return F.when(X.is_loose_email(bare), F.lower(bare)).otherwise(c)


def null_placeholders(c: Column) -> Column:
    return F.when(~X.is_placeholder(c), c)


def text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    return [c for c in columns if fx.kind_of(df.schema[c].dataType) == fx.STRING]


def email_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Text columns named e-mail, or with an @ in more than 30 % of all rows."""
    texts = text_columns(df, columns)
    unnamed = [c for c in texts if not names.is_email(c)]
    mostly = set()
    if unnamed:
        counts = df.agg(
            F.count("*").alias("rows"),
            *[
                F.count_if(F.contains(X.ref(c), F.lit("@"))).alias(f"c{i}")
                for i, c in enumerate(unnamed)
            ],
        ).first()
        mostly = {
            c for i, c in enumerate(unnamed) if counts[f"c{i}"] > EMAIL_SHARE * counts["rows"]
        }
    return [c for c in texts if names.is_email(c) or c in mostly]


class Cleaning:
    """A cleaned copy of a table with its audit, warnings and summary."""

    def __init__(
        self,
        df: DataFrame,
        dataset_id: str = "dataset",
        *,
        columns: Sequence[str] | None = None,
        order_by: Sequence[str] = (),
    ):
        from plumbline.sources.flatten import nested_to_json

        self.spark = df.sparkSession
        self.dataset_id = dataset_id
        self.order_by = list(order_by)
        self.source = nested_to_json(df)
        self.columns = data_columns(self.source, columns, order_by)
        self.texts = text_columns(self.source, self.columns)

    # ---- rows -----------------------------------------------------------------------

    @cached_property
    def deduplicated(self) -> DataFrame:
        """Written once where rows went, as audit, warnings and result all read it."""
        first = keep_first(self.source, self.columns, self.order_by)
        return first if first is self.source else keep(first)

    @cached_property
    def emails(self) -> list[str]:
        return email_columns(self.deduplicated, self.columns)

    @cached_property
    def _staged(self) -> DataFrame:
        """Every text column after each step, as columns __s{step}_{column no}."""
        out = self.deduplicated
        for i, c in enumerate(self.texts):
            out = out.withColumnRenamed(c, f"__s0_{i}")
        steps = (
            lambda c, name: trim(c),
            lambda c, name: collapse(c),
            lambda c, name: lower_email(c) if name in self.emails else c,
            lambda c, name: null_placeholders(c),
        )
        for n, step in enumerate(steps, start=1):
            out = out.select(
                "*",
                *[step(F.col(f"__s{n - 1}_{i}"), c).alias(f"__s{n}_{i}") for i, c in enumerate(self.texts)],
            )
        return out

    @cached_property
    def cleaned(self) -> DataFrame:
        """The cleaned rows, in the source's columns."""
        last = len(TEXT_STEPS)
        final = {c: F.col(f"__s{last}_{i}").alias(c) for i, c in enumerate(self.texts)}
        return self._staged.select(*[final.get(c, X.ref(c)) for c in self.source.columns])

    # ---- audit ----------------------------------------------------------------------

    @cached_property
    def _original_rows(self) -> int:
        return self.source.count()

    @cached_property
    def _counts(self) -> dict:
        """One aggregate over the staged rows."""
        staged = self._staged
        before = {c: f"__s0_{i}" for i, c in enumerate(self.texts)}
        order = self.order_by or self.source.columns
        first = F.struct(*[X.ref(before.get(c, c)) for c in order])
        aggregates = {"rows": F.count("*")}
        for n in range(1, len(TEXT_STEPS) + 1):
            touched = F.lit(False)
            for i in range(len(self.texts)):
                changed = ~F.col(f"__s{n - 1}_{i}").eqNullSafe(F.col(f"__s{n}_{i}"))
                aggregates[f"cells_{n}_{i}"] = F.count_if(changed)
                touched = touched | changed
            aggregates[f"rows_{n}"] = F.count_if(touched)
        last = len(TEXT_STEPS)
        position = {c: i for i, c in enumerate(self.texts)}
        for j, c in enumerate(self.columns):
            value = F.col(f"__s{last}_{position[c]}") if c in position else X.ref(c)
            aggregates[f"filled_{j}"] = F.count(value)
            if names.is_email(c):
                bad = value.isNotNull() & ~X.is_loose_email(X.text(value))
                aggregates[f"bad_email_{j}"] = F.count_if(bad)
                aggregates[f"bad_email_first_{j}"] = F.min_by(
                    F.when(bad, X.text(value)), F.when(bad, first)
                )
            if names.is_cleaning_non_negative(c) and c in self._numeric:
                bad = value < 0
                aggregates[f"negative_{j}"] = F.count_if(bad)
                aggregates[f"negative_first_{j}"] = F.min_by(
                    F.when(bad, X.text(value)), F.when(bad, first)
                )
        return staged.agg(*[e.alias(n) for n, e in aggregates.items()]).first().asDict()

    @cached_property
    def _numeric(self) -> list[str]:
        return [
            c
            for c in self.columns
            if fx.kind_of(self.source.schema[c].dataType) in fx.NUMERIC
        ]

    def audit(self) -> DataFrame:
        """One row per step that changed something."""
        counts = self._counts
        removed = self._original_rows - counts["rows"]
        rows = [(self.dataset_id, 1, "remove_duplicates", removed, 0, None)]
        for n, step in enumerate(TEXT_STEPS, start=1):
            cells = {c: counts[f"cells_{n}_{i}"] for i, c in enumerate(self.texts)}
            changed = [c for c in self.columns if cells.get(c)]
            rows.append(
                (self.dataset_id, n + 1, step, counts[f"rows_{n}"], sum(cells.values()), changed)
            )
        table = self.spark.createDataFrame(
            rows,
            "dataset_id string, step int, type string, affected_rows bigint, "
            "cells_modified bigint, affected_columns array<string>",
        )
        slots = {
            "n": "if(step = 1, affected_rows, cells_modified)",
            "k": "size(affected_columns)",
            "names": "array_join(affected_columns, ', ')",
        }
        description = Q.choose(
            [(f"type = '{t}'", Q.fill(text, **slots)) for t, text in k.CLEANING_STEPS.items()]
        )
        return table.where("affected_rows > 0").selectExpr(
            "dataset_id",
            "step",
            "type",
            f"{description} as description",
            "affected_rows",
            "cells_modified",
            "affected_columns",
        )

    def summary(self) -> DataFrame:
        counts = self._counts
        cells = sum(v for n, v in counts.items() if n.startswith("cells_"))
        rows = (self.dataset_id, self._original_rows, counts["rows"], cells)
        return self.spark.createDataFrame(
            [rows],
            "dataset_id string, original_rows bigint, cleaned_rows bigint, cells_modified bigint",
        ).selectExpr(
            "dataset_id",
            "original_rows",
            "cleaned_rows",
            "original_rows - cleaned_rows as rows_removed",
            "cells_modified",
        )

    # ---- warnings -------------------------------------------------------------------

    @cached_property
    def _outliers(self) -> list[tuple]:
        """(column, count, lower, upper) of numeric columns with outliers."""
        from plumbline.plans.assessment import Assessment

        if not self._numeric:
            return []
        numbers = Assessment(
            self.deduplicated, self.dataset_id, columns=self._numeric, min_values=OUTLIER_MIN_VALUES
        )
        found = numbers.facts("outliers").where("outliers > 0").orderBy("ordinal")
        return [
            (r["column"], r["outliers"], r["lower"], r["upper"]) for r in found.collect()
        ]

    def warnings(self, *kinds: str) -> DataFrame:
        """Anomalies that are reported and left unchanged."""
        kinds = kinds or tuple(k.CLEANING_WARNINGS)
        rows: list[tuple] = []
        if "outliers" in kinds:
            rows += [("outliers", c, n, None, lo, hi, 0) for c, n, lo, hi in self._outliers]
        if set(kinds) - {"outliers"}:
            counts = self._counts
            total = counts["rows"]
            for kind, prefix in (("negatives", "negative"), ("malformed_email", "bad_email")):
                if kind in kinds:
                    rows += [
                        (kind, c, counts[f"{prefix}_{j}"], counts[f"{prefix}_first_{j}"], None, None, total)
                        for j, c in enumerate(self.columns)
                        if counts.get(f"{prefix}_{j}")
                    ]
            if "mostly_null" in kinds and total:
                rows += [
                    ("mostly_null", c, total - counts[f"filled_{j}"], None, None, None, total)
                    for j, c in enumerate(self.columns)
                    if 100 * (total - counts[f"filled_{j}"]) > MOSTLY_NULL * total
                ]
        table = self.spark.createDataFrame(
            [(self.dataset_id, n, *r) for n, r in enumerate(rows, start=1)],
            "dataset_id string, ordinal int, kind string, column string, affected_rows bigint, "
            "example string, lower double, upper double, rows bigint",
        )
        slots = {
            "c": "column",
            "n": "affected_rows",
            "v": "example",
            "lo": Q.fixed("lower", 1),
            "hi": Q.fixed("upper", 1),
            "r": "rows",
            "p": Q.fixed("100 * affected_rows / nullif(rows, 0)", 1),
        }
        warning = Q.choose(
            [(f"kind = '{t}'", Q.fill(text, **slots)) for t, text in k.CLEANING_WARNINGS.items()]
        )
        return table.selectExpr(
            "dataset_id", "ordinal", "kind", "column", "affected_rows", f"{warning} as warning"
        )


def clean(df: DataFrame, dataset_id: str = "dataset", **options) -> Cleaning:
    return Cleaning(df, dataset_id, **options)
