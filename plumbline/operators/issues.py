"""The issue table: how rules write it, and counting, filtering and sorting it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import constants as k
from plumbline.functions import sqltext as Q

COLUMNS = (
    "dataset_id", "ordinal", "type", "severity", "column", "affected_rows", "percentage",
    "description", "method",
)
SCHEMA = (
    "dataset_id string, ordinal int, type string, severity string, column string, "
    "affected_rows bigint, percentage double, description string, method string"
)
SEVERITIES = ("high", "medium", "low")


@dataclass(frozen=True)
class Rule:
    """One line of the issue catalogue with its condition over a facts row, as SQL.

    Modules order the issue list; within a module issues follow the columns.
    """

    name: str
    module: int
    when: str
    affected: str
    type: str | None = None
    severity: str | None = None
    slots: dict[str, str] = field(default_factory=dict)

    def sql(self) -> str:
        severity, method, description = k.ISSUES[self.name]
        percentage = Q.pct(self.affected)
        slots = {"c": "column", "n": self.affected, "p": percentage} | self.slots
        return (
            f"if({self.when}, named_struct("
            f"'module', {self.module}, "
            f"'type', {Q.literal(self.type or self.name)}, "
            f"'severity', {self.severity or Q.literal(severity)}, "
            f"'affected_rows', cast({self.affected} as bigint), "
            f"'percentage', {percentage}, "
            f"'description', {Q.fill(description, **slots)}, "
            f"'method', {Q.fill(method, **slots)}), null)"
        )


def apply_rules(facts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The issues of every facts row, with their place in the detection order."""
    found = facts.selectExpr(
        "dataset_id",
        "ordinal as column_no",
        "column",
        f"posexplode(array({', '.join(r.sql() for r in rules)})) as (rule_no, found)",
    ).where("found is not null")
    return found.selectExpr(
        "dataset_id",
        "struct(found.module, column_no, rule_no) as place",
        "found.type",
        "found.severity",
        "column",
        "found.affected_rows",
        "found.percentage",
        "found.description",
        "found.method",
    )


def number(issues: DataFrame) -> DataFrame:
    """Issue rows in detection order, numbered from 1 within each dataset."""
    order = Window.partitionBy("dataset_id").orderBy("place")
    return issues.withColumn("ordinal", F.row_number().over(order)).select(*COLUMNS)


def severity_weight(c: Column) -> Column:
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)


def count_by_severity(issues: DataFrame, datasets: DataFrame) -> DataFrame:
    """Always high, medium and low per dataset, with zero where nothing was found."""
    levels = F.explode(F.array(*map(F.lit, SEVERITIES))).alias("severity")
    all_levels = datasets.select("dataset_id", levels)
    counts = issues.groupBy("dataset_id", F.lower("severity").alias("severity")).agg(
        F.count("*").alias("issues")
    )
    return all_levels.join(counts, ["dataset_id", "severity"], "left").select(
        "dataset_id", "severity", F.coalesce("issues", F.lit(0)).cast("bigint").alias("issues")
    )


def filter_issues(issues: DataFrame, severity: str = "all", search: str = "") -> DataFrame:
    """Severity and case-insensitive search over column, type, description, method."""
    out = issues
    if severity != "all":
        out = out.where(F.lower("severity") == severity)
    if search.strip():
        needle = F.lit(search.lower())
        found = F.lit(False)
        for c in ("column", "type", "description", "method"):
            found = found | F.coalesce(F.contains(F.lower(F.col(c)), needle), F.lit(False))
        out = out.where(found)
    return out


def sort_issues(issues: DataFrame, by: str = "severity", descending: bool = True) -> DataFrame:
    """Sorted with a position column; ties keep detection order."""
    keys = {
        "severity": severity_weight(F.lower("severity")),
        "affected_rows": F.col("affected_rows"),
        "percentage": F.col("percentage"),
        "column": F.coalesce("column", F.lit("")),
        "issue": F.col("type"),
    }
    key = keys[by].desc() if descending else keys[by].asc()
    order = Window.partitionBy("dataset_id").orderBy(key, "ordinal")
    return issues.withColumn("position", F.row_number().over(order)).orderBy(
        "dataset_id", "position"
    )
