"""Tukey fences and the outlier rule over column facts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.functions import sqltext as Q
from plumbline.operators.issues import Rule

MIN_VALUES = 4

_SHARE = Q.pct("outliers")
RULES = (
    Rule(
        "outliers",
        3,
        "outliers > 0",
        "outliers",
        severity=f"case when {_SHARE} >= 10 then 'high' when {_SHARE} >= 3 then 'medium' "
        "else 'low' end",
        slots={"lo": Q.fixed("lower", 2), "hi": Q.fixed("upper", 2)},
    ),
)


def fence_rows(facts: DataFrame) -> DataFrame:
    """Fences of every numeric column with enough values and a positive IQR."""
    return facts.where(
        f"rows >= {MIN_VALUES} and non_null >= {MIN_VALUES} and q75 - q25 > 0"
    ).selectExpr(
        "dataset_id",
        "column",
        "round(q25, 4) as q25",
        "round(q75, 4) as q75",
        "round(q75 - q25, 4) as iqr",
        "round(q25 - 1.5D * (q75 - q25), 4) as lower_bound",
        "round(q75 + 1.5D * (q75 - q25), 4) as upper_bound",
    )
