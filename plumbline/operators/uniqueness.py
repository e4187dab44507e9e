"""Uniqueness rules: identifiers from column facts, row copies from their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbline.operators.issues import Rule, apply_rules

IDENTIFIER_RULES = (
    Rule(
        "duplicate_identifier", 1, "named_identifier and rows > 1 and repeated > 0", "repeated"
    ),
)

_EXTRA = "(loose_extra - exact_extra)"
_AFFECTED = "(loose_affected - exact_affected)"
EXACT = Rule(
    "duplicate_rows", 1, "rows > 1 and exact_extra > 0", "exact_affected",
    slots={"x": "exact_extra"},
)
NORMALIZED = Rule(
    "normalized_duplicate_rows", 1, f"rows > 1 and {_EXTRA} > 0 and {_AFFECTED} > 0", _AFFECTED,
    slots={"x": _EXTRA},
)


def row_issues(counts: DataFrame) -> DataFrame:
    """Exact copies come before the identifier issues, normalised copies after them."""
    placed = counts.selectExpr("*", "cast(null as string) as column")
    exact = apply_rules(placed.selectExpr("*", "-1 as ordinal"), [EXACT])
    loose = apply_rules(placed.selectExpr("*", "2147483647 as ordinal"), [NORMALIZED])
    return exact.unionByName(loose)
