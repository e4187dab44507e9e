"""Completeness rules: nulls plus whitespace-only text."""

from __future__ import annotations

from plumbline.functions import sqltext as Q
from plumbline.operators.issues import Rule

MISSING = "(rows - non_null + coalesce(blank, 0))"
_SHARE = Q.pct(MISSING)
_SOME = f"{MISSING} > 0 and {MISSING} < rows"

RULES = (
    Rule("empty_column", 0, f"rows > 0 and {MISSING} = rows", MISSING),
    Rule("high_missing_percentage", 0, f"{_SOME} and {_SHARE} >= 50", MISSING),
    Rule(
        "elevated_missing_percentage",
        0,
        f"{_SOME} and {_SHARE} >= 20 and {_SHARE} < 50",
        MISSING,
        type="high_missing_percentage",
    ),
    Rule("missing_values", 0, f"{_SOME} and {_SHARE} < 20", MISSING),
)
