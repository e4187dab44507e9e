"""Text-consistency rules over column facts."""

from __future__ import annotations

from plumbline.functions import sqltext as Q
from plumbline.operators.issues import Rule

NEAR_EMPTY = Rule(
    "near_empty_text",
    4,
    "near_empty > 0 and len_mean > 3",
    "near_empty",
    severity=f"if({Q.pct('near_empty')} >= 5, 'medium', 'low')",
)
LONG = Rule(
    "extremely_long_text", 4, "too_long > 0", "too_long", slots={"t": "length_limit"}
)
REPEATED = Rule("repeated_text_anomaly", 4, "repetitive > 0", "repetitive")
SPACING = Rule("whitespace_formatting_anomaly", 4, "badly_spaced > 0", "badly_spaced")
RULES = (NEAR_EMPTY, LONG, REPEATED, SPACING)
