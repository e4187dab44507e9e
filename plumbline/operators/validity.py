"""Validity, constant and low-variance rules over column facts.

A constant column is exempt from every later rule of this module.
"""

from __future__ import annotations

from plumbline.functions import sqltext as Q
from plumbline.operators.issues import Rule

_FILLED = "rows > 0 and non_null > 0"
_CONSTANT = "coalesce(unique = 1 and non_null > 1, false)"
_CHECKED = f"{_FILLED} and not {_CONSTANT}"
_TEXT = "kind = 'string'"
_NUMBER = "kind in ('integral', 'fractional')"
_SHOWN = "if(char_length(shown) > 40, concat(substring(shown, 1, 37), '...'), shown)"

# Named e-mail, or text with an @ in more than 40 % of its values.
EMAIL_CANDIDATE = (
    f"(named_email or coalesce({_TEXT} and at_sign / nullif(non_null, 0) > 0.4, false))"
)
_BAD_EMAIL = "(non_null - coalesce(email_ok, 0))"
_BAD_PHONE = "(non_null - phone_ok)"
_BAD_DATE = "(non_null - stamps_ok)"

CONSTANT = Rule("constant_column", 2, f"{_FILLED} and {_CONSTANT}", "non_null", slots={"v": _SHOWN})
LOW_VARIANCE = Rule(
    "low_variance_column",
    2,
    f"{_CHECKED} and rows >= 20 and unique > 1 and {Q.pct('top')} >= 99",
    "top",
)
EMAIL = Rule(
    "invalid_email", 2, f"{_CHECKED} and {EMAIL_CANDIDATE} and {_BAD_EMAIL} > 0", _BAD_EMAIL
)
PERCENTAGE = Rule(
    "impossible_percentage",
    2,
    f"{_CHECKED} and named_percentage and {_NUMBER} and off_percent > 0",
    "off_percent",
)
NEGATIVE = Rule(
    "negative_value_violation",
    2,
    f"{_CHECKED} and named_non_negative and {_NUMBER} and negatives > 0",
    "negatives",
)
PHONE = Rule(
    "malformed_phone", 2, f"{_CHECKED} and named_phone and {_TEXT} and {_BAD_PHONE} > 0", _BAD_PHONE
)
DATE = Rule(
    "invalid_date",
    2,
    f"{_CHECKED} and named_dated and {_TEXT} and {_BAD_DATE} > 0 "
    "and (stamps * 2 >= non_null or named_date)",
    _BAD_DATE,
)
RULES = (CONSTANT, LOW_VARIANCE, EMAIL, PERCENTAGE, NEGATIVE, PHONE, DATE)
