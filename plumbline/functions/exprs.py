"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions import constants as k


def ref(name: str) -> Column:
    """A column by its literal name; names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(c: Column) -> Column:
    """Remove the characters Python counts as whitespace from both ends."""
    return F.btrim(c, F.lit(k.WHITESPACE))


def quotient(part: Column, whole: Column, scale: int) -> Column:
    """part / whole rounded half-up on the exact rational; 0 when whole is 0.

    Only integers are divided, so two engines cannot disagree on a tie.
    """
    half_up = F.call_function(
        "div", part * F.lit(2 * scale).cast("bigint") + whole, F.nullif(whole * 2, F.lit(0))
    )
    return F.coalesce(half_up / F.lit(float(scale)), F.lit(0.0))


def pct(part: Column, whole: Column) -> Column:
    """part as a percentage of whole with two decimals."""
    return quotient(part * 100, whole, 100)


def fixed(c: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, ties to even."""
    return F.format_string(f"%.{digits}f", F.bround(c.cast("double"), digits))


def grouped(c: Column) -> Column:
    """An integer with thousands separators."""
    return F.format_number(c, 0)


def text(c: Column) -> Column:
    return c.cast("string")


_SLOT = re.compile(r"\{(\w+)\}")


def fill(template: str, **values: Column) -> Column:
    """Fill the {slots} of a message template with column expressions."""
    parts: list[Column] = []
    position = 0
    for slot in _SLOT.finditer(template):
        if slot.start() > position:
            parts.append(F.lit(template[position : slot.start()]))
        parts.append(text(values[slot.group(1)]))
        position = slot.end()
    if position < len(template):
        parts.append(F.lit(template[position:]))
    return F.concat(*parts)


def title(c: Column) -> Column:
    """snake_case to Title Case."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def contains_any(c: Column, words: Iterable[str]) -> Column:
    tests = [F.contains(c, F.lit(w)) for w in words]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


# ---- dates --------------------------------------------------------------------------

ISO, DELIMITED, NAMED = 1, 2, 3


def date_family(s: Column) -> Column:
    """Which of the three written date families a stripped value belongs to."""
    return (
        F.when(s.rlike(k.DATE_ISO), ISO)
        .when(s.rlike(k.DATE_DELIMITED), DELIMITED)
        .when(s.rlike(k.DATE_NAMED), NAMED)
    )


def date_shape(s: Column) -> Column:
    """The written form of a date: 9 for numbers, a for words, separators as they are."""
    words = F.regexp_replace(s, "[A-Za-z]{3,}", "a")
    return F.when(date_family(s).isNotNull(), F.regexp_replace(words, r"\d+", "9"))


def parse_date(
    s: Column, family: Column | None = None, day_first: Column | None = None
) -> Column:
    """A stripped value as a timestamp, null when it is no calendar date.

    Each value is read on its own: year first, then month first, then day first,
    then named months. With day_first, a boolean, delimited dates are read in
    that one order only. Parsing is by rearranging the text into ISO order and
    try_cast, which returns null on failure instead of raising inside the JVM.
    """
    family = date_family(s) if family is None else family
    as_ts = lambda *parts: F.concat(*parts).try_cast("timestamp")
    dash = F.lit("-")

    # the families allow / only between the parts of the date
    iso = F.translate(s, "/", "-").try_cast("timestamp")

    numbers = F.translate(s, "-", "/")
    one, two, rest = (F.split_part(numbers, F.lit("/"), F.lit(i)) for i in (1, 2, 3))
    year, time = F.substring(rest, 1, 4), F.substring(rest, F.lit(5), F.char_length(rest))
    month_first = as_ts(year, dash, one, dash, two, time)
    day_month = as_ts(year, dash, two, dash, one, time)
    if day_first is None:
        delimited = F.coalesce(month_first, day_month)
    else:
        delimited = F.when(day_first, day_month).otherwise(month_first)

    words = F.split(F.regexp_replace(s, r",?\s+", " "), " ")
    word = lambda i: F.get(words, F.lit(i))
    starts_with_day = word(0).rlike(r"^\d")
    day = F.when(starts_with_day, word(0)).otherwise(word(1))
    name = F.lower(F.when(starts_with_day, word(1)).otherwise(word(0)))
    place = F.array_position(F.array(*map(F.lit, k.MONTHS)), name)
    month = text(F.when(place > 0, F.pmod(place - 1, F.lit(12)) + 1))
    clock = F.coalesce(F.concat(F.lit(" "), word(3)), F.lit(""))
    named = F.when(
        (F.size(words) <= 4) & (F.char_length(word(2)) == 4),
        as_ts(word(2), dash, month, dash, day, clock),
    )
    return (
        F.when(family == ISO, iso)
        .when(family == DELIMITED, delimited)
        .when(family == NAMED, named)
    )


def year_between(ts: Column, first: int, last: int) -> Column:
    return F.year(ts).between(first, last)


# ---- text ---------------------------------------------------------------------------


def is_repetitive(s: Column) -> Column:
    """One character five times or more, or a word three times in a row.

    ASCII text, told by its byte count, takes the cheaper ASCII pattern, and
    only when a word stands between two gaps at all.
    """
    is_ascii = F.octet_length(s) == F.char_length(s)
    word = F.when(is_ascii, s.rlike(r"\s\S+\s") & s.rlike(k.REPEATED_WORD)).otherwise(
        s.rlike("(?U)" + k.REPEATED_WORD)
    )
    return s.rlike(k.REPEATED_CHARACTER) | word


def has_spacing_problem(c: Column, stripped: Column) -> Column:
    return (c != stripped) | c.rlike("  |[\n\r\t]")


def is_phone(s: Column) -> Column:
    digits = F.length(F.regexp_replace(s, r"(?U)\D", ""))
    return s.rlike("(?U)" + k.PHONE_CHARACTERS) & digits.between(7, 15)


def is_strict_email(s: Column) -> Column:
    return F.contains(s, F.lit("@")) & s.rlike(k.EMAIL_STRICT)


def is_loose_email(s: Column) -> Column:
    return F.contains(s, F.lit("@")) & s.rlike("(?U)" + k.EMAIL_LOOSE)


def is_placeholder(c: Column) -> Column:
    return F.lower(strip(c)).isin(*k.PLACEHOLDERS)


# ---- row identity -------------------------------------------------------------------


# Fixed-width columns that are cheaper to compare as they are.
PLAIN_KEYS = 16
_PLAIN_TYPES = (
    T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def row_keys(cells: list[tuple[Column, T.DataType]]) -> list[Column]:
    """Columns that are equal exactly when the rows are.

    Up to 16 fixed-width columns stay as they are. All other cells become one
    text: each is written as length:bytes and a null as '~', so two different
    rows never have the same text. Past 64 bytes its SHA-256 takes its place;
    not shuffling the texts is what makes whole-row comparison affordable.
    """
    plain, hashed = [], []
    for c, data_type in cells:
        if isinstance(data_type, _PLAIN_TYPES) and len(plain) < PLAIN_KEYS:
            plain.append(c)
        else:
            s = text(c)
            hashed.append(
                F.coalesce(F.concat(text(F.octet_length(s)), F.lit(":"), s), F.lit("~"))
            )
    if hashed:
        whole = F.concat(*hashed)
        # a digest has neither ':' nor '~', so it never equals a written row
        plain.append(F.when(F.octet_length(whole) > 64, F.sha2(whole, 256)).otherwise(whole))
    return plain
