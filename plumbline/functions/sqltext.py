"""SQL fragments for rules that run over small fact and issue tables."""

from __future__ import annotations

import re

_SLOT = re.compile(r"\{(\w+)\}")


def literal(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quotient(part: str, whole: str, scale: int) -> str:
    """part / whole rounded half-up on the exact rational; 0 when whole is 0."""
    half_up = f"(cast({part} as bigint) * {2 * scale} + {whole}) div nullif(2 * ({whole}), 0)"
    return f"coalesce(({half_up}) / {scale}D, 0D)"


def pct(part: str, whole: str = "rows") -> str:
    return quotient(f"({part}) * 100", f"({whole})", 100)


def fixed(value: str, digits: int) -> str:
    """Text with a fixed number of decimals, ties to even."""
    return f"format_string('%.{digits}f', bround(cast({value} as double), {digits}))"


def grouped(value: str) -> str:
    return f"format_number({value}, 0)"


def fill(template: str, **slots: str) -> str:
    """Fill the {slots} of a message template with SQL expressions."""
    names = _SLOT.findall(template)
    if not names:
        return literal(template)
    pattern = _SLOT.sub("%s", template.replace("%", "%%"))
    arguments = ", ".join(f"coalesce(cast({slots[n]} as string), 'None')" for n in names)
    return f"format_string({literal(pattern)}, {arguments})"


def choose(branches: list[tuple[str, str]], otherwise: str = "null") -> str:
    """CASE with (condition, value) branches."""
    if not branches:
        return otherwise
    return "case " + " ".join(f"when {c} then {v}" for c, v in branches) + f" else {otherwise} end"


def words(values: tuple[str, ...]) -> str:
    return ", ".join(literal(v) for v in values)
