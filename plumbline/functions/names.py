"""Column-name rules, decided while the plan is built so they prune work."""

from __future__ import annotations

import re

from plumbline.functions import constants as k


def is_identifier(name: str) -> bool:
    """The name implies unique values."""
    bare = re.sub(r"[^a-z0-9_]", "", name.lower())
    return (
        bare in k.IDENTIFIER_NAMES
        or bare.endswith(k.IDENTIFIER_SUFFIXES)
        or bare.startswith(k.IDENTIFIER_PREFIXES)
    )


_NON_NEGATIVE = re.compile(
    "|".join(rf"\b{w}\b|_{w}$|^{w}_" for w in map(re.escape, k.NON_NEGATIVE_WORDS))
)


def is_non_negative(name: str) -> bool:
    """The name implies a quantity that cannot be below zero."""
    low = name.strip().lower()
    return not _mentions(low, k.SIGNED_WORDS) and _NON_NEGATIVE.search(low) is not None


def is_percentage(name: str) -> bool:
    return _mentions(name.lower(), k.PERCENT_WORDS)


def is_phone(name: str) -> bool:
    return _mentions(name.lower(), k.PHONE_WORDS)


def is_dated(name: str) -> bool:
    return _mentions(name.lower(), k.DATE_WORDS)


def is_email(name: str) -> bool:
    return "email" in name.lower()


def is_cleaning_non_negative(name: str) -> bool:
    """The looser substring rule of the cleaning warnings."""
    return _mentions(name.lower(), k.CLEANING_NON_NEGATIVE_WORDS)


def is_secret(name: str) -> bool:
    return _mentions(name.lower(), k.SECRET_WORDS)


def _mentions(low: str, words: tuple[str, ...]) -> bool:
    return any(w in low for w in words)
