import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

#: Every column may be null, texts may be empty or long, rows may repeat.
ODD_TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "word",
    "one two three four five six",
    "one two three four five six",
    "ÉÈ ß İ ﬁ 한국 😀",
    "x" * 70_000,
    "1" * 70_000,
    "lorem ipsum " * 20_000,
    ". , ; !!! %%%",
]


@pytest.fixture
def odd(spark):
    """Documents of every awkward kind, with columns whose names may clash."""
    rows = [(i, t, "s") for i, t in enumerate(ODD_TEXTS)]
    rows += [(None, "one two three four five six", None), (None, None, "s"), (3, "word", "s"), (3, "word", "s")]
    rows = [(*r, "a", 1, True, b"k", 7) for r in rows]
    return spark.createDataFrame(
        rows,
        "doc_id long, text string, source string, kept string, n int, set_key boolean, value binary, tokens int",
    )


@pytest.fixture
def empty(odd):
    return odd.limit(0)
