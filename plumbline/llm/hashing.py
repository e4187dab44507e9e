"""Vectorised word hashing over the raw UTF-8 bytes of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once: numpy needs about 30 bytes of memory for each of them, and the
#: powers below 16 more in every worker.
BLOCK_BYTES = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240117))
BYTE_VALUES = _rng.integers(1, 2**64 - 1, 256, dtype=U64) | U64(1)
STEP = U64(0x9E3779B97F4A7C15 | 1)
PLACES = _rng.integers(1, 2**64 - 1, 64, dtype=U64) | U64(1)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Everything but ASCII letters, digits and the bytes of other scripts separates.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that similar inputs get unrelated values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, U64)
    out[0] = U64(1)
    return np.multiply.accumulate(out)


def inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


_POWERS = powers(BLOCK_BYTES + 1)
_INVERSES = np.full(BLOCK_BYTES + 1, inverse(int(STEP)), U64)
_INVERSES[0] = U64(1)
_INVERSES = np.multiply.accumulate(_INVERSES)


def powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the polynomial's step for n bytes, and their inverses."""
    if n <= BLOCK_BYTES:
        return _POWERS, _INVERSES
    inv = np.full(n + 1, inverse(int(STEP)), U64)
    inv[0] = U64(1)
    return powers(n + 1), np.multiply.accumulate(inv)


def fold_case(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and the two-byte Latin-1 letters."""
    out = LOWER[buf]
    if len(buf) > 1:
        latin = np.flatnonzero(buf[:-1] == 0xC3) + 1
        second = buf[latin]
        upper = latin[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
        out[upper] += 32
    return out


def word_bounds(buf: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each run of bytes that don't separate."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~separators[buf]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: a polynomial over random byte values, then mixed."""
    up, down = powers_of(len(buf))
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_VALUES[buf] * up[: len(buf)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


def hash_words(buf: np.ndarray, separators: np.ndarray = SPACES) -> np.ndarray:
    """Hashes of a text's words in order; a text of any length, in blocks."""
    if len(buf) <= BLOCK_BYTES:
        return hash_spans(buf, *word_bounds(buf, separators))
    parts, at = [], 0
    while at < len(buf):
        end = min(at + BLOCK_BYTES, len(buf))
        if end < len(buf):
            gaps = np.flatnonzero(separators[buf[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # one word is longer than a block
                rest = np.flatnonzero(separators[buf[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(buf)
        piece = buf[at:end]
        parts.append(hash_spans(piece, *word_bounds(piece, separators)))
        at = end
    return np.concatenate(parts)


def combine(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1] * PLACES[0]
    for k in range(1, n):
        out = out + words[k : len(words) - n + 1 + k] * PLACES[k]
    return mix(out)


def text_blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from the first byte) of consecutive texts.

    A block has one text or at most BLOCK_BYTES bytes; a null text has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, "right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def block_words(
    buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray, fold=None
) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block, and for each text where its words begin and end.

    Words never join across texts, as the separators stand between them.
    """
    if len(offsets) == 2:
        words = hash_words(fold(buf) if fold else buf, separators)
        return words, np.array([0, len(words)])
    folded = fold(buf) if fold else buf
    inside = ~separators[folded]
    begins = np.empty(len(buf) + 1, bool)
    begins[0] = False
    begins[: len(buf)] = inside
    if len(buf):
        begins[1 : len(buf)] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = inside[first]
    stops = np.zeros(len(buf) + 1, bool)
    stops[1:] = inside
    if len(buf):
        stops[1 : len(buf)] &= ~inside[1:]
        last = offsets[1:][offsets[:-1] < offsets[1:]]
        stops[last] = inside[last - 1]
    starts, ends = np.flatnonzero(begins[: len(buf)]), np.flatnonzero(stops)
    return hash_spans(folded, starts, ends), np.searchsorted(starts, offsets)
