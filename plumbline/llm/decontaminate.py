"""Benchmark passages in documents by CGK embeddings and bit-sampling LSH.

Texts are words: runs of letters and digits, lower case; in scripts that don't put spaces
between words every character is one. A document is contaminated by
an item of w words if one of its windows is within ``max_edits`` of w word edits of the
item (insertions, deletions, substitutions). Windows have w words, or up to ``spread`` of
w more or less; with ``spread`` equal to ``max_edits`` that is every run of words that can
be close, so that the edits are those of the best substring. Items of fewer than
``min_words`` words are met by chance if edits are allowed, and are looked for word by word.

The CGK random walk copies a window's words to 3w places, and advances or not by a random
bit of the word; few edits then mean few differing places. A table of the LSH samples some
places of one walk as its key; there are as many tables as it takes for an item with
all its edits to be met with the target recall, which is measured on edited items. Pairs
that agree in a table are verified by exact edit distance.

The walk takes w words from a window's first one, however long the window; beyond the
text's end they are zeros. A pair that meets is verified against all lengths at once.

Windows are taken everywhere in whole texts, but those that can't be close are left out
before the walk by exact bounds: a window within d edits of an item shares at least w - 1 - 2d
of its pairs of neighbouring words, and its first w words have at most d distinct words less.

Items are a stated query set: they are read in blocks of ``BLOCK_ITEMS``, each block is
one pass over the documents, and only a block is on the driver and in a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.hashing import MARKS, U64, block_words, combine, fold_case, mix, text_blocks

#: Edits as a share of the item's words.
MAX_EDITS = 0.2
#: Items of fewer words are looked for without edits.
MIN_WORDS = 8
#: A character of a script that is written without spaces between words.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"
BLOCK_ITEMS = 5000
#: Places sampled for a key, most tables, and the share of edited items to be met.
SAMPLED, MOST_TABLES, RECALL = 3, 1024, 0.99
TRIALS = 300
#: Windows, or pairs of a window and an item, that are worked on at once.
AT_ONCE = 20_000


def spaced(column: pa.Array) -> pa.Array:
    """The texts, with spaces around the characters of unspaced scripts."""
    column = column.cast(pa.large_string())
    some = pc.fill_null(pc.match_substring_regex(column, UNSPACED), False)
    if not pc.any(some).as_py():
        return column
    return pc.replace_with_mask(column, some, pc.replace_substring_regex(column.filter(some), UNSPACED, r" \1 "))


def words_of(text: str) -> np.ndarray:
    buf = np.frombuffer(spaced(pa.array([text], pa.large_string()))[0].as_py().encode(), np.uint8)
    return block_words(buf, np.array([0, len(buf)]), MARKS, fold_case)[0]


def edits_allowed(w: int, share: float) -> int:
    return int(w * share + 1e-9)


def edit_distances(a: np.ndarray, b: np.ndarray, w: np.ndarray, spread: float = 0.0) -> np.ndarray:
    """Word edits between the first w words of rows of a and of b.

    With spread the least over that share of w words more or less of b.
    """
    n, width = a.shape
    steps = np.arange(b.shape[1] + 1)
    row = np.repeat(steps[None, :], n, axis=0)
    out = np.zeros(n, np.int64)
    new = np.empty_like(row)
    for i in range(width):
        # substitution or deletion, then insertions as a running minimum
        new[:, 0] = i + 1
        np.minimum(row[:, :-1] + (b != a[:, i : i + 1]), row[:, 1:] + 1, out=new[:, 1:])
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        done = np.flatnonzero(w == i + 1)
        some = edits_allowed(i + 1, spread)
        out[done] = row[done, i + 1 - some : i + 2 + some].min(axis=1)
    return out


def sampled_places(w: np.ndarray, table: int) -> np.ndarray:
    """Ascending places of a table's key for windows of w words.

    The same shares of 2w steps for every w, in which a walk takes in its words.
    """
    shares = np.sort(np.random.default_rng([5, table]).random(SAMPLED))
    return (shares[None, :] * 2 * w[:, None]).astype(np.int64)


def table_keys(windows: np.ndarray, w: np.ndarray, table: int) -> np.ndarray:
    """A key for each row of windows: its CGK walk at the sampled places.

    Steps are the high bits of the word hash times a number of the table's, a new one
    every 32 steps; a window that is used up goes on as zeros.
    """
    n = len(windows)
    places = sampled_places(w, table)
    rows, at, key = np.arange(n), np.zeros(n, np.int64), w.astype(U64)
    last = int(places.max(initial=-1))
    salts = mix(np.arange(1, last // 32 + 2, dtype=U64) + U64(table << 16)) | U64(1)
    for step in range(last + 1):
        if step % 32 == 0:
            salted = windows * salts[step // 32]
        current = salted[rows, np.minimum(at, w - 1)]
        current[at >= w] = 0
        for k in range(SAMPLED):
            here = np.flatnonzero(places[:, k] == step)
            key[here] = mix(key[here] * U64(0x9E3779B97F4A7C15) + current[here])
        at += (current >> U64(63 - step % 32) & U64(1)).astype(np.int64)
    return key


def edited(words: np.ndarray, n: int, draw: np.random.Generator) -> np.ndarray:
    """words after n random edits."""
    out = list(words)
    for _ in range(n):
        kind, at = draw.integers(3), int(draw.integers(max(1, len(out))))
        new = U64(draw.integers(1, 2**63))
        if kind == 0:
            out.insert(at, new)
        elif kind == 1 and len(out) > 1:
            del out[at]
        elif out:
            out[at] = new
    return np.array(out, U64)


def padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    w = np.array([len(x) for x in texts], np.int64)
    out = np.zeros((len(texts), int(w.max(initial=1))), U64)
    for i, x in enumerate(texts):
        out[i, : len(x)] = x
    return out, w


def tables_needed(items: list[np.ndarray], share: float, recall: float) -> int:
    """Tables until items with all their edits meet the originals, on random trials."""
    draw = np.random.default_rng(11)
    ours, others = [], []
    for _ in range(TRIALS):
        item = items[int(draw.integers(len(items)))]
        other = edited(item, edits_allowed(len(item), share), draw)
        ours.append(item)
        others.append(np.concatenate([other, np.arange(len(item), dtype=U64)])[: len(item)])
    a, w = padded(ours)
    b, _ = padded(others)
    met = np.zeros(TRIALS, bool)
    for table in range(MOST_TABLES):
        met |= table_keys(a, w, table) == table_keys(b, w, table)
        if met.mean() >= recall:
            return table + 1
    raise ValueError(f"{MOST_TABLES} tables find {met.mean():.3f} of the edited items, not {recall}")


def distinct_words(windows: np.ndarray) -> np.ndarray:
    rows = np.sort(windows, axis=1)
    return 1 + (rows[:, 1:] != rows[:, :-1]).sum(1)


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each entry, size numbers each, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


class Searcher:
    """A block of items, ready to be looked for in texts; short ones are looked for word by word."""

    def __init__(
        self,
        items: list[tuple[object, np.ndarray]],
        share: float,
        recall: float,
        spread: float = 0.0,
        short: list[tuple[object, np.ndarray]] = (),
    ) -> None:
        self.share, self.spread = share, spread
        self.ids = [i for i, _ in items]
        self.names = self.ids + [i for i, _ in short]
        self.sizes = [len(x) for _, x in (*items, *short)]
        self.short = []
        for n in sorted({len(x) for _, x in short}):
            own = np.array([len(items) + m for m, (_, x) in enumerate(short) if len(x) == n], np.int64)
            keys = np.array([combine(short[m - len(items)][1], n)[0] for m in own.tolist()], U64)
            order = np.argsort(keys, kind="stable")
            self.short.append((n, keys[order], own[order]))
        self.words, self.w = padded([x for _, x in items])
        self.most = np.array([edits_allowed(w, share) for w in self.w.tolist()])
        self.longest = self.w + np.array([edits_allowed(w, spread) for w in self.w.tolist()])
        self.tables = []
        for table in range(tables_needed([x for _, x in items], share, recall) if items else 0):
            keys = table_keys(self.words, self.w, table)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))
        pairs: dict[int, set[int]] = {}
        for m, (_, x) in enumerate(items):
            for p in combine(x, 2).tolist():
                pairs.setdefault(p, set()).add(m)
        self.pairs = np.array(sorted(pairs), U64)
        self.owners = np.array([m for p in self.pairs.tolist() for m in sorted(pairs[p])], np.int64)
        self.first_owner = np.append(0, np.cumsum([len(pairs[p]) for p in self.pairs.tolist()]))
        self.least = np.maximum(1, self.w - 1 - 2 * self.most)
        # an edit takes away at most one of the distinct words
        self.varied: dict[int, int] = {}
        for (_, x), most in zip(items, self.most.tolist(), strict=True):
            own = len(set(x.tolist())) - most
            self.varied[len(x)] = min(own, self.varied.get(len(x), own))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.pairs >> U64(44)).astype(np.int64)] = True

    def windows(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(w, starts): windows for items of w words that share enough neighbours with one."""
        found = combine(words, 2)
        at = np.flatnonzero(self.maybe[(found >> U64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.pairs, found[at]), len(self.pairs) - 1)
        same = self.pairs[place] == found[at]
        at, place = at[same], place[same]
        times = self.first_owner[place + 1] - self.first_owner[place]
        item = self.owners[_ranges(self.first_owner[place], times)]
        at = np.repeat(at, times)
        order = np.argsort(item, kind="stable")
        item, at = item[order], at[order]
        # from the i-th hit of an item to the one that makes enough of them
        i = np.arange(len(item))
        j = np.minimum(i + self.least[item] - 1, len(item) - 1)
        enough = (j - i == self.least[item] - 1) & (item[j] == item)
        near = np.flatnonzero(enough & (at[j] - at <= self.longest[item] - 2))
        # a window of n words from s holds pairs s .. s + n - 2
        w = self.w[item[near]]
        low = np.maximum(at[j[near]] - (self.longest[item[near]] - 2), 0)
        size = at[near] - low + 1
        named = np.unique(np.repeat(w, size) * (len(words) + 1) + _ranges(low, size))
        sizes, starts = named // (len(words) + 1), named % (len(words) + 1)
        text = np.searchsorted(bounds, starts, "right") - 1
        left = bounds[np.minimum(text + 1, len(bounds) - 1)] - starts
        for size in np.unique(sizes).tolist():
            yield size, starts[(sizes == size) & (left >= size - edits_allowed(size, self.spread))]

    def exact(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, item, first word) of the first place of each short item in a text."""
        for n, keys, own in self.short:
            found = combine(words, n)
            low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
            hit = np.flatnonzero(high > low)
            text = np.searchsorted(bounds, hit, "right") - 1
            inside = hit + n <= bounds[text + 1]
            hit, text = hit[inside], text[inside]
            times = high[hit] - low[hit]
            item, at, text = own[_ranges(low[hit], times)], np.repeat(hit, times), np.repeat(text, times)
            _, first = np.unique(text * len(self.names) + item, return_index=True)
            yield from zip(text[first].tolist(), item[first].tolist(), (at - bounds[text])[first].tolist(), strict=True)

    def met(self, windows: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (window, item) that agree in a table; w ascends."""
        out = [np.zeros(0, np.int64)]
        n = len(self.ids)
        # windows of like size walk together
        cuts = [0]
        while cuts[-1] < len(w):
            cuts.append(int(np.searchsorted(w, w[cuts[-1]] * 5 // 4, "right")))
        for a, b in zip(cuts, cuts[1:], strict=False):
            part, sizes = windows[a:b, : w[b - 1]], w[a:b]
            for table, (keys, order) in enumerate(self.tables):
                own = table_keys(part, sizes, table)
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, "right")
                hit = np.flatnonzero(high > low)
                times = high[hit] - low[hit]
                offset = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                out.append(np.repeat(a + hit, times) * n + order[np.repeat(low[hit], times) + offset])
        pairs = np.unique(np.concatenate(out))
        return pairs // n, pairs % n

    def search(self, column: pa.Array) -> dict[tuple[int, int], tuple[int, int]]:
        """(row, item) -> (edits, first word of the window), the least of them."""
        best: dict[tuple[int, int], tuple[int, int]] = {}
        waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for first, _, buf, offsets in text_blocks(spaced(column)):
            words, bounds = block_words(buf, offsets, MARKS, fold_case)
            for text, m, start in self.exact(words, bounds):
                best[first + text, m] = (0, start)
            if len(words) < 2 or not self.ids:
                continue
            for w, starts in self.windows(words, bounds):
                for part in np.array_split(starts, -(-len(starts) // AT_ONCE) or 1):
                    text = np.searchsorted(bounds, part, "right") - 1
                    places = part[:, None] + np.arange(w + edits_allowed(w, self.spread))
                    windows = words[np.minimum(places, len(words) - 1)]
                    windows[places >= bounds[text + 1][:, None]] = 0
                    varied = distinct_words(windows[:, :w]) >= self.varied[w]
                    windows, part, text = windows[varied], part[varied], text[varied]
                    waiting.append((w, windows, first + text, part - bounds[text]))
                    size += len(part)
                    if size >= AT_ONCE:
                        self._verify(waiting, best)
                        waiting, size = [], 0
        self._verify(waiting, best)
        return best

    def _verify(self, waiting: list, best: dict[tuple[int, int], tuple[int, int]]) -> None:
        waiting = [x for x in waiting if len(x[1])]
        if not waiting:
            return
        waiting = sorted(waiting, key=lambda x: x[0])
        w = np.concatenate([np.full(len(x), size) for size, x, _, _ in waiting])
        windows = np.zeros((len(w), int(self.longest.max())), U64)
        at = 0
        for _, x, _, _ in waiting:
            windows[at : at + len(x), : x.shape[1]] = x
            at += len(x)
        rows = np.concatenate([r for _, _, r, _ in waiting])
        starts = np.concatenate([s for _, _, _, s in waiting])
        window, item = self.met(windows, w)
        same = w[window] == self.w[item]
        window, item = window[same], item[same]
        for low in range(0, len(window), AT_ONCE):
            x, m = window[low : low + AT_ONCE], item[low : low + AT_ONCE]
            edits = edit_distances(self.words[m], windows[x], self.w[m], self.spread)
            for k in np.flatnonzero(edits <= self.most[m]).tolist():
                name, found = (int(rows[x[k]]), int(m[k])), (int(edits[k]), int(starts[x[k]]))
                best[name] = min(best.get(name, found), found)


def item_blocks(items: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about ``block`` rows, each collected by itself."""
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    n = -(-rows.count() // block)
    for i in range(n):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i) if n > 1 else rows
        yield [(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()]


def matches(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_edits: float = MAX_EDITS,
    recall: float = RECALL,
    min_words: int = MIN_WORDS,
    block: int = BLOCK_ITEMS,
    spread: float = 0.0,
) -> DataFrame:
    """One row per document and item found in it: doc_id, text_key, item_id, n_words, edits, first_word.

    edits is the least over the windows that were met, first_word where the first such
    window begins. Windows may be ``spread`` of an item's words longer or shorter than it. Null texts are empty and hold nothing; null items, and items
    without words, aren't looked for; of repeated items one is. Items of fewer than
    ``min_words`` words are found without edits only. Repeated rows
    of docs come out as often as they went in. text_key is a hash of the text. Other
    columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("text_key", T.LongType()),
            T.StructField("item_id", items.schema[item_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("edits", T.LongType()),
            T.StructField("first_word", T.LongType()),
        ]
    )
    arrow_schema = to_arrow_schema(schema)
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)
    for part in item_blocks(items, item_col, item_text_col, block):
        known = [(i, w) for i, w in ((i, words_of(t)) for i, t in part) if len(w)]
        if known:
            long, short = ([x for x in known if (len(x[1]) >= min_words) == k] for k in (True, False))
            searcher = Searcher(long, max_edits, recall, spread, short)
            out = out.union(rows.mapInArrow(_finder(searcher, arrow_schema), schema))
    return out


def _finder(searcher: Searcher, arrow_schema: pa.Schema):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                {
                    "doc_id": batch.column(0)[row].as_py(),
                    "text_key": batch.column(1)[row].as_py(),
                    "item_id": searcher.names[m],
                    "n_words": searcher.sizes[m],
                    "edits": edits,
                    "first_word": at,
                }
                for (row, m), (edits, at) in sorted(searcher.search(batch.column(2)).items())
            ]
            yield pa.RecordBatch.from_pylist(found, arrow_schema)

    return find


def without_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs in which no item is found, all columns as they were."""
    found = matches(docs, items, id_col, text_col, **options)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    bad = found.select(name.alias("__name"), F.col("text_key").alias("__text")).distinct()
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.withColumns({"__name": named, "__text": text})
    return rows.join(bad, ["__name", "__text"], "left_anti").drop("__name", "__text")
