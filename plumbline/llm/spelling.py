"""Spelling variants: words one letter apart, by bitsets over the vocabulary.

Near words are looked for inside groups that share a beginning and an end and differ in
the middle alone. In a group, one bitset per (position, letter) tells which words have
that letter there. A word's letters are read one after the other, and four sets of words
are carried along, 64 words at a time: those without error so far, and those with one
letter replaced, one put in (read from the position after) or one left out (read from
the position before).

One edit in a word of m letters leaves its first half or its last half as it is, so
every word joins the group of its first half and of its last, for its own length and for
the length below, where it may be the longer word. A group that is too large is cut the
same way again, until it fits or its words differ in one or two letters alone: no group
grows with the corpus, and no pair is lost.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import keep

#: Letters: A-Z, a-z, and U+00C0 to U+00FF, as bytes of UTF-8.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){6,}")
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SLIPS = 199
LEAST_LETTERS = 6
LEAST_TIMES = 5
#: A form is so many times as frequent as its variant.
FORM_TIMES = 5
#: Larger groups are cut again.
GROUP_WORDS = 2048
#: Words a task counts before it hands its counts on.
TASK_WORDS = 500_000


def _slipped(word: str, h: int) -> str:
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, with how often they occur.

    With h the crc32 of ``<id>:<run>``, a run whose h is a multiple of SLIPS loses the
    letter at h % length. A null id is written as nothing. Tasks count what they read, so
    a frequent word is a row a task.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))

    def handed(counts: Counter) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"]
        )
        counts.clear()
        return out

    run = re.compile(RUN.pattern.replace(b"6", str(least_letters).encode()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        texts: dict[bytes, str] = {}
        crc32 = zlib.crc32
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                start = crc32(name.as_buffer().to_pybytes() + b":")
                runs = run.findall(text.as_buffer().to_pybytes().translate(LOWER_TABLE))
                for word, n in Counter(runs).items():
                    h = crc32(word, start)
                    if h % SLIPS:
                        known = texts.get(word)
                        if known is None:
                            known = texts[word] = word.decode()
                        counts[known] += n
                    else:
                        known = _slipped(word.decode(), h)
                        if len(known) >= least_letters:
                            counts[known] += n
                if len(counts) > TASK_WORDS:
                    texts.clear()
                    yield handed(counts)
        yield handed(counts)

    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# ---- one group ----------------------------------------------------------------------


class _Sliced:
    """Per (position, letter) a bitset of the words of one group."""

    def __init__(self, words: list[str]) -> None:
        self.sizes = np.array([len(w) for w in words])
        self.width = int(self.sizes.max(initial=0))
        letters = np.zeros((len(words), self.width + 1), np.uint32)
        for i, w in enumerate(words):
            letters[i, : len(w)] = np.frombuffer(w.encode("utf-32-le"), "<u4")
        self.letters = letters
        self.lanes = (len(words) + 63) // 64
        self.slices: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(self.width):
            known, number = np.unique(letters[:, at], return_inverse=True)
            has = np.zeros((len(known), self.lanes * 64), bool)
            has[number, np.arange(len(words))] = True
            has[known == 0] = False  # beyond the word's end
            self.slices.append((known, np.packbits(has, axis=1, bitorder="little").view(np.uint64)))

    def of_size(self, size: int) -> np.ndarray:
        has = np.zeros(self.lanes * 64, bool)
        has[: len(self.sizes)] = self.sizes == size
        return np.packbits(has, bitorder="little").view(np.uint64)

    def having(self, at: int, asked: np.ndarray) -> np.ndarray:
        """For each letter asked, the words that have it at a position."""
        if not 0 <= at < self.width:
            return np.zeros((len(asked), self.lanes), np.uint64)
        known, bits = self.slices[at]
        number = np.searchsorted(known, asked)
        number[number == len(known)] = 0
        return np.where((known[number] == asked)[:, None], bits[number], np.uint64(0))


def near_in_group(words: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of words one edit apart, where a has ``size`` letters.

    The words have ``size`` letters or one more, and each stands there once.
    """
    sliced = _Sliced(words)
    asking = np.flatnonzero(sliced.sizes == size)
    same, longer = sliced.of_size(size), sliced.of_size(size + 1)
    step = max(1, (1 << 21) // sliced.lanes)
    for a in range(0, len(asking), step):
        rows = asking[a : a + step]
        none = np.full((len(rows), sliced.lanes), ~np.uint64(0))
        replaced = np.zeros_like(none)
        put_in = np.zeros_like(none)
        for at in range(size):
            asked = sliced.letters[rows, at]
            here = sliced.having(at, asked)
            after = sliced.having(at + 1, asked)
            # put_in: the word asked about has one letter more, so it is read one further on
            put_in = (put_in | none) & after
            replaced = (replaced & here) | (none & ~here)
            none &= here
        put_in |= none  # the letter more may be the last
        found = (replaced & same) | (put_in & longer)
        bits = np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")
        who, whom = np.nonzero(bits)
        yield rows[who], whom


# ---- groups -------------------------------------------------------------------------

#: A word of a group: m letters are the shorter words' length, left and right what all share.
GROUP = ["m", "left", "right"]


def _cut(rows: DataFrame) -> DataFrame:
    """Words of groups that are cut once more: each goes to two groups."""
    middle = F.col("m") - F.char_length("left") - F.char_length("right")
    own = F.expr("substring(word, char_length(left) + 1, char_length(word) - char_length(left) - char_length(right))")
    rows = rows.withColumns({"half": (middle / 2).cast("int"), "mid": own, "size": middle})
    begin = F.concat("left", F.expr("substring(mid, 1, half)"))
    end = F.concat(F.expr("right(mid, size - half)"), F.col("right"))
    first = rows.select("word", "n", "m", begin.alias("left"), "right")
    last = rows.select("word", "n", "m", "left", end.alias("right"))
    return first.union(last)


def groups(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(word, n, m, left, right): the groups in which all near words meet."""
    lengths = F.array(F.char_length("word"), F.char_length("word") - 1)
    rows = words.select("word", "n", F.explode(lengths).alias("m"), F.lit("").alias("left"), F.lit("").alias("right"))
    rows = keep(_cut(rows))
    out = []
    while True:
        middle = F.col("m") - F.char_length("left") - F.char_length("right")
        sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("words"), F.count_if(F.char_length("word") == F.col("m")).alias("shorter"))
        large = keep(sizes.filter((F.col("words") > most) & (middle > 1)).select(*GROUP))
        if not large.limit(1).count():
            out.append(rows)
            return reduce(DataFrame.unionByName, out)
        out.append(rows.join(large, GROUP, "left_anti"))
        rows = keep(_cut(rows.join(large, GROUP, "left_semi")))


def near_words(words: DataFrame, most: int = GROUP_WORDS) -> DataFrame:
    """(word, near, near_n): both ways, each once, of distinct words one edit apart."""
    rows = groups(words, most).repartition(*GROUP).sortWithinPartitions(*GROUP)

    def ended(group: tuple, members: list) -> Iterator[pa.RecordBatch]:
        m, left, right = group
        if len(members) < 2 or all(len(w) > m for w, _ in members):
            return
        words, times = [w for w, _ in members], np.array([n for _, n in members])
        inner = [w[len(left) : len(w) - len(right)] for w in words]
        texts = pa.array(words, pa.string())
        for a, b in near_in_group(inner, m - len(left) - len(right)):
            if len(a):
                # words of one length find each other, a longer one is found from the shorter
                one_way = np.array([len(words[i]) for i in b.tolist()]) > m
                who = np.concatenate([a, b[one_way]])
                whom = np.concatenate([b, a[one_way]])
                yield pa.RecordBatch.from_arrays(
                    [texts.take(pa.array(who)), texts.take(pa.array(whom)), pa.array(times[whom], pa.int64())],
                    ["word", "near", "near_n"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in (*GROUP, "word", "n")]
            for *key, word, n in zip(*columns, strict=True):
                if key != group:
                    if group is not None:
                        yield from ended(group, members)
                    group, members = key, []
                members.append((word, n))
        if group is not None:
            yield from ended(group, members)

    pairs = rows.mapInArrow(search, "word string, near string, near_n long")
    return pairs.groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


# ---- forms --------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms are followed to the last, in doubling steps."""
    steps = keep(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = steps.join(ahead, "root", "left")
        moved = keep(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        steps = moved.select("word", "root")
        if not moved.filter("moved").limit(1).count():
            return steps


def variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_letters: int = LEAST_LETTERS,
    least_times: int = LEAST_TIMES,
    most: int = GROUP_WORDS,
) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word frequent and long enough.

    Words are the letter runs of whole texts, counted over all rows; repeated rows count
    as often as they are there, null and empty texts have none, an empty table gives no
    rows. A run may be of any length. n_near counts the words one edit apart; form is the
    one of them with the largest n, of equal ones the first in code-point order, if it is
    at least FORM_TIMES as frequent as the word, else null. root is the last form after
    form, the word itself if it has none. Other columns are not looked at.
    """
    counted = word_counts(docs, id_col, text_col, least_letters)
    words = keep(counted.filter(F.col("n") >= least_times))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near, "word", "left")
    found = F.coalesce(-F.col("best.less") >= FORM_TIMES * F.col("n"), F.lit(False))
    told = keep(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(found, F.col("best.near")).alias("form"),
            F.when(found, -F.col("best.less")).alias("form_n"),
        )
    )
    last = roots(told.filter("form is not null"))
    return told.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
