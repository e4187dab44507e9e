"""Ranked lexical search: accumulators of short lists inside skipping over long ones.

Documents are cut into blocks, and each block gets inverted lists of the terms that the
queries ask for, written once as a table. Counts over all blocks give the weights. A
search then walks the blocks: of a query's lists in a block the short ones are summed
term at a time into accumulators, which from there on count as one list with one bound.
That list and the long ones are gone through document at a time with upper bounds: a
block, or a list's documents, that cannot reach the k-th best score so far is skipped.
Every task keeps the k best documents of each query, and those are merged.

Scores are whole numbers, so they don't depend on the order of summing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from plumbline.llm.hashing import LOWER, MARKS, block_words, text_blocks
from plumbline.session import keep

K = 20
#: A block is closed at so many documents or list entries.
BLOCK_DOCS = 1 << 11
BLOCK_ENTRIES = 1 << 18
#: Lists of at most this share of a block's documents go into the accumulators.
SHORT_SHARE = 1 / 16
#: Queries are taken in sets of about so many letters; each set is one pass over the documents.
SET_LETTERS = 4_000_000
#: Parts in which a query's best documents are merged before they meet.
MERGE_PARTS = 32


def term_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes of terms, where each row's begin) of consecutive texts.

    Terms are runs of ASCII letters, digits and everything beyond ASCII, A-Z lower-cased,
    told by 64-bit hashes: another term of the corpus passes for one of the queries' with
    a chance of (terms asked) * (terms there are) / 2**64.
    """
    for at, end, buf, offsets in text_blocks(column):
        words, cuts = block_words(buf, offsets, MARKS, lambda b: LOWER[b])
        yield at, end, words, cuts


class _Terms:
    """Looks up many hashes in a sorted list of them."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.hint = np.zeros(1 << 16, bool)
        self.hint[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in words that hold a known term, and the terms' numbers."""
        places = np.flatnonzero(self.hint[(words & np.uint64(0xFFFF)).astype(np.int64)])
        if not len(places):
            return places, places
        number = np.searchsorted(self.hashes, words[places])
        number[number == len(self.hashes)] = 0
        same = self.hashes[number] == words[places]
        return places[same], number[same]


def _block_type(id_type: T.DataType) -> T.StructType:
    """One block: its documents with their lengths, and a list of (doc, tf) per term."""
    return T.StructType(
        [
            T.StructField("doc_ids", T.ArrayType(id_type)),
            T.StructField("lengths", T.ArrayType(T.LongType())),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
            T.StructField("dfs", T.ArrayType(T.IntegerType())),
            T.StructField("docs", T.ArrayType(T.IntegerType())),
            T.StructField("tfs", T.ArrayType(T.LongType())),
        ]
    )


def inverted_blocks(docs: DataFrame, hashes: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents with inverted lists of the terms whose sorted hashes are given."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = _block_type(rows.schema["doc_id"].dataType)
    arrow = to_arrow_schema(schema)

    def closed(ids: list, lengths: list, found: list) -> pa.RecordBatch:
        doc, term, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(term, kind="stable")
        doc, term, tf = doc[order], term[order], tf[order]
        terms, dfs = np.unique(term, return_counts=True)
        row = [ids, np.concatenate(lengths), terms, dfs, doc, tf]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], f.type) for x, f in zip(row, arrow, strict=True)], schema=arrow
        )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Terms(hashes)
        ids, lengths, found, entries = [], [], [], 0
        for batch in batches:
            names = batch.column(0)
            for at, end, words, cuts in term_hashes(batch.column(1)):
                for a in range(at, end, BLOCK_DOCS):
                    b = min(a + BLOCK_DOCS, end)
                    own = cuts[a - at : b - at + 1]
                    places, number = known.find(words[own[0] : own[-1]])
                    doc = np.searchsorted(own, places + own[0], "right") - 1 + len(ids)
                    pair, tf = np.unique(doc * len(hashes) + number, return_counts=True)
                    found.append((pair // len(hashes), pair % len(hashes), tf))
                    ids.extend(names.slice(a, b - a).to_pylist())
                    lengths.append(np.diff(own))
                    entries += len(pair)
                    if len(ids) >= BLOCK_DOCS or entries >= BLOCK_ENTRIES:
                        yield closed(ids, lengths, found)
                        ids, lengths, found, entries = [], [], [], 0
        if ids:
            yield closed(ids, lengths, found)

    return rows.mapInArrow(blocks, schema)


class _Best:
    """The k best documents of one query so far, by score, then id, null ids last."""

    __slots__ = ("k", "scores", "ids", "least")

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids, self.least = k, [], [], 1

    def offer(self, scores: np.ndarray, places: np.ndarray, ids: list) -> None:
        """scores are at least ``least``; ids are looked up by places."""
        if len(scores) > self.k:  # nothing below the k-th of these can stay
            stay = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, places = scores[stay], places[stay]
        rows = list(zip(self.scores, self.ids, strict=True))
        rows += [(s, ids[p]) for s, p in zip(scores.tolist(), places.tolist(), strict=True)]
        rows.sort(key=lambda r: (-r[0], r[1] is None, 0 if r[1] is None else r[1]))
        del rows[self.k :]
        self.scores, self.ids = [s for s, _ in rows], [i for _, i in rows]
        if len(rows) == self.k:
            self.least = self.scores[-1]


class _Block:
    """A block's lists with what each entry is worth before its term's weight."""

    def __init__(self, row: dict, n_docs: int, n_terms: int) -> None:
        self.ids = row["doc_ids"].as_py()
        lengths = row["lengths"].values.to_numpy()
        self.terms = row["terms"].values.to_numpy()
        ends = np.cumsum(row["dfs"].values.to_numpy())
        self.begins, self.ends = ends - row["dfs"].values.to_numpy(), ends
        self.docs = row["docs"].values.to_numpy()
        tf = row["tfs"].values.to_numpy()
        m = 75 + 25 * lengths * n_docs // max(n_terms, 1)
        self.worth = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.docs])
        self.peaks = np.maximum.reduceat(self.worth, self.begins) if len(tf) else tf

    def search(self, numbers: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        """numbers are places in terms; offers every document that may be among the best."""
        begins, ends = self.begins[numbers], self.ends[numbers]
        short = ends - begins <= len(self.ids) * SHORT_SHARE
        score = np.zeros(len(self.ids), np.int64)
        # term at a time: the short lists become one
        for b, e, w in zip(begins[short], ends[short], weights[short], strict=True):
            score[self.docs[b:e]] += w * self.worth[b:e]
        long = np.flatnonzero(~short)
        bounds = weights[long] * self.peaks[numbers[long]]
        order = np.argsort(bounds)
        long, bounds = long[order], bounds[order]
        under = np.cumsum(bounds)  # what all lists up to here can add
        if int(score.max()) + int(bounds.sum()) < best.least:
            return
        # document at a time: lists that can't bring a document in by themselves only add
        adding = int(np.searchsorted(under, best.least, "left"))
        rest = int(under[adding - 1]) if adding else 0
        for i in long[adding:]:
            b, e = begins[i], ends[i]
            score[self.docs[b:e]] += weights[i] * self.worth[b:e]
        alive = np.flatnonzero(score >= max(1, best.least - rest))
        for i, bound in zip(long[:adding][::-1], bounds[:adding][::-1], strict=True):
            if not len(alive):
                return
            own = self.docs[begins[i] : ends[i]]
            at = np.searchsorted(own, alive)
            at[at == len(own)] = 0
            met = own[at] == alive
            score[alive[met]] += weights[i] * self.worth[begins[i] + at[met]]
            rest -= int(bound)
            alive = alive[score[alive] >= best.least - rest]
        alive = alive[score[alive] >= best.least]
        if len(alive):
            best.offer(score[alive], alive, self.ids)


def _found(blocks: DataFrame, queries: list, weights: np.ndarray, n_docs: int, n_terms: int, k: int, item_type) -> DataFrame:
    """(item_no, item_id, doc_id, score): the best documents of each query, task by task.

    queries: (number, id, terms' numbers, how often each is asked).
    """
    id_type = blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("item_no", T.LongType()),
            T.StructField("item_id", item_type),
            T.StructField("doc_id", id_type),
            T.StructField("score", T.LongType()),
        ]
    )
    arrow = to_arrow_schema(schema)
    asked = np.concatenate([q[2] for q in queries])
    worth = np.concatenate([q[3] for q in queries]) * weights[asked]
    cuts = np.cumsum([0, *(len(q[2]) for q in queries)])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                block = _Block({n: batch.column(n)[i] for n in batch.schema.names}, n_docs, n_terms)
                if not len(block.terms):
                    continue
                place = np.full(len(weights), -1)
                place[block.terms] = np.arange(len(block.terms))
                here = place[asked]
                # a list that a block lacks, and a term in every document, add nothing
                bound = np.where((here >= 0) & (worth > 0), worth * block.peaks[here], 0)
                reach = np.add.reduceat(bound, cuts[:-1])
                for q in np.flatnonzero(reach > 0):
                    if reach[q] >= best[q].least:
                        own = slice(cuts[q], cuts[q + 1])
                        use = bound[own] > 0
                        block.search(here[own][use], worth[own][use], best[q])
        rows = [
            {"item_no": q[0], "item_id": q[1], "doc_id": d, "score": s}
            for q, b in zip(queries, best, strict=True)
            for s, d in zip(b.scores, b.ids, strict=True)
        ]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_pylist(rows[a : a + 10_000], arrow)

    return blocks.mapInArrow(search, schema)


def _asked(rows: list) -> tuple[np.ndarray, list]:
    """Sorted hashes of all terms, and of each (number, id, text) its terms' numbers and counts."""
    if not rows:
        return np.zeros(0, np.uint64), []
    words = []
    for at, end, hashes, cuts in term_hashes(pa.array([r[2] for r in rows], pa.string())):
        words += [hashes[cuts[i] : cuts[i + 1]] for i in range(end - at)]
    known = np.unique(np.concatenate(words))
    queries = []
    for (number, name, _), own in zip(rows, words, strict=True):
        if len(own):
            terms, times = np.unique(np.searchsorted(known, own), return_counts=True)
            queries.append((number, name, terms, times))
    return known, queries


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item.

    Only documents with a score above 0 are ranked, equal scores by ascending id, null
    ids last. A null or empty text has no terms: such a document counts neither for the
    number of documents nor for their mean length, such an item has no rows. Every row is
    a document, every row of items an item, so repeated rows rank by themselves. Texts of
    any length are read whole. Empty tables give no rows. Other columns are not looked at.

    Items are taken in sets of about SET_LETTERS letters, by a hash of the id; the driver
    holds one set at a time, and each set is one pass over the documents.
    """
    letters = items.agg(F.sum(F.char_length(query_col))).first()[0] or 0
    sets = 1 + letters // SET_LETTERS
    item_type = items.schema[item_col].dataType
    out = []
    for i in range(sets):
        chosen = items.filter(F.pmod(F.xxhash64(item_col), F.lit(sets)) == i).select(item_col, query_col)
        rows = [(n * sets + i, r[0], r[1]) for n, r in enumerate(chosen.collect())]
        hashes, queries = _asked(rows)
        if not queries:
            continue
        blocks = keep(inverted_blocks(docs, hashes, id_col, text_col))
        count = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
        some = F.size(F.filter("lengths", lambda x: x > 0))
        n_docs, n_terms = blocks.agg(F.sum(some), F.sum(count)).first()
        lists = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select("x.terms", "x.dfs")
        dfs = lists.groupBy("terms").agg(F.sum("dfs").alias("df")).collect()  # a row per term asked
        weights = np.zeros(len(hashes), np.int64)
        for term, df in dfs:
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        out.append(_found(blocks, queries, weights, n_docs or 0, n_terms or 0, k, item_type))
    if not out:
        empty = docs.sparkSession.createDataFrame([], "rank int, score long")
        names = docs.limit(0).select(F.col(id_col).alias("doc_id")), items.limit(0).select(F.col(item_col).alias("item_id"))
        return names[1].join(names[0], F.lit(False)).join(empty, F.lit(False)).select("item_id", "rank", "doc_id", "score")
    found = reduce(DataFrame.union, out).withColumn("part", F.spark_partition_id() % MERGE_PARTS)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_no", "part"], ["item_no"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
