"""Toxicity by weak supervision: voters, a label model, and a linear classifier.

Voters are lexicons and patterns. Two lexicons are fixed; the others are found among the
words and word beginnings of labelled texts, those that reach some share of the words in
far more toxic texts than others, and are grouped by the length of the beginning. A generative model of two classes takes every
document's votes, estimates how often each voter fires in either class, and where voters
depend on one another given the class it models them together. A logistic regression on
the terms themselves is then fitted to the posteriors of that model.

Votes of all documents are counted by pattern, of which there are at most 2**9. Labels
are read from a bounded sample that holds no held-out row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.components import components
from plumbline.llm.hashing import (
    BYTE_VALUES, MARKS, U64, block_words, combine, fold_case, mix, powers_of, text_blocks,
)
from plumbline.llm.near_dups import shingle_set
from plumbline.llm.quality import held_out
from plumbline.session import keep

INSULTS = (
    "idiot idiots moron morons loser losers stupid dumb fool fools imbecile clown clowns "
    "pathetic worthless useless trash garbage scum jerk creep coward"
)
ABUSE = (
    "disgusting vile filthy filth pig pigs vermin parasite freak bastard bitch whore slut "
    "damn fuck fucking shit crap asshole bullshit retard retarded degenerate hate despise"
)
#: Bytes of a long text that are looked at together.
PIECE_BYTES = 1 << 21
#: Bytes of the word beginnings that are looked at; 0 is the whole word.
LENGTHS = (0, 4, 5, 6, 7, 8)
#: A term's share of a text's words is told apart by whether it reaches these; 0 is any.
SHARES = (1 / 64, 1 / 128, 1 / 256, 0.0)
#: Most labelled texts of each class that terms are sought in, drawn by a hash of their ids.
SAMPLE = 3000
#: A found term is in so many toxic texts, and so many times likelier there even if the
#: count of them were so many standard deviations lower.
LEAST_TEXTS, LEAST_LIFT, DEVIATIONS = 3, 30.0, 2.0
#: Near copies share all least hashes of one of so many bands: 95 % of texts with three
#: quarters of their word 5-grams in common do, and 3 % of those with a quarter.
BANDS, BAND_HASHES = 8, 4
#: Most rows with, and without, any vote that the classifier is fitted to, by a hash of ids.
FIT_ROWS = 8000
THRESHOLD = 0.3
VOTERS = ("insults", "abuse", "words", "stem4", "stem5", "stem6", "dense", "shouting", "exclaims")
DEPENDENT, ROUNDS = 0.3, 40


def terms(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, length index, hash) of every word and word beginning of a block of texts."""
    folded = fold_case(buf)
    starts, ends = _bounds(folded, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(U64)
    up, down = powers_of(len(buf))
    total = np.zeros(len(buf) + 1, U64)
    np.cumsum(BYTE_VALUES[folded] * up[: len(buf)], out=total[1:])
    text = np.searchsorted(offsets, starts, "right") - 1
    out = []
    for i, n in enumerate(LENGTHS):
        at = np.arange(len(starts)) if n == 0 else np.flatnonzero(ends - starts > n)
        stop = ends[at] if n == 0 else starts[at] + n
        found = mix((total[stop] - total[starts[at]]) * down[starts[at]] + U64(i + 1))
        out.append((text[at], np.full(len(at), i), found))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _bounds(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of a block, cut where one text ends and another begins."""
    inside = np.zeros(len(folded) + 2, bool)
    inside[1:-1] = ~MARKS[folded]
    begins = inside[1:] & ~inside[:-1]
    stops = ~inside[1:] & inside[:-1]
    cuts = offsets[1:-1]
    joint = cuts[inside[cuts] & inside[cuts + 1]] if len(folded) else cuts[:0]
    begins[joint] = stops[joint] = True
    return np.flatnonzero(begins), np.flatnonzero(stops)


def _pieces(buf: np.ndarray) -> list[tuple[int, int]]:
    """A block as it is, or one long text cut where marks stand."""
    out, at = [], 0
    while len(buf) - at > PIECE_BYTES:
        gaps = np.flatnonzero(MARKS[buf[at : at + PIECE_BYTES]])
        end = at + (int(gaps[-1]) + 1 if len(gaps) else PIECE_BYTES)
        out.append((at, end))
        at = end
    return [*out, (at, len(buf))]


def term_levels(buf: np.ndarray, offsets: np.ndarray, wanted=None) -> tuple[np.ndarray, ...]:
    """Distinct (text, length index, hash) of a block, with the first of SHARES each reaches.

    A text longer than a block is cut between words; of it, only wanted terms are held.
    """
    words = np.zeros(len(offsets) - 1, np.int64)
    parts = []
    for a, b in _pieces(buf):
        text, length, found = terms(buf[a:b], offsets if (a, b) == (0, len(buf)) else np.array([0, b - a]))
        words += np.bincount(text[length == 0], minlength=len(words))
        if wanted is not None:
            known = wanted(found)
            text, length, found = text[known], length[known], found[known]
        parts.append((text, length, found))
    text, length, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((found, length, text))
    text, length, found = text[order], length[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (length[1:] != length[:-1]) | (found[1:] != found[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(text)))
    text, length, found = text[first], length[first], found[first]
    share = counts / np.maximum(words[text], 1)
    level = (share[:, None] < np.array(SHARES[:-1])).sum(1)
    return text, length, found, level


def term_hash(word: str) -> int:
    """The whole-word hash of a lexicon entry."""
    buf = np.frombuffer(word.encode(), np.uint8)
    return int(terms(buf, np.array([0, len(buf)]))[2][0])


# ---- finding terms, on a bounded sample ---------------------------------------------


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """At most ``most`` labelled texts of each class that aren't held out: (doc_id, text, label)."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    known = known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    drawn = known.filter("label = 1").orderBy(*order).limit(most).union(
        known.filter("label <> 1").orderBy(*order).limit(most)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # at most 2 * most rows of two numbers are sent to every task
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label")
    return found.agg(F.min("text").alias("text"))


def signatures(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text of a block: least hashes of its word 5-grams by band; 0 without words."""
    words, bounds = block_words(buf, offsets, MARKS, fold_case)
    salts = mix(np.arange(1, BANDS * BAND_HASHES + 1, dtype=U64)) | U64(1)
    out = np.zeros((len(offsets) - 1, BANDS), U64)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if a < b:
            found = shingle_set(words[a:b])
            least = np.array([mix(found * x).min() for x in salts], U64).reshape(BANDS, BAND_HASHES)
            out[i] = [combine(x, BAND_HASHES)[0] for x in least + np.arange(BANDS, dtype=U64)[:, None]]
    return out


def text_keys(signature: np.ndarray) -> np.ndarray:
    return np.array([combine(x, BANDS)[0] for x in signature], U64).view(np.int64)


def near_copies(sample: DataFrame) -> DataFrame:
    """(node, root): keys of texts that have near copies, and the least key of their family."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offsets in text_blocks(batch.column(0)):
                signature = signatures(buf, offsets)
                keys = np.repeat(text_keys(signature), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(signature.ravel().view(np.int64))], names=["key", "band"]
                )

    bands = keep(sample.select("text").mapInArrow(each, "key long, band long"))
    least = bands.groupBy("band").agg(F.min("key").alias("v"), F.max("key").alias("most")).filter("v < most")
    # a sample's bands are bounded
    return components(bands.join(F.broadcast(least), "band").select(F.col("key").alias("u"), "v"))


def found_terms(sample: DataFrame) -> list[Row]:
    """(length, term) that set toxic texts apart; near copies of a text count once.

    Texts are near copies if a band of their signatures is equal, or a chain of such texts ties them.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(1).to_numpy(zero_copy_only=False)
            for first, _, buf, offsets in text_blocks(batch.column(0)):
                text, length, found, level = term_levels(buf, offsets)
                family = text_keys(signatures(buf, offsets))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(family[text]),
                        pa.array(labels[first + text].astype(np.int32)),
                        pa.array(length.astype(np.int32)),
                        pa.array(found.view(np.int64)),
                        pa.array(level.astype(np.int32)),
                    ],
                    names=["family", "label", "length", "term", "level"],
                )

    rows = sample.select("text", "label").mapInArrow(
        each, "family long, label int, length int, term long, level int"
    )
    same = ["label", "length", "term"]
    rows = rows.groupBy("family", *same).agg(F.min("level").alias("level"))
    copies = F.broadcast(near_copies(sample).withColumnRenamed("node", "family"))
    rows = rows.join(copies, "family", "left").withColumn("family", F.coalesce("root", "family"))
    rows = keep(rows.groupBy("family", *same).agg(F.min("level").alias("level")))
    sizes = rows.select("family", "label").distinct().groupBy("label").count().collect()
    bad = sum(r["count"] for r in sizes if r["label"] == 1)
    good = sum(r["count"] for r in sizes if r["label"] != 1)
    reached = F.explode(F.sequence("level", F.lit(len(SHARES) - 1))).alias("level")
    # a share reached by a rare term says nothing yet: whole terms first
    often = rows.filter("label = 1").groupBy("length", "term").count()
    often = often.filter(F.col("count") >= LEAST_TEXTS).select("length", "term")
    counts = (
        rows.join(often, ["length", "term"], "left_semi")
        .select("length", "term", "label", reached)
        .groupBy("length", "term", "level")
        .agg(
            F.count_if(F.col("label") == 1).alias("in_bad"),
            F.count_if(F.col("label") != 1).alias("in_good"),
        )
    )
    surely = F.col("in_bad") - DEVIATIONS * F.sqrt("in_bad")
    lift = (surely + 0.5) / (bad + 1) / ((F.col("in_good") + 0.5) / (good + 1))
    found = counts.filter((F.col("in_bad") >= LEAST_TEXTS) & (lift >= LEAST_LIFT))
    return found.select("length", "term", "level").orderBy("length", "term", "level").collect()


def _count(on: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are on."""
    if len(offsets) == 2:
        return np.array([np.count_nonzero(on)])
    total = np.append(0, np.cumsum(on, dtype=np.int64))
    return total[offsets[1:]] - total[offsets[:-1]]


class Vocabulary:
    """Features, each a term that reaches a share, and the voters they belong to."""

    def __init__(self, found: list[Row]) -> None:
        last = len(SHARES) - 1
        voter = {0: 2, 4: 3, 5: 4, 6: 5, 7: 5, 8: 5}
        listed = {(r["term"] % 2**64, r["level"]): voter[LENGTHS[r["length"]]] for r in found}
        fixed = {(term_hash(w), last): g for g, words in enumerate((INSULTS, ABUSE)) for w in words.split()}
        places = sorted(listed | fixed)
        self.size = len(places)
        self.hashes = np.array(sorted({h for h, _ in places}), U64)
        self.feature = np.full((len(self.hashes), len(SHARES)), -1)
        self.bits = np.zeros(self.size, np.int64)
        for i, (h, level) in enumerate(places):
            self.feature[np.searchsorted(self.hashes, U64(h)), level] = i
            if (h, level) in fixed:
                self.bits[i] |= 1 << fixed[h, level]
            if (h, level) in listed:
                self.bits[i] |= 1 << listed[h, level]
            if level <= 1:
                self.bits[i] |= 1 << 6
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.hashes >> U64(48)).astype(np.int64)] = True

    def _place(self, found: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)

    def _known(self, found: np.ndarray) -> np.ndarray:
        likely = np.flatnonzero(self.maybe[(found >> U64(48)).astype(np.int64)])
        return likely[self.hashes[self._place(found[likely])] == found[likely]]

    def hits(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature) of a block, ordered."""
        text, _, found, level = term_levels(buf, offsets, self._known)
        features = self.feature[self._place(found)] if len(found) else self.feature[:0]
        on = (features >= 0) & (np.arange(len(SHARES)) >= level[:, None])
        row, column = np.nonzero(on)
        pairs = np.unique(text[row] * self.size + features[row, column])
        return pairs // self.size, pairs % self.size

    def votes(self, buf: np.ndarray, offsets: np.ndarray, text: np.ndarray, feature: np.ndarray) -> np.ndarray:
        """A number per text whose bit v says that voter v fires."""
        n = len(offsets) - 1
        out = np.zeros(n, np.int64)
        np.bitwise_or.at(out, text, self.bits[feature])
        upper = _count((buf >= 65) & (buf <= 90), offsets)
        lower = _count((buf >= 97) & (buf <= 122), offsets)
        marks = _count(buf == 33, offsets)
        out |= ((upper >= 20) & (upper * 3 >= lower * 2)).astype(np.int64) << 7
        return out | (marks >= 3).astype(np.int64) << 8


# ---- the label model ------------------------------------------------------------------


class LabelModel:
    """Two classes, voters that fire with a chance each, dependent ones modelled jointly.

    counts has (votes, label or null, n); rows whose label is known keep it.
    """

    def __init__(self, counts: list[Row]) -> None:
        self.patterns = np.array(sorted({r["votes"] for r in counts}), np.int64)
        place = {int(p): i for i, p in enumerate(self.patterns)}
        free, known = np.zeros(len(place)), np.zeros((2, len(place)))
        for r in counts:
            if r["label"] is None:
                free[place[r["votes"]]] += r["n"]
            else:
                known[int(r["label"] == 1), place[r["votes"]]] += r["n"]
        self.bits = (self.patterns[:, None] >> np.arange(len(VOTERS))) & 1
        # begins with the labelled share of each pattern, or a guess by its votes
        guess = 1 / (1 + np.exp(-(2.0 * self.bits[:, :7].sum(1) - 3)))
        self.posterior = (known[1] + guess) / (known.sum(0) + 1)
        groups = [[v] for v in range(len(VOTERS))]
        for r in range(ROUNDS):
            weight = np.stack([known[0] + free * (1 - self.posterior), known[1] + free * self.posterior])
            if r == ROUNDS // 2:
                groups = self._dependent(weight)
            self.posterior = self._expect(weight, groups)
        self.groups = groups

    def _dependent(self, weight: np.ndarray) -> list[list[int]]:
        """Voters tied by a correlation within a class, in groups."""
        root = list(range(len(VOTERS)))
        for w in weight:
            w = w / max(w.sum(), 1e-9)
            mean = w @ self.bits
            cov = (self.bits * w[:, None]).T @ self.bits - np.outer(mean, mean)
            spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            tied = np.abs(cov / np.outer(spread, spread)) > DEPENDENT
            for i, j in zip(*np.nonzero(np.triu(tied, 1)), strict=True):
                old, new = root[j], root[i]
                root = [new if x == old else x for x in root]
        return [[v for v in range(len(VOTERS)) if root[v] == g] for g in sorted(set(root))]

    def _expect(self, weight: np.ndarray, groups: list[list[int]]) -> np.ndarray:
        odds = np.log((weight[1].sum() + 1) / (weight[0].sum() + 1))
        out = np.full(len(self.patterns), odds)
        for group in groups:
            joint = (self.bits[:, group] << np.arange(len(group))).sum(1)
            for c, sign in ((1, 1), (0, -1)):
                cells = np.bincount(joint, weight[c], 1 << len(group)) + 1.0 / (1 << len(group))
                out += sign * np.log(cells / cells.sum())[joint]
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    def of(self, votes: int) -> float:
        return float(self.posterior[np.searchsorted(self.patterns, votes)])


def logistic(rows: list[np.ndarray], target: np.ndarray, n: int) -> np.ndarray:
    """Weights over n terms and a bias, by adaptive gradient steps; without rows all 0."""
    if not rows:
        return np.zeros(n + 1)
    lengths = np.array([len(x) for x in rows], np.int64)
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    weights, sums = np.zeros(n + 1), np.full(n + 1, 1e-6)
    for _ in range(400):
        z = np.bincount(owner, weights[flat], len(rows)) + weights[n]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        slope = np.append(np.bincount(flat, error[owner], n), error.sum())
        slope[:n] += 1e-5 * weights[:n]
        sums += slope**2
        weights -= 0.3 * slope / np.sqrt(sums)
    return weights


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The score rises with the chance of label 1. Terms are found in at most ``sample``
    labelled texts of each class, none held out, and the classifier is fitted to at most
    ``fit_rows`` rows with votes and as many without; a row without an id is held out. Null
    texts are empty, and the empty text gets the score of a text without terms. Equal
    texts get equal scores, texts of any length are read whole, and an empty table gives
    no rows. Other columns are not looked at.
    """
    vocabulary = Vocabulary(found_terms(sample_of(docs, labels, id_col, text_col, label_col, sample)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            T.StructField("votes", T.LongType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
        ]
    )
    arrow_schema = to_arrow_schema(schema)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, buf, offsets in text_blocks(batch.column(1)):
                text, term = vocabulary.hits(buf, offsets)
                votes = vocabulary.votes(buf, offsets, text, term)
                lengths = np.append(0, np.cumsum(np.bincount(text, minlength=end - first)))
                listed = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(term, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(votes), listed.cast(arrow_schema.field(2).type)],
                    schema=arrow_schema,
                )

    voted = keep(rows.mapInArrow(vote, schema))
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    counts = voted.join(known, "doc_id", "left").groupBy("votes", "label").agg(F.count("*").alias("n"))
    model = LabelModel(counts.orderBy("votes", "label").collect())

    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("votes")]
    fit = voted.filter("votes > 0").orderBy(*order).limit(fit_rows).union(
        voted.filter("votes = 0").orderBy(*order).limit(fit_rows)
    )
    fit = sorted(fit.select("votes", "terms").collect(), key=lambda r: (r["votes"], r["terms"]))
    target = np.array([model.of(r["votes"]) for r in fit])
    weights = logistic([np.array(r["terms"], np.int64) for r in fit], target, vocabulary.size)
    known_weights = F.array(*[F.lit(float(w)) for w in weights[:-1]])
    total = F.aggregate("terms", F.lit(float(weights[-1])), lambda a, t: a + F.get(known_weights, t))
    return voted.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        (1 / (1 + F.exp(-total))).alias("score"),
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
