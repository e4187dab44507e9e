"""Quality classifier: linear support vectors on naive Bayes features.

A text becomes the indicators of its n-grams. Each indicator is scaled by the log ratio
of the n-gram's class counts, and a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent. A sigmoid fitted to decisions on texts that a
model has not seen turns decisions into scores.

N-grams are of words (one and two) and of word forms (one to three): a form is a word's
case and length class, its trailing marks, and whether it repeats the word before. A
form n-gram has one indicator for each power of two that its share of the text reaches,
so that a habit counts and a slip does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.hashing import LOWER, SPACES, U64, combine, hash_spans, mix, text_blocks, word_bounds

BITS = 18
#: Most labelled texts that a model is fitted to, drawn by a hash of their ids.
SAMPLE = 3000
COST, EPOCHS, FOLDS = 1.0, 12, 3
SMOOTHING = 1.0
LEVELS = 7
THRESHOLD = 0.7
#: Bytes of a text whose words are looked at together.
PIECE = 1 << 20

_KIND = np.zeros(256, np.uint8)  # 0 mark, 1 lower, 2 upper, 3 digit, 4 other script
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4


def _forms(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of each word's form."""
    kinds = _KIND[buf]
    size = ends - starts
    totals = np.zeros((len(buf) + 1, 4), np.int32)
    for k in range(4):
        np.cumsum(kinds == k, out=totals[1:, k])
    marks, lower, upper, digit = (totals[ends] - totals[starts]).T
    body = size - marks
    case = np.where(upper == 0, 0, np.where(upper == body, 2, 1)) + 3 * (digit > 0)
    length = np.digitize(body, (1, 2, 4, 8, 16, 32))
    tail = np.zeros(len(starts), np.int64)
    for back in range(1, 4):  # the last marks themselves
        at = np.maximum(ends - back, starts)
        own = (kinds[at] == 0) & (size >= back)
        tail = tail * 256 + np.where(own, buf[at], 0)
    again = np.zeros(len(words), np.int64)
    again[1:] = words[1:] == words[:-1]
    form = ((tail * 8 + length) * 8 + case) * 2 + again
    return mix(form.astype(U64) + U64(0x51ED27))


def features(buf: np.ndarray) -> np.ndarray:
    """Sorted indicator numbers of one text's bytes, below 2**BITS."""
    words, forms, at = [], [], 0
    while at < len(buf):
        end = min(len(buf), at + PIECE)
        if end < len(buf):
            gaps = np.flatnonzero(SPACES[buf[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        piece = buf[at:end]
        starts, ends = word_bounds(piece, SPACES)
        found = hash_spans(LOWER[piece], starts, ends)
        words.append(found)
        forms.append(_forms(piece, starts, ends, found))
        at = end
    if not words:
        return np.zeros(1, np.int32)  # the empty text has an indicator of its own
    words, forms = np.concatenate(words), np.concatenate(forms)
    out = [words, combine(words, 2)]
    for n in (1, 2, 3):
        grams, counts = np.unique(combine(forms, n), return_counts=True)
        share = counts / max(1, len(forms) - n + 1)
        for level in range(LEVELS):
            out.append(mix(grams[share >= 2.0**-level] + U64(1 + level * 8 + n)))
    return np.unique((np.concatenate(out) >> U64(64 - BITS)).astype(np.int32))


def feature_rows(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, buf, offsets in text_blocks(column):
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            yield features(buf[a:b])


# ---- fitting, on a bounded sample ----------------------------------------------------


def log_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for x, label in zip(rows, y, strict=True):
        counts[int(label > 0)][x] += 1
    return np.log(counts[1] / counts[1].sum() * counts[0].sum() / counts[0])


def dual_descent(
    rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, seed: int = 7
) -> np.ndarray:
    """Weights of the hinge-loss model over scaled indicators, rows of length one.

    The last weight is the bias. Rarer class rows cost as much in sum as the others.
    """
    values = []
    for x in rows:
        v = scale[x]
        norm = np.sqrt(v @ v) or 1.0
        values.append((v / norm).astype(np.float32))
    weights, bias = np.zeros(1 << BITS), 0.0
    share = np.array([max(1, (y < 0).sum()), max(1, (y > 0).sum())]) / max(1, len(y))
    cost = COST / (2 * share[(y > 0).astype(int)])
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i]
            slope = y[i] * (weights[x] @ v + bias) - 1
            new = min(max(alpha[i] - slope / 2.0, 0.0), cost[i])  # |row|**2 and the bias make 2
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                weights[x] += step * v
                bias += step
                alpha[i] = new
    return np.append(weights * scale, bias)


def decide(x: np.ndarray, model: np.ndarray, scale: np.ndarray) -> float:
    norm = np.sqrt((scale[x] ** 2).sum()) or 1.0
    return float(model[x].sum() / norm + model[-1])


def sigmoid_fit(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of the score 1 / (1 + exp(-(a * margin + b))), by Newton steps."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = p - target
        w = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margins**2).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, [(g * margins).sum() + 1e-6 * a, g.sum()])
        a, b = a - step[0], b - step[1]
    return float(a), float(b)


class Model:
    """Weights over indicators, their scale, and the score's sigmoid."""

    def __init__(self, rows: list[np.ndarray], labels: list[int]) -> None:
        y = np.where(np.array(labels) > 0, 1.0, -1.0)
        if len(set(labels)) < 2:  # nothing to tell apart
            self.scale = np.zeros(1 << BITS, np.float32)
            self.weights = np.zeros((1 << BITS) + 1, np.float32)
            share = (np.sum(y > 0) + 1) / (len(y) + 2)
            self.a, self.b = 0.0, float(np.log(share / (1 - share)))
            return
        margins = np.zeros(len(y))
        fold = np.arange(len(y)) % FOLDS
        for k in range(FOLDS):
            ours = np.flatnonzero(fold != k)
            part = [rows[i] for i in ours]
            scale = log_ratios(part, y[ours])
            model = dual_descent(part, y[ours], scale)
            for i in np.flatnonzero(fold == k):
                margins[i] = decide(rows[i], model, scale)
        self.a, self.b = sigmoid_fit(margins, y)
        scale = log_ratios(rows, y)
        self.weights = dual_descent(rows, y, scale).astype(np.float32)
        self.scale = scale.astype(np.float32)

    def score(self, x: np.ndarray) -> float:
        z = self.a * decide(x, self.weights, self.scale) + self.b
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that labels are never learned from; a row without an id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int
) -> DataFrame:
    """At most ``most`` labelled texts that aren't held out: (text, label).

    The ones with the least hash of their id; conflicting or repeated labels of an id
    count once, by their greatest.
    """
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    ids = docs.select(F.col(id_col).alias("doc_id"))
    drawn = known.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # at most `most` rows of two numbers are sent to every task
    found = texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label")
    return found.agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fitted(sample: DataFrame) -> Model:
    """A model from a bounded sample (doc_id, text, label); only indicators are collected."""

    def indicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in feature_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found, pa.binary())],
                names=["doc_id", "label", "found"],
            )

    rows = sample.withColumn("label", F.col("label").cast("int")).select(F.col("doc_id").cast("string"), "text", "label")
    got = rows.mapInArrow(indicate, "doc_id string, label int, found binary").orderBy("doc_id").toArrow()
    found = [np.frombuffer(x.as_buffer(), np.int32) for x in got.column("found")]
    return Model(found, got.column("label").to_pylist())


def scored(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    The score rises with the chance of label 1. Labels are learned from at most
    ``sample`` labelled rows that aren't held out, never from the rest; a row without an
    id is held out. Null texts are empty, and the empty text is scored by an indicator of
    its own. Without labels of both classes the score is their smoothed share. Equal
    texts get equal scores. Other columns are not looked at.
    """
    model = fitted(labelled_sample(docs, labels, id_col, text_col, label_col, sample))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x) for x in feature_rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64())], schema=arrow_schema
            )

    out = rows.mapInArrow(rate, schema)
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_enough(
    docs: DataFrame,
    labelled: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of docs whose text scores at least the threshold, all columns as they were.

    The model is fitted to the texts of ``labelled`` that ``labels`` knows, as in scored.
    """
    model = fitted(labelled_sample(labelled, labels, id_col, text_col, label_col, sample))

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, type=pa.large_string())
        return pd.Series([model.score(x) >= threshold for x in feature_rows(column)], dtype=bool)

    return docs.filter(passes(F.coalesce(F.col(text_col), F.lit(""))))
