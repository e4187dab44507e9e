"""Near duplicates by bottom-k sketches from one hash function.

One hash function gives every word shingle a 64-bit value. A document keeps the k
least values of its set. Inverted lists of the retained values generate overlaps, the
sketch of the union estimates the similarity, and full sets confirm it.

How rows stay few without a cap:

- Documents with equal sets form one class; only classes are compared.
- Similarity of at least ``threshold`` means at least ``c`` common retained values. A class
  that shares fewer with all others together has no partner; that ends most of them on
  short sketches. The rest go on with longer ones, taken from their full sets.
- Two similar classes share one value among the ``len - c + 1`` rarest of each. Frequent
  values (a licence, a passage in a third of the rows) fall out by that rule, not by a cap.
- A value that no other class retains is in no intersection, and the parities of a set's
  values in 1024 cells differ in at most as many cells as two sets differ in values; both
  bound the similarity of two classes inside the join that would pair them.
- In each list every class first meets the one with the fewest such values, the centre of
  a group of copies. Only classes then in different components meet one another.

``c`` is exact for sets of up to ``threshold * k`` shingles; for larger ones it is the
binomial bound below which a pair at the threshold falls with probability ``MISS``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.components import components
from plumbline.llm.hashing import LOWER, SPACES, block_words, combine, mix, text_blocks
from plumbline.session import keep, remove

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
#: Values kept of every document, and of those that may have a partner.
SKETCH_SIZE, LONG_SKETCH = 64, 256
#: 64-bit numbers that hold the parities of a set.
PARITY_LONGS = 16
#: Values of whole sets that a worker holds before it hands them on.
SET_VALUES = 1 << 19
MISS = 1e-7
#: Share of the waiting classes under which another round of meetings isn't worth while.
FEW_TIED = 0.02


def shingle_set(words: np.ndarray, width: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than the width are one shingle."""
    if not len(words):
        return words
    if len(words) < width:
        return mix(combine(words, len(words)) + np.uint64(len(words)))
    return np.unique(combine(words, width))


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The shingle set of each text of an Arrow column, in order."""
    for _, _, buf, offsets in text_blocks(column):
        words, bounds = block_words(buf, offsets, SPACES, LOWER.take)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield shingle_set(words[a:b], width)


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, text), the texts without nulls."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str, text_col: str, k: int, width: int) -> DataFrame:
    """(doc_id, text_key, n, set_key, sketch): size and digest of the set, its k least values."""
    picked = texts_of(docs, id_col, text_col)
    schema = T.StructType(
        [
            T.StructField("doc_id", picked.schema["doc_id"].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("set_key", T.BinaryType()),
            T.StructField("sketch", T.ArrayType(T.LongType())),
        ]
    )

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, least = [], [], []
            for found in text_sets(batch.column(2), width):
                sizes.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                least.append(found[:k].copy())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.binary()),
                    _lists(least, k),
                ],
                names=["doc_id", "text_key", "n", "set_key", "sketch"],
            )

    return picked.mapInArrow(sketch, schema)


def sets_of(docs: DataFrame, width: int, k: int) -> DataFrame:
    """(set_key, text) to (set_key, n, sketch, parities, found), found being the whole set.

    A text whose set has another digest is not the one asked for and goes.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, size = [], [], 0
            for i, x in enumerate(text_sets(batch.column(1), width)):
                key = hashlib.blake2b(x.tobytes(), digest_size=16).digest()
                if key == batch.column(0)[i].as_py():
                    keys.append(key)
                    found.append(x)
                    size += len(x)
                if size > SET_VALUES:
                    yield _rows(keys, found, k)
                    keys, found, size = [], [], 0
            yield _rows(keys, found, k)

    return docs.select("set_key", "text").mapInArrow(
        whole,
        "set_key binary, n long, sketch array<long>, parities array<long>, found binary",
    )


def _lists(found: list[np.ndarray], k: int) -> pa.ListArray:
    """The k least values of each set, as numbers of 63 bits."""
    least = [x[:k] for x in found]
    lengths = pa.array(np.cumsum([0, *map(len, least)]).astype(np.int32))
    values = np.concatenate([*least, np.zeros(0, np.uint64)]) >> np.uint64(1)
    return pa.ListArray.from_arrays(lengths, pa.array(values.view(np.int64)))


def _parities(found: list[np.ndarray]) -> pa.ListArray:
    """For each set, whether an odd number of values falls into each cell."""
    out = np.zeros((len(found), PARITY_LONGS), np.int64)
    for i, x in enumerate(found):
        cells = np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=64 * PARITY_LONGS)
        out[i] = np.packbits(cells & 1).view(np.int64)
    lengths = pa.array(np.arange(len(found) + 1, dtype=np.int32) * PARITY_LONGS)
    return pa.ListArray.from_arrays(lengths, pa.array(out.reshape(-1)))


def _rows(keys: list[bytes], found: list[np.ndarray], k: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.binary()),
            pa.array([len(x) for x in found], pa.int64()),
            _lists(found, k),
            _parities(found),
            pa.array([x.tobytes() for x in found], pa.binary()),
        ],
        names=["set_key", "n", "sketch", "parities", "found"],
    )


def common_values(k: int, percent: int) -> int:
    """Least overlap of two k-sketches at the threshold, but for probability MISS."""
    t, tail = percent / 100, 0.0
    for c in range(k + 1):
        tail += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if tail > MISS:
            return max(1, c)
    return k


def needed(n: str, k: int, percent: int) -> F.Column:
    """The overlap that a class of n shingles needs with any similar class."""
    exact = F.ceil(F.col(n) * percent / 100)
    return F.when(F.col(n) * 100 <= k * percent, exact).otherwise(common_values(k, percent))


def _shared(classes: DataFrame) -> DataFrame:
    """(set_key, n, kept_values, value, df): retained values of two or more classes."""
    entries = classes.filter("n > 0").select(
        "set_key", "n", F.size("sketch").alias("kept_values"), F.explode("sketch").alias("value")
    )
    counts = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    return entries.join(counts, "value")


def hopeful(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(set_key): classes whose shared values suffice for a partner.

    Values travel with eight bytes of their class's key; should two keys agree in them,
    both classes count for more and stay.
    """
    short = F.xxhash64("set_key").alias("short")
    entries = classes.select(short, F.explode("sketch").alias("value"))
    counts = entries.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    shared = entries.join(counts.select("value"), "value").groupBy("short").agg(
        F.count("*").alias("shared")
    )
    found = classes.select("set_key", "n", short).join(shared, "short")
    return found.filter(F.col("shared") >= needed("n", k, percent)).select("set_key")


def inverted_index(classes: DataFrame, k: int, percent: int) -> DataFrame:
    """(value, set_key, n, own, early, parities): the rarest shared values of each class with hope.

    own counts the values of the sketch that no other class has. early marks the values
    among which a similar class of the same size or larger has one: its overlap is larger.
    """
    per_class = _shared(classes).groupBy("set_key").agg(
        F.first("n").alias("n"),
        F.first("kept_values").alias("kept_values"),
        F.sort_array(F.collect_list(F.struct("df", "value"))).alias("shared"),  # at most k
    )
    reach = F.size("shared") - needed("n", k, percent) + 1
    early = F.size("shared") - F.ceil(F.col("n") * 2 * percent / (100 + percent)) + 1
    early = F.when(F.col("n") * 100 <= k * percent, early).otherwise(reach)
    return (
        per_class.withColumns({"reach": reach.cast("int"), "early": early})
        .filter("reach > 0")
        .select(
            "set_key",
            "n",
            (F.col("kept_values") - F.size("shared")).alias("own"),
            "early",
            F.posexplode(F.slice("shared", F.lit(1), F.col("reach"))).alias("at", "e"),
        )
        .select("e.value", "set_key", "n", "own", (F.col("at") < F.col("early")).alias("early"))
        .join(classes.select("set_key", "parities"), "set_key")
    )


def _may_link(k: int, percent: int) -> F.Column:
    """Whether sizes, and values that only one side has, leave room for a link."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    both = F.least(F.col("n_a") - F.col("own_a"), F.col("n_b") - F.col("own_b"))
    room = both * 100 >= (F.col("n_a") + F.col("n_b") - both) * percent
    early = ((F.col("n_a") >= F.col("n_b")) & F.col("early_b")) | (
        (F.col("n_b") >= F.col("n_a")) & F.col("early_a")
    )
    total = F.col("n_a") + F.col("n_b")
    cells = sum(
        (
            F.bit_count(F.col("parities_a")[i].bitwiseXOR(F.col("parities_b")[i]))
            for i in range(PARITY_LONGS)
        ),
        F.lit(0),
    )
    alike = cells * (100 + percent) <= total * (100 - percent)
    return (small * 100 >= large * percent) & ((large > k) | room) & early & alike


def estimated(pairs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose union sketch has enough common values, with their number."""
    side = sets.select("set_key", "n", "sketch")
    for x in ("a", "b"):
        own = side.select(
            F.col("set_key").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")
        )
        pairs = pairs.join(own, x)
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("s_a", "s_b")))
    pairs = pairs.select("a", "b", "n_a", "n_b", common.alias("common"))
    large = F.greatest("n_a", "n_b")
    exact = F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent
    likely = F.when(large * 100 <= k * percent, exact).otherwise(
        F.col("common") >= common_values(k, percent)
    )
    return pairs.filter(likely).select("a", "b", "common")


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, fa, fb = batch.columns
            linked = []
            for x, y in zip(fa, fb, strict=True):
                p = np.frombuffer(x.as_buffer(), np.uint64)
                q = np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int(np.count_nonzero(q[at] == p))
                linked.append(100 * both >= percent * (len(p) + len(q) - both))
            keep_rows = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [a.filter(keep_rows), b.filter(keep_rows)], names=["u", "v"]
            )

    return confirm


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v): the pairs (a, b) whose full sets reach the threshold."""
    for x in ("a", "b"):
        own = sets.select(F.col("set_key").alias(x), F.col("found").alias(f"f_{x}"))
        pairs = pairs.join(own, x)
    return pairs.select("a", "b", "f_a", "f_b").mapInArrow(
        _confirm(percent), "u binary, v binary"
    )


def apart(index: DataFrame, tied: DataFrame | None) -> DataFrame:
    """(value, set_key, n, own, early, parities, root, main): lists whose classes aren't all in one component.

    main is the component that has the most classes of the list.
    """
    if tied is None:
        lists = index.withColumn("root", F.col("set_key"))
    else:
        lists = index.join(tied.withColumnRenamed("node", "set_key"), "set_key", "left")
        lists = lists.withColumn("root", F.coalesce("root", "set_key"))
    sizes = lists.groupBy("value", "root").agg(F.count("*").alias("size"))
    main = sizes.groupBy("value").agg(
        F.max(F.struct("size", "root")).alias("m"), F.count("*").alias("roots")
    )
    main = main.filter("roots > 1").select("value", F.col("m.root").alias("main"))
    return lists.join(main, "value")


def _side(split: DataFrame, x: str, *more: F.Column) -> DataFrame:
    names = {"set_key": x, "n": f"n_{x}", "own": f"own_{x}"}
    names |= {c: f"{c}_{x}" for c in ("early", "parities", "root")}
    return split.select("value", *[F.col(c).alias(new) for c, new in names.items()], *more)


def met(split: DataFrame, salt: int, k: int, percent: int) -> DataFrame:
    """Pairs (a, b): each class outside a list's main component with one class inside.

    Salt 0 takes the class with the smallest share of values of its own, any other salt
    a class by a hash with that salt.
    """
    drawn = F.xxhash64("set_key", "value", F.lit(salt))
    first = F.col("own") / F.col("n") if salt == 0 else drawn
    inside = split.filter("root = main").groupBy("value")
    leader = inside.agg(F.min(F.struct(first.alias("h"), "set_key", "n", "own", "early", "parities", "root")).alias("m"))
    leader = _side(leader.select("value", "m.*"), "b")
    pairs = _side(split.filter("root <> main"), "a").join(leader, "value")
    return pairs.filter(_may_link(k, percent)).select("a", "b").distinct()


def all_apart(split: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of one list and two components, each of them."""
    rest = _side(split.filter("root <> main"), "a")
    every = _side(split, "b", (F.col("root") == F.col("main")).alias("inside"))
    pairs = rest.join(every, "value").filter("root_a <> root_b and (inside or a < b)")
    return pairs.filter(_may_link(k, percent)).select("a", "b").distinct()


def linked_classes(index: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame | None:
    """(node, root) of all classes that have a link, None if no lists have two classes.

    In every round the classes outside a list's main component meet one class of it, a
    different one in each list; the most promising meeting of each is confirmed. Once
    that ties few classes more, all remaining pairs of different components are taken.
    """
    tied, salt = None, 0
    while True:
        split = keep(apart(index, tied))
        waiting = split.filter("root <> main").select("set_key").distinct().count()
        if not waiting:
            return tied
        pairs = estimated(met(split, salt, k, percent), sets, k, percent)
        best = pairs.groupBy("a").agg(F.max(F.struct("common", "b")).alias("m"))
        links = keep(confirmed(best.select("a", F.col("m.b").alias("b")), sets, percent))
        done = links.count() <= waiting * FEW_TIED
        if done:
            rest = estimated(all_apart(split, k, percent), sets, k, percent)
            links = confirmed(rest, sets, percent).union(links)
        if tied is not None:
            links = links.union(tied)
        tied = components(links)
        remove(split)
        if done:
            return tied
        salt += 1


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = THRESHOLD_PERCENT,
    k: int = SKETCH_SIZE,
    long_k: int = LONG_SKETCH,
    width: int = SHINGLE_WORDS,
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept, text_key.

    Documents are linked if their sets of word shingles have a Jaccard similarity of at
    least ``percent`` / 100; component_id is the least id that links reach. Null and
    empty texts have no shingles and are linked with nothing, each row a component of
    its own. A null id takes part in links but is never a component_id; such a row is
    kept if no row of its component has an id. Repeated rows come out as often as they
    went in, with the same answer. Other columns are not looked at. text_key is a hash
    of the text, to tell rows with equal or no ids apart.
    """
    rows = keep(sketches(docs, id_col, text_col, k, width))
    classes = keep(
        rows.filter("n > 0")
        .groupBy("set_key")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_key")).alias("row"),
            F.first("n").alias("n"),
            F.first("sketch").alias("sketch"),
        )
        .select("set_key", "row.doc_id", "row.text_key", "n", "sketch")
    )
    members = keep(rows.drop("sketch"))
    remove(rows)

    wanted = hopeful(classes, k, percent).join(
        classes.select("set_key", F.col("doc_id").alias("d"), F.col("text_key").alias("t")), "set_key"
    )
    texts = texts_of(docs, id_col, text_col)
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
    sets = keep(sets_of(texts.join(wanted, same), width, long_k).dropDuplicates(["set_key"]))
    index = keep(inverted_index(sets, long_k, percent))
    tied = linked_classes(index, sets, long_k, percent)

    named = classes.select("set_key", F.col("doc_id").alias("least"))
    if tied is not None:
        named = named.join(tied.withColumnRenamed("node", "set_key"), "set_key", "left")
        named = named.withColumn("root", F.coalesce("root", "set_key"))
        lowest = named.groupBy("root").agg(F.min("least").alias("least"))
        named = named.drop("least").join(lowest, "root").select("set_key", "least")
    out = members.join(named, "set_key", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
        "text_key",
    )


def without_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int
) -> DataFrame:
    """The rows of docs of which one per component stays, all columns as they were.

    Of each component the row with the least id stays, of equal ids one with the least
    hash of its text, of repeated rows one. Documents without an id stay where no row of
    their component has one, repeated ones once.
    """
    found = near_duplicates(docs, id_col, text_col, **options).filter("kept")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    alone = F.when(F.col("doc_id").isNull(), F.col("text_key"))
    picks = found.groupBy(name.alias("__name"), alone.alias("__alone")).agg(
        F.min("text_key").alias("__text")
    )
    text = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    named = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.withColumns({"__name": named, "__text": text})
    keys = ["__name", "__text"]
    rows = rows.join(picks.select(keys), keys).dropDuplicates(keys)
    return rows.drop(*keys)
