import random
import re
import tracemalloc
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm.components import components
from plumbline.llm.exact_dups import exact_duplicates
from plumbline.llm import hashing
from plumbline.llm.near_dups import common_values, near_duplicates, text_sets, without_near_duplicates

BLANK = "[\x20\x09-\x0d]+"


def shingles(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    words = [w for w in re.split(BLANK, low) if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    """doc_id -> (n_shingles, component_id) by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(draw, words, copies, most):
    out = []
    for _ in range(copies):
        own = list(words)
        for _ in range(draw.randrange(most)):
            own[draw.randrange(len(own))] = f"e{draw.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_equal_all_pairs(spark):
    draw = random.Random(4)
    texts = []
    for g in range(12):
        words = [f"w{draw.randrange(400)}" for _ in range(draw.choice((4, 7, 60, 300, 700)))]
        texts += family(draw, words, draw.choice((1, 2, 8, 25)), max(2, len(words) // 20))
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"q{i}_{j}" for j in range(20)) for i in range(30)]
    texts += ["", None, "  ", "A b", "a  B", "a b c d e", "a b c d e f"]
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_near_duplicates_of_odd_rows(odd, empty):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[0][0].n_shingles == 0 and by_id[0][0].component_id == 0 and by_id[0][0].kept
    assert {r.component_id for r in by_id[5]} == {4} and not by_id[5][0].kept
    assert [r.component_id for r in by_id[3]] == [3, 3, 3]
    assert sorted((r.n_shingles, r.component_id, r.kept) for r in by_id[None] if r.n_shingles) == [(2, 4, False)]
    assert near_duplicates(empty).count() == 0


def test_stage_keeps_one_row_and_all_columns(odd, empty):
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert ids.count((False, 3)) == 1 and (False, 5) not in ids and (True, 0) in ids
    assert without_near_duplicates(empty).count() == 0


def test_overlap_bound_is_below_the_mean():
    assert 20 < common_values(64, 75) < 48 and 140 < common_values(256, 75) < 192


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_a_chain_and_a_star(spark, n):
    edges = [(i, i + 1) for i in range(n)] + [(100, 100 + i) for i in range(1, n + 1)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {100 + i: 100 for i in range(1, n + 1)}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def plain(text):
    return re.sub(BLANK, "", text or "")


@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_duplicates_equal_grouping(spark, digest_all):
    draw = random.Random(1)
    rows = [(i, draw.choice(["a b", "ab", "a\tb ", "", None, "ab" * 90, "ab" * 89 + "ac", "é b", str(i)])) for i in range(300)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append((-len(t or ""), i))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for r in exact_duplicates(df, digest_all=digest_all).collect():
        group = groups[plain(dict(rows)[r.doc_id])]
        assert (r.keep_id, r.group_size) == (min(group)[1], len(group))
        assert r.kept == (r.doc_id == r.keep_id)
        assert (r.text_sha256 is None) == (not digest_all and len(group) == 1) or r.text_sha256


def test_exact_duplicates_of_odd_rows(odd, empty):
    rows = exact_duplicates(odd, digest_all=True).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if r.text_sha256.startswith("e3b0c442")]
    assert {r.keep_id for r in blank} == {2} and {r.group_size for r in blank} == {4}
    assert exact_duplicates(empty).count() == 0


def test_a_third_of_the_rows_in_one_class(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the very same text of some words here").otherwise(F.expr("concat(id, ' x y z ', id)")).alias("text"),
    )
    found = near_duplicates(df)
    assert found.filter("component_id = 0").count() == 1000
    assert found.filter("kept").count() == 2001


def test_a_worker_needs_little_memory_for_shingle_sets():
    draw = random.Random(11)
    words = ["".join(draw.choices("abcdefgh", k=5)) for _ in range(2000)]
    texts = [" ".join(draw.choices(words, k=200)) for _ in range(3500)]  # 4 MB
    texts.insert(7, " ".join(draw.choices(words, k=100_000)))  # cut into blocks
    column = pa.array(texts)
    tracemalloc.start()
    sizes = [len(x) for x in text_sets(column, 5)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tables = hashing._POWERS.nbytes + hashing._INVERSES.nbytes
    assert peak + tables < 40e6
    for i in (0, 7, 3500):
        own = texts[i].split()
        assert sizes[i] == len({tuple(own[j : j + 5]) for j in range(len(own) - 4)})
    assert np.array_equal(next(text_sets(column.slice(7, 1), 5)), list(text_sets(column.slice(5, 4), 5))[2])
