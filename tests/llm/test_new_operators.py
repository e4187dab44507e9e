import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate, lexical, line_dedup, mixing, spelling

LOWER = {i: i + 32 for i in range(65, 91)}

# ---- line dedup ---------------------------------------------------------------------


def plain_lines(rows, least=10):
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    order = lambda i: (i is None, i or 0)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(key(x)) < least or len(holders[key(x)]) < 2 or min(holders[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def lines_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "text").collect()), key=str)


@pytest.mark.parametrize("batches", [1, 5])
def test_lines_against_plain(spark, batches):
    draw = random.Random(batches)
    pool = ["  Line number %d of all " % i for i in range(40)] + ["short", "", "ÀÉÎ long enough", "àéî long enough", "İI long enough 1", "\tx\r"]
    rows = [(draw.choice([None, *range(60)]), "\n".join(draw.choice(pool).swapcase() if draw.random() < 0.2 else draw.choice(pool) for _ in range(draw.randrange(9)))) for _ in range(90)]
    rows += [(draw.randrange(900), "\n".join(["The line that everyone has", "own line %d here" % i])) for i in range(200)]
    rows += [(7, None), (8, "")]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, key string").repartition(5)
    assert lines_of(line_dedup.without_repeated_lines(docs, batches=batches, fanout=2)) == plain_lines(rows)


def test_lines_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert lines_of(line_dedup.without_repeated_lines(odd)) == plain_lines(rows)
    assert line_dedup.without_repeated_lines(empty).count() == 0
    many = odd.limit(1).select(F.lit("n").alias("doc_id"), F.lit("the very same line\n" * 30_000).alias("text"))
    twice = many.union(many.withColumn("doc_id", F.lit("m")))
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(twice).collect()}
    assert (got["m"].n_dropped, got["n"].n_dropped, got["n"].text) == (0, 30_000, "")


def test_runs_are_levelled_and_opened_again(spark, tmp_path):
    folder = str(tmp_path / "runs")
    rows = [(i, f"line of document {i // 2}\nline of everyone") for i in range(14)]
    gone = []
    for i in range(7):
        runs = line_dedup.LineRuns(spark, folder, fanout=2)  # as another session would
        lines = line_dedup.line_hashes(spark.createDataFrame(rows[2 * i : 2 * i + 2], "doc_id long, text string"))
        gone += [(r.doc_id, r.place) for r in runs.add(lines).collect()]
        names = [r.split("-")[0] for r in runs.ordered()]
        runs.close()
    assert names == ["0", "1", "2"]  # seven runs are 4 + 2 + 1
    assert sorted(gone) == sorted([(i, 0) for i in range(1, 14, 2)] + [(i, 1) for i in range(1, 14)])


# ---- lexical search -----------------------------------------------------------------


def plain_ranks(docs, items, k):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            score = 0
            for t in terms(text):
                if c[t]:
                    m = 75 + 25 * sum(c.values()) * n_docs // n_terms
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("sets", [4_000_000, 50])
def test_ranks_against_plain(spark, monkeypatch, sets):
    monkeypatch.setattr(lexical, "SET_LETTERS", sets)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", 64)
    monkeypatch.setattr(lexical, "BLOCK_ENTRIES", 500)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "the", "THE", "a1"]
    text = lambda n: "-".join(draw.choice(words[: draw.randrange(1, 66)]) for _ in range(n))
    docs = [(i, text(draw.randrange(60))) for i in range(400)]
    docs += [(500 + i % 7, "w59 w59 the") for i in range(40)] + [(None, "w59 w58"), (None, None), (3, "")]
    items = [(i, text(draw.randrange(1, 12))) for i in range(12)] + [(12, "w59 w59 w58 no-such"), (13, None), (14, "..."), (15, "nowhere")]
    got = lexical.ranked(
        spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int").repartition(3),
        spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int"),
        k=6,
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranks(docs, items, 6)


def test_ranks_of_odd_rows(spark, odd, empty):
    items = odd.select(F.monotonically_increasing_id().alias("item_id"), "text", "n")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    asked = [(r.item_id, r.text) for r in items.collect()]
    got = lexical.ranked(odd, items).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_ranks(docs, asked, 20)
    assert lexical.ranked(empty, items).count() == 0
    nothing = lexical.ranked(odd, items.limit(0))
    assert nothing.count() == 0 and nothing.columns == ["item_id", "rank", "doc_id", "score"]


# ---- spelling -----------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


def variants_of(df):
    return sorted((tuple(r) for r in df.select("word", "n", "n_near", "form", "form_n", "root").collect()), key=str)


@pytest.mark.parametrize("most", [2048, 4])
def test_variants_against_plain(spark, most):
    draw = random.Random(9)
    words = ["".join(draw.choice("abéÿ×") for _ in range(draw.randrange(6, 10))) for _ in range(40)]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "banana", "bananas", "Bananas", "banàna", "x" * 3000, "x" * 3001]
    for w in list(words[:30]):
        at = draw.randrange(len(w))
        words += [w[:at] + w[at + 1 :], w[:at] + "z" + w[at:], w[:at] + "q" + w[at + 1 :]]
    docs = []
    for i in range(400):
        some = [words[min(int(draw.expovariate(0.02)), len(words) - 1)] for _ in range(40)]
        docs.append((i if i % 11 else None, " ".join(some) + "1" + draw.choice(words)))
    docs += [(1, None), (2, "")]
    df = spark.createDataFrame([(*d, "r", 1) for d in docs], "doc_id long, text string, root string, m int").repartition(4)
    want = plain_variants(docs)
    assert any(r[3] for r in want) and any(len(r[0]) > 2000 for r in want)
    assert variants_of(spelling.variants(df, most=most)) == want


def test_variants_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert variants_of(spelling.variants(odd)) == plain_variants(rows)
    assert spelling.variants(empty).count() == 0


def test_kept_digest(spark):
    docs = spark.createDataFrame([(1, "a line of some\nÀ")], "doc_id int, text string")
    got = line_dedup.without_repeated_lines(docs).select(F.sha2("text", 256).alias("d")).first().d
    assert got == hashlib.sha256("a line of some\nÀ".encode()).hexdigest()


# ---- limits that can't be met -------------------------------------------------------


def test_mix_that_cannot_be_drawn(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * (1 + i)) for i in range(20)], "doc_id long, source string, text string")
    with pytest.raises(ValueError, match="without repeating"):
        mixing.mixed(docs, budget=1000, max_repeat=2.0)
    with pytest.raises(ValueError, match="entropy"):
        mixing.mixed(docs, entropy=0.8)
    assert mixing.mixed(docs, budget=420, max_repeat=2.0).count() >= 39


def test_tables_reach_their_recall_or_say_so(monkeypatch):
    draw = np.random.default_rng(1)
    items = [draw.integers(0, 2**60, 40).astype(np.uint64) for _ in range(20)]
    assert decontaminate.tables_needed(items, 0.2, 0.99) > 1
    monkeypatch.setattr(decontaminate, "MOST_TABLES", 1)
    with pytest.raises(ValueError, match="1 tables find"):
        decontaminate.tables_needed(items, 0.2, 0.99)
