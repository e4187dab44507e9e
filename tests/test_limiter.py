"""Rate limiting against brute force, in batch and as a stream."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import limiter

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def brute_force(events, limit, seconds):
    seen = defaultdict(deque)
    out = {}
    for event, key, at in sorted(events, key=lambda e: (e[2], e[0])):
        window = seen[key]
        while window and (at - window[0]).total_seconds() > seconds:
            window.popleft()
        out[event] = len(window) < limit
        if out[event]:
            window.append(at)
    return out


def random_events(seed, hot_share=0.4):
    rng = random.Random(seed)
    out = []
    for n in range(1500):
        key = "hot" if rng.random() < hot_share else f"k{rng.randrange(12)}"
        at = START + timedelta(seconds=rng.choice([rng.randrange(4000), 60 * rng.randrange(66)]))
        out.append((n, key, at))
    return out


def frame(spark, events):
    return spark.createDataFrame(events, "event int, key string, at timestamp")


@pytest.mark.parametrize(("seed", "limit"), [(1, 3), (2, 7), (3, 1), (4, 40)])
def test_batch_limiter(spark, seed, limit):
    events = random_events(seed)
    found = limiter.rate_limit(
        frame(spark, events).repartition(5), "key", "at", limit=limit, seconds=60, tie_break=["event"]
    )
    assert {r["event"]: r["accepted"] for r in found.collect()} == brute_force(events, limit, 60)


def test_events_without_a_key_share_one(spark):
    events = [(n, None, START + timedelta(seconds=n)) for n in range(5)]
    found = limiter.rate_limit(frame(spark, events), "key", "at", limit=2, seconds=60)
    assert sorted(r["event"] for r in found.where("accepted").collect()) == [0, 1]


def test_window_counts(spark):
    events = random_events(9)
    found = limiter.window_counts(frame(spark, events), "key", "at", 60).collect()
    assert len(found) == len(events)
    for r in found[::50]:
        at = r["at"].replace(tzinfo=None)
        wanted = sum(
            1
            for _, key, t in events
            if key == r["key"] and 0 <= (at - t.replace(tzinfo=None)).total_seconds() <= 60
        )
        assert r["window_count"] == wanted


def test_stream_equals_batch(spark, tmp_path):
    events = sorted(random_events(5)[:300], key=lambda e: e[2])
    folder = str(tmp_path / "in")
    # disorder inside a file stays within the allowed lateness
    for n in range(0, 300, 100):
        frame(spark, events[n : n + 100]).coalesce(1).write.mode("append").parquet(folder)
    flush = [(9999, "flush", START + timedelta(days=2))]
    frame(spark, flush).coalesce(1).write.mode("append").parquet(folder)
    frame(spark, [(10000, "flush", START + timedelta(days=4))]).coalesce(1).write.mode("append").parquet(folder)
    stream = (
        spark.readStream.schema("event int, key string, at timestamp")
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )
    limited = limiter.rate_limit_stream(stream, "key", "at", limit=3, seconds=60, lateness_seconds=600)
    query = (
        limited.writeStream.format("memory")
        .queryName("limited")
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(180)
    rows = spark.sql("select * from limited where key <> 'flush'").collect()
    wanted = brute_force(events, 3, 60)
    assert len(rows) == len(events)
    # events of one key and time may change places
    expected, found = defaultdict(int), defaultdict(int)
    for event, key, at in events:
        expected[key, at.replace(tzinfo=None)] += wanted[event]
    for r in rows:
        found[r["key"], r["at"].replace(tzinfo=None)] += r["accepted"]
    assert found == expected
    assert {r["event"] for r in rows} == {event for event, _, _ in events}


def test_cells_cover_negative_times(spark):
    df = spark.createDataFrame([(-1,), (0,), (59,), (60,)], "t bigint")
    assert [r[0] for r in df.select(limiter._cell(F.col("t"), 60)).collect()] == [-1, 0, 0, 1]


def test_window_counts_of_one_hot_key(spark):
    """A million events of one key inside one window, among them some at one time."""
    n = 1_000_000
    events = spark.range(n).select(
        F.lit("hot").alias("k"), "id", F.timestamp_micros(F.expr("1700000000000000 + (id div 2) * 20")).alias("at")
    )
    found = limiter.window_counts(events, "k", "at", 10.0)
    row = found.agg(F.max("window_count"), F.min("window_count"), F.count("*"), F.sum("window_count")).first()
    # 500 000 times 20 microseconds apart: a window of 10 s holds all before it
    assert row[0] == n and row[1] == 2 and row[2] == n
    assert row[3] == sum(2 * 2 * (i + 1) for i in range(n // 2))


def test_window_counts_equal_counting(spark):
    rng = __import__("random").Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)])) for _ in range(300)]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "id int, k string, s int")
    df = df.withColumn("at", F.timestamp_seconds("s"))
    got = {r["id"]: r["window_count"] for r in limiter.window_counts(df, "k", "at", 7).collect()}
    for i, (k, t) in enumerate(rows):
        near = [1 for k2, t2 in rows if k2 == k and ((t is None and t2 is None) or (t is not None and t2 is not None and t - 7 <= t2 <= t))]
        assert got[i] == len(near)


def test_streamed_counts_equal_batch(spark, tmp_path):
    events = sorted(random_events(6)[:300], key=lambda e: e[2])
    folder = str(tmp_path / "in")
    for n in range(0, 300, 100):  # disorder inside a file stays within the allowed lateness
        frame(spark, events[n : n + 100]).coalesce(1).write.mode("append").parquet(folder)
    for n, days in ((9999, 2), (10000, 4)):
        last = [(n, "flush", START + timedelta(days=days))]
        frame(spark, last).coalesce(1).write.mode("append").parquet(folder)
    stream = (
        spark.readStream.schema("event int, key string, at timestamp")
        .option("maxFilesPerTrigger", 1)
        .parquet(folder)
    )
    counted = limiter.window_counts_stream(stream, "key", "at", seconds=60, lateness_seconds=600)
    query = (
        counted.writeStream.format("memory")
        .queryName("counted")
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(180)
    rows = spark.sql("select event, window_count from counted where key <> 'flush'").collect()
    batch = limiter.window_counts(frame(spark, events), "key", "at", 60).select("event", "window_count")
    assert sorted(map(tuple, rows)) == sorted(map(tuple, batch.collect())) and len(rows) == 300
    left = query.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert left <= 2  # keys whose window has passed are cleared
