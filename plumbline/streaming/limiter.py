"""Trailing-window counts and the sliding-window rate limiter.

The limiter accepts an event when fewer than `limit` accepted events of its key
lie in the trailing window; rejected events do not count. That makes a decision
depend on earlier decisions, which no window aggregate can express. It is
sequential only where a key is saturated, though: while the events of two
neighbouring window-long cells do not exceed the limit, all of them are
accepted. So cells are counted first (map-side), calm cells are accepted in the
JVM, and only runs of busy cells go to Python, each run on its own and primed
with the calm cell before it. The state is at most `limit` timestamps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from plumbline.functions import constants as k


#: Parts of a window-long cell that are summed apart.
CELL_PARTS = 1024


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _cell(micros: Column, width: int) -> Column:
    """The window-long cell a time falls into."""
    start = micros - F.pmod(micros, F.lit(width).cast("bigint"))
    return F.call_function("div", start, F.lit(width).cast("bigint"))


def window_counts(
    df: DataFrame, key: str, ts: str, seconds: float = k.RATE_WINDOW_SECONDS
) -> DataFrame:
    """Events of the same key in the trailing window, both ends included.

    Events are counted by key and time first. A window reaches from its own cell into
    the one before, so its count is what the earlier cell holds from t - width on, plus
    what its own cell holds up to t. Both come from running sums within cells: over the
    sums of a cell's parts, of which there are at most CELL_PARTS, and inside a part. A
    hot key is spread over its parts, and the work grows with the events. Events without
    a time are counted among themselves.
    """
    width = int(seconds * 1_000_000)
    part_width = max(1, width // CELL_PARTS)
    base = df.withColumns({"__t": _micros(ts), "__key": F.col(key)})
    points = base.groupBy("__key", "__t").agg(F.count("*").alias("n"))
    timed = points.where("__t is not null")
    own = timed.select("__key", "__t", F.col("__t").alias("at"), F.lit(1).alias("event"), "n")
    far = timed.select(
        "__key", "__t", (F.col("__t") - width).alias("at"), F.lit(0).alias("event"),
        F.lit(0).cast("bigint").alias("n"),
    )
    rows = own.union(far).withColumns(
        {"cell": _cell(F.col("at"), width), "part": _cell(F.col("at"), part_width)}
    )
    in_cell = Window.partitionBy("__key", "cell").orderBy("part")
    parts = rows.groupBy("__key", "cell", "part").agg(F.sum("n").alias("here"))
    parts = parts.withColumns(
        {
            "earlier": F.sum("here").over(in_cell) - F.col("here"),
            "whole": F.sum("here").over(Window.partitionBy("__key", "cell")),
        }
    ).select(F.col("__key").alias("k"), F.col("part").alias("p"), F.col("cell").alias("c"), "earlier", "whole")
    # at one time, what looks back comes before what happens
    in_part = Window.partitionBy("__key", "cell", "part").orderBy("at", "event").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    same = F.col("__key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")) & (F.col("cell") == F.col("c"))
    upto = rows.withColumn("inside", F.sum("n").over(in_part)).join(parts, same)
    reached = F.col("earlier") + F.col("inside")
    counts = upto.groupBy("__key", "__t").agg(
        F.sum(F.when(F.col("event") == 1, reached).otherwise(F.col("whole") - reached)).alias("window_count")
    )
    counts = counts.union(points.where("__t is null")).select(
        F.col("__key").alias("__k"), F.col("__t").alias("__at"), "window_count"
    )
    at_once = F.col("__key").eqNullSafe(F.col("__k")) & F.col("__t").eqNullSafe(F.col("__at"))
    return base.join(counts, at_once).select(*[F.col(f"`{c}`") for c in df.columns], "window_count")


# ---- decisions ----------------------------------------------------------------------


def _decider(limit: int, width: int) -> Callable[[Iterable[int], deque], list[bool]]:
    """Decides events in time order, given the trailing accepted times of their key.

    The function is made here so that it travels to the workers by value; they
    need not have this package installed.
    """

    def decide(times: Iterable[int], accepted: deque) -> list[bool]:
        flags = []
        for t in times:
            while accepted and t - accepted[0] > width:
                accepted.popleft()
            flags.append(len(accepted) < limit)
            if flags[-1]:
                accepted.append(t)
        return flags

    return decide


def rate_limit(
    df: DataFrame,
    key: str,
    ts: str,
    *,
    limit: int = k.RATE_LIMIT,
    seconds: float = k.RATE_WINDOW_SECONDS,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Every event with an accepted flag; tie_break orders events of equal time."""
    width = int(seconds * 1_000_000)
    # events without a key share one of their own
    name = F.when(F.col(key).isNull(), "").otherwise(F.concat(F.lit("="), F.col(key).cast("string")))
    marked = df.withColumns({"__t": _micros(ts), "__key": name}).withColumn(
        "__cell", _cell(F.col("__t"), width)
    )
    runs = _busy_runs(marked.groupBy("__key", "__cell").agg(F.count("*").alias("__n")), limit)
    tagged = marked.join(runs, ["__key", "__cell"], "left")
    calm = tagged.where("__run is null").select(*df.columns, F.lit(True).alias("accepted"))

    # a run also needs the events of the calm cell before it, as its first state
    openings = runs.where("__opening").select(
        "__key", (F.col("__cell") - 1).alias("__cell"), F.col("__run").alias("__next_run")
    )
    primers = (
        marked.join(openings, ["__key", "__cell"])
        .withColumn("__run", F.col("__next_run"))
        .withColumn("__primer", F.lit(True))
    )
    busy = tagged.where("__run is not null").withColumn("__primer", F.lit(False))
    kept = [*df.columns, "accepted"]
    decide_in_order = _decider(limit, width)
    columns = [*df.columns, "__key", "__t", "__run", "__primer"]
    order = [F.col("__key"), F.col("__run"), F.col("__t"), *[F.col(c) for c in tie_break]]
    ordered = (
        busy.select(*columns)
        .unionByName(primers.select(*columns))
        .repartition("__key", "__run")
        .sortWithinPartitions(*order)
    )

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for batch in batches:
            flags: list[bool] = []
            changes = list(zip(batch["__key"], batch["__run"], strict=True))
            start = 0
            for i in range(1, len(changes) + 1):
                if i < len(changes) and changes[i] == changes[start]:
                    continue
                if changes[start] != current:
                    current, accepted = changes[start], deque()
                flags += decide_in_order(batch["__t"].iloc[start:i], accepted)
                start = i
            batch["accepted"] = flags
            yield batch.loc[~batch["__primer"], kept]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    decided = ordered.mapInPandas(decide, f"{schema}, accepted boolean")
    return calm.unionByName(decided)


def _busy_runs(cells: DataFrame, limit: int) -> DataFrame:
    """Runs of consecutive busy cells: (key, cell, run, whether it opens the run).

    A cell is calm when it and the cell before hold at most limit events: every
    trailing window inside it then holds at most limit events. The window below
    runs over cells, whose number per key is bounded by the time span.
    """
    by_time = Window.partitionBy("__key").orderBy("__cell")
    previous = F.lag("__cell").over(by_time)
    before = F.when(previous == F.col("__cell") - 1, F.lag("__n").over(by_time)).otherwise(0)
    busy = cells.withColumn("__busy", F.coalesce(before, F.lit(0)) + F.col("__n") > limit)
    follows_busy = F.coalesce(
        (previous == F.col("__cell") - 1) & F.lag("__busy").over(by_time), F.lit(False)
    )
    opening = F.col("__busy") & ~follows_busy
    run = F.last(F.when(F.col("__opening"), F.col("__cell")), ignorenulls=True).over(by_time)
    return (
        busy.withColumn("__opening", opening)
        .withColumn("__run", run)
        .where("__busy")
        .select("__key", "__cell", "__run", "__opening")
    )


# ---- streaming ----------------------------------------------------------------------


def rate_limit_stream(
    events: DataFrame,
    key: str,
    ts: str,
    *,
    limit: int = k.RATE_LIMIT,
    seconds: float = k.RATE_WINDOW_SECONDS,
    lateness_seconds: float = 10,
) -> DataFrame:
    """The limiter over a stream, in event-time order.

    Events wait in state until the watermark passes them and are then decided
    in time order. Every column of an event comes out, with accepted. Spark drops
    events behind the watermark and counts them in the query progress
    (numRowsDroppedByWatermark). State per key is the accepted times of one window and
    the events of one lateness interval, as JSON. Null keys share one state.
    """
    width = int(seconds * 1_000_000)
    decide_in_order = _decider(limit, width)

    def decide(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        accepted, times, texts = state.get if state.exists else ([], [], [])
        watermark = state.getCurrentWatermarkMs() * 1000
        arrived = [pair for batch in batches for pair in zip(batch["t"], batch["event"], strict=True)]
        pending = sorted([*zip(times, texts, strict=True), *((int(t), e) for t, e in arrived)])
        ready = [pair for pair in pending if pair[0] <= watermark]
        pending = pending[len(ready) :]
        window = deque(accepted)
        flags = decide_in_order([t for t, _ in ready], window)
        while window and watermark - window[0] > width:
            window.popleft()
        if pending or window:
            state.update((list(window), [t for t, _ in pending], [e for _, e in pending]))
            due = pending[0][0] if pending else window[0] + width
            state.setTimeoutTimestamp(max(due, watermark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event": [e for _, e in ready], "accepted": flags}).astype(
            {"event": "object", "accepted": "bool"}
        )

    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]), exact)
    return (
        events.select(
            F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"),
            _micros(ts).alias("t"), every.alias("event"),
        )
        .withWatermark("ts", f"{int(lateness_seconds * 1000)} milliseconds")
        .groupBy("key")
        .applyInPandasWithState(
            decide,
            "event string, accepted boolean",
            "accepted array<bigint>, times array<bigint>, events array<string>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
        .select(F.from_json("event", events.schema, exact).alias("e"), "accepted")
        .select("e.*", "accepted")
    )


def window_counts_stream(
    events: DataFrame,
    key: str,
    ts: str,
    *,
    seconds: float = k.RATE_WINDOW_SECONDS,
    lateness_seconds: float = 10,
) -> DataFrame:
    """window_counts over a stream: every column of an event, with window_count.

    Events wait in state until the watermark is past them, when no event of their time or
    an earlier one can come any more, so that the counts are those of the batch form.
    State per key is how many events there were at each time of one window, and the
    events of one lateness interval, as JSON; an event-time timer wakes a key whose
    events are due and clears one whose window has passed. Events behind the watermark,
    and events without a time, are dropped by Spark and counted in the query progress.
    Null keys share one state.
    """
    width = int(seconds * 1_000_000)

    def decide(
        group: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        past, counts, times, texts = state.get if state.exists else ([], [], [], [])
        watermark = state.getCurrentWatermarkMs() * 1000
        arrived = [pair for batch in batches for pair in zip(batch["t"], batch["event"], strict=True)]
        pending = sorted([*zip(times, texts, strict=True), *((int(t), e) for t, e in arrived)])
        ready = [pair for pair in pending if pair[0] < watermark]
        pending = pending[len(ready) :]
        window, total = deque(zip(past, counts, strict=True)), sum(counts)
        out = []
        for t, same in groupby(ready, key=lambda pair: pair[0]):
            same = [e for _, e in same]
            while window and window[0][0] < t - width:
                total -= window.popleft()[1]
            window.append((t, len(same)))
            total += len(same)
            out += [(e, total) for e in same]
        while window and window[0][0] < watermark - width:
            window.popleft()
        if pending or window:
            state.update(
                ([t for t, _ in window], [n for _, n in window], [t for t, _ in pending], [e for _, e in pending])
            )
            due = pending[0][0] if pending else window[-1][0] + width
            state.setTimeoutTimestamp(max(due, watermark) // 1000 + 1)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event": [e for e, _ in out], "window_count": [n for _, n in out]}).astype(
            {"event": "object", "window_count": "int64"}
        )

    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in events.columns]), exact)
    return (
        events.select(
            F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"),
            _micros(ts).alias("t"), every.alias("event"),
        )
        .withWatermark("ts", f"{int(lateness_seconds * 1000)} milliseconds")
        .groupBy("key")
        .applyInPandasWithState(
            decide,
            "event string, window_count bigint",
            "past array<bigint>, counts array<bigint>, times array<bigint>, events array<string>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
        .select(F.from_json("event", events.schema, exact).alias("e"), "window_count")
        .select("e.*", "window_count")
    )
