"""Exact quantiles without holding a column in one place.

A quantile needs the values at one or two ranks. Every column's values are counted,
map-side first, and the distinct values with their counts are dealt out by ranges of
(column, value) and written once. The sums of the parts locate each rank in one part, and
only the parts that hold a rank are read again and ranked. A part is as large as the
number of shuffle partitions makes it, whatever the column.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators.facts import melt
from plumbline.session import keep, remove


def quantiles(
    df: DataFrame, counts: dict[int, int], probabilities: Sequence[float] = (0.25, 0.5, 0.75)
) -> dict[int, list[float]]:
    """Linearly interpolated quantiles per numeric column ordinal.

    counts are the non-null counts per column; columns without values are left out.
    """
    positions = {i: [(n - 1) * p for p in probabilities] for i, n in counts.items() if n}
    if not positions:
        return {}
    ranks = {i: sorted({r for h in hs for r in (math.floor(h), math.ceil(h))}) for i, hs in positions.items()}
    dealt = keep(
        melt(df, sorted(positions), "double")
        .groupBy("ordinal", "value")
        .agg(F.count("*").alias("n"))
        .repartitionByRange("ordinal", "value")
        .withColumn("part", F.spark_partition_id())
    )
    found = _ranked(dealt, ranks)
    remove(dealt)
    return {
        i: [
            found[i, math.floor(h)] + (found[i, math.ceil(h)] - found[i, math.floor(h)]) * (h % 1)
            for h in hs
        ]
        for i, hs in positions.items()
    }


def _ranked(dealt: DataFrame, ranks: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """The value at each rank, from the parts that hold one."""
    # columns times parts small numbers reach the driver
    parts = dealt.groupBy("ordinal", "part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    wanted, below = [], dict.fromkeys(ranks, 0)
    for r in parts:
        i = int(r["ordinal"])
        inside = [x for x in ranks[i] if below[i] <= x < below[i] + r["n"]]
        wanted += [(str(i), r["part"], x, x - below[i]) for x in inside]
        below[i] += r["n"]
    table = dealt.sparkSession.createDataFrame(
        wanted, "ordinal string, part int, rank bigint, place bigint"
    )
    places = F.broadcast(table)  # two rows a quantile
    running = Window.partitionBy("ordinal", "part").orderBy("value")
    hits = (
        dealt.join(F.broadcast(table.select("ordinal", "part").distinct()), ["ordinal", "part"], "left_semi")
        .withColumn("upto", F.sum("n").over(running))
        .join(places, ["ordinal", "part"])
        .where("place < upto and place >= upto - n")
        .collect()
    )
    return {(int(r["ordinal"]), r["rank"]): r["value"] for r in hits}
