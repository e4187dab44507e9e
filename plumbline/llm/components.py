"""Connected components by alternating stars, all in shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import keep, remove

MAX_ROUNDS = 200


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    roots = least.select("u", F.col("m").alias("v"))
    return tied.union(roots).filter("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (u, v) to (node, root): the least node that each one reaches.

    Nulls and self-links are dropped; nodes without links are absent. The
    number of rounds grows with the logarithm of the largest component; the
    edges of each round are written to the shared folder.
    """
    edges = keep(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u <> v")
        .distinct()
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")
        ).first()
        if state == seen or state["n"] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
        turned = keep(_small_star(_large_star(edges)))
        remove(edges)
        edges = turned
    raise RuntimeError("components did not settle")
