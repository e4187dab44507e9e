"""Temperature mixing of sources to a token budget, built-in functions only.

Every source's share of the tokens is raised to an exponent and normalised. The exponent
is bisected to the flattest mix whose sources repeat at most ``max_repeat`` times, or to
the steepest that still has a given entropy. A source's budget is then realised as passes
over its documents: whole passes, and one that ends inside.

A pass is a permutation of blocks. Documents fall into 4096 blocks per source and 4096
parts per block by a hash of their id, and a hash of (source, pass, block) orders the
blocks. The pass that ends inside takes blocks in that order up to the one that would
exceed the budget, and of that block the parts in order, as long as they fit. All that
must be known of this is one row per source, so rows find their place without a shuffle
of texts, and no window sees more than 4096 rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.session import keep

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEAT = 2.0
#: Bisection steps per look at the sources, and looks.
STEPS, LOOKS = 6, 4
CELLS = 4096


def draw(*parts: F.Column | str) -> F.Column:
    """60 bits of a hash of the parts, the same in any engine that has MD5."""
    text = F.concat_ws("|", *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p, F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def placed(docs: DataFrame, id_col: str, source_col: str, seed: str) -> DataFrame:
    """docs with __source, __block and __part, the last two below CELLS."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    rows = docs.withColumn("__source", source)
    own = draw(F.lit(seed), F.col("__source"), F.col(id_col).cast("string"))
    rows = rows.withColumn("__draw", own)
    block = F.shiftright("__draw", 48)
    part = F.shiftright("__draw", 36).bitwiseAND(F.lit(CELLS - 1))
    return rows.withColumn("__block", block).withColumn("__part", part).drop("__draw")


def exponent(
    totals: DataFrame, budget: int, max_repeat: float, entropy: float | None
) -> float:
    """The exponent between 0 and 1, by bisection on the table of sources."""
    low, high = 0.0, 1.0
    for _ in range(LOOKS):
        n = 2**STEPS
        points = [low + (high - low) * i / n for i in range(1, n)]
        grid = F.explode(F.array(*[F.lit(x) for x in points])).alias("x")
        power = F.exp(F.col("x") * F.log("share"))
        by_point = totals.select(grid, "share", "tokens").withColumn("power", power).groupBy("x").agg(
            F.sum("power").alias("z"),
            F.sum(F.col("power") * F.log("power")).alias("zlz"),
            F.max(F.col("power") * budget / F.col("tokens")).alias("most"),
        )
        if entropy is None:  # flat enough is not too flat
            fits = F.col("most") / F.col("z") <= max_repeat
            best = by_point.filter(fits).agg(F.min("x")).first()[0]
            high_new = high if best is None else best
            low, high = high_new - (high - low) / n, high_new
        else:
            fits = F.log("z") - F.col("zlz") / F.col("z") >= entropy
            best = by_point.filter(fits).agg(F.max("x")).first()[0]
            low_new = low if best is None else best
            low, high = low_new, low_new + (high - low) / n
    return high if entropy is None else low


def mixing_plan(
    facts: DataFrame,
    budget: int | None = None,
    max_repeat: float = MAX_REPEAT,
    entropy: float | None = None,
    seed: str = "mix",
) -> DataFrame:
    """One row per source from (__source, __block, __part, tokens).

    weight, passes (whole ones), and where the last pass ends: last_order is the place
    of the block that is cut, parts of it up to last_part stay.
    """
    totals = facts.groupBy("__source").agg(F.sum("tokens").alias("tokens"))
    totals = totals.filter("tokens > 0")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = all_tokens if budget is None else budget
    totals = keep(totals.withColumn("share", F.col("tokens") / F.lit(float(max(1, all_tokens)))))
    n_sources = totals.count()
    if entropy is None and budget > max_repeat * all_tokens:
        raise ValueError(f"{budget} words can't be drawn from {all_tokens} without repeating a source over {max_repeat} times")
    if entropy is not None and n_sources and entropy > math.log(n_sources) + 1e-9:
        raise ValueError(f"{n_sources} sources have an entropy of {math.log(n_sources):.4f} at most")
    x = exponent(totals, budget, max_repeat, entropy)
    powers = totals.withColumn("power", F.exp(F.lit(x) * F.log("share")))
    z = powers.agg(F.sum("power")).first()[0] or 1.0
    quota = F.floor(F.col("power") / F.lit(z) * F.lit(float(budget))).cast("long")
    sources = powers.select("__source", "tokens", (F.col("power") / F.lit(z)).alias("weight"), quota.alias("quota"))
    sources = sources.withColumn("passes", F.expr("quota div tokens")).withColumn(
        "rest", F.expr("quota - passes * tokens")
    )
    sources = keep(sources)

    def cut(cells: DataFrame, order: F.Column) -> DataFrame:
        """Up to where cells in order stay within rest: last, and what is left of rest."""
        cells = cells.withColumn("order", order)
        run = Window.partitionBy("__source").orderBy("order", "cell")
        upto = cells.withColumn("upto", F.sum("tokens").over(run))
        whole = upto.filter("upto <= rest").groupBy("__source").agg(F.max("upto").alias("taken"))
        over = upto.filter("upto > rest").groupBy("__source").agg(
            F.min(F.struct("order", "cell")).alias("m")
        )
        return over.join(whole, "__source", "left").select(
            "__source", F.col("m.order").alias("order"), F.col("m.cell").alias("cell"),
            F.coalesce("taken", F.lit(0).cast("long")).alias("taken"),
        )

    wanted = sources.select("__source", "rest", "passes")
    blocks = facts.groupBy("__source", F.col("__block").alias("cell")).agg(F.sum("tokens").alias("tokens"))
    place = draw(F.lit(seed), "__source", "passes", "cell")
    last = cut(blocks.join(wanted, "__source"), place)
    inside = facts.join(
        last.select("__source", F.col("cell").alias("__block"), "taken"), ["__source", "__block"]
    )
    parts = inside.groupBy("__source", "taken", F.col("__part").alias("cell")).agg(F.sum("tokens").alias("tokens"))
    parts = parts.join(wanted, "__source").withColumn("rest", F.expr("rest - taken")).drop("taken")
    stop = cut(parts, F.col("cell")).select("__source", F.col("cell").alias("stop_part"))
    plan = sources.join(
        last.select("__source", F.col("order").alias("last_order"), F.col("cell").alias("last_block")),
        "__source", "left",
    ).join(stop, "__source", "left")
    return keep(plan)


def mixed(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    budget: int | None = None,
    max_repeat: float = MAX_REPEAT,
    entropy: float | None = None,
    seed: str = "mix",
) -> DataFrame:
    """The rows of docs that the mix holds, one per pass, with __source, __pass, __block, __place.

    ``budget`` counts words and is by default what docs hold. The sources' shares get the
    least exponent with which none is repeated over ``max_repeat`` times (the greatest
    that still reaches ``entropy`` nats, if given; words are then drawn as often as that
    takes). A limit or an entropy that no exponent reaches is an error. A null source is the source ''; null
    and empty texts have no words and go with their block; a source without any word has
    no weight and is left out. Equal ids of a source share their place, so repeated rows
    are drawn together; a null id is an id. Columns of docs keep their names and values;
    names that begin with two underscores are reserved.
    """
    rows = placed(docs, id_col, source_col, seed)
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    facts = keep(rows.select("__source", "__block", "__part", words.alias("tokens")))
    plan = mixing_plan(facts, budget, max_repeat, entropy, seed)
    plan = plan.select("__source", F.col("passes").alias("__passes"), F.col("last_order").alias("__last"), F.col("last_block").alias("__last_block"), F.col("stop_part").alias("__stop"))
    rows = rows.join(plan, "__source")
    order = draw(F.lit(seed), "__source", "__passes", "__block")
    in_cut = (F.col("__block") == F.col("__last_block")) & (F.col("__part") < F.col("__stop"))
    before = (order < F.col("__last")) | (
        (order == F.col("__last")) & (F.col("__block") < F.col("__last_block"))
    )
    more = F.coalesce(before | in_cut, F.lit(False)).cast("long")
    copies = F.col("__passes") + more
    last = F.sequence(F.lit(0).cast("long"), copies - 1)
    rows = rows.filter(copies > 0).withColumn("__pass", F.explode(last))
    rows = rows.withColumn("__place", draw(F.lit(seed), "__source", "__pass", "__block"))
    return rows.drop("__passes", "__last", "__last_block", "__stop", "__part")


def entropy_of(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


