"""Whole-row duplicates: counting them and keeping the first of each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators.facts import STRING, kind_of
from plumbline.session import keep


def data_columns(
    df: DataFrame, columns: Sequence[str] | None, order_by: Sequence[str]
) -> list[str]:
    """The columns asked for, or all but those that only define the order."""
    return list(columns or [c for c in df.columns if c not in order_by] or df.columns)


def _cells(df: DataFrame, columns: Sequence[str] | None = None, normalize: bool = False) -> list:
    """Columns with their types; text stripped and lower-cased, null staying null."""
    out = []
    for c in columns or df.columns:
        data_type = df.schema[c].dataType
        cell = X.ref(c)
        if normalize and kind_of(data_type) == STRING:
            cell = F.lower(X.strip(cell))
        out.append((cell, data_type))
    return out


def duplicate_counts(df: DataFrame, with_normalized: bool = True) -> DataFrame:
    """One row: affected and extra rows, exact and after normalising text.

    One scan and one shuffle of row keys serve both comparisons: rows with equal
    cells have equal normalised cells, so exact groups nest in normalised ones.
    Copies of one row collapse before the shuffle, however many there are.
    """
    has_text = any(kind_of(f.dataType) == STRING for f in df.schema.fields)
    with_normalized = with_normalized and has_text
    exact = {f"e{i}": c for i, c in enumerate(X.row_keys(_cells(df)))}
    loose = {}
    if with_normalized:
        loose = {f"l{i}": c for i, c in enumerate(X.row_keys(_cells(df, normalize=True)))}
        # plain keys are the same columns in both; only the digests differ
        loose = {n: c for n, c in list(loose.items())[-1:]}
    keys = df.select(*[c.alias(n) for n, c in (exact | loose).items()])
    groups = keys.groupBy(*exact, *loose).agg(F.count("*").alias("n"))
    n, m = F.col("n"), F.col("m")
    exact_sums = [
        F.sum(F.when(n > 1, n).otherwise(0)).alias("exact_affected"),
        F.sum(n - 1).alias("exact_extra"),
    ]
    if not with_normalized:
        sums = groups.agg(F.sum("n").alias("rows"), *exact_sums)
        totals = sums.withColumn("loose_affected", F.lit(None).cast("bigint")).withColumn(
            "loose_extra", F.lit(None).cast("bigint")
        )
    else:
        shared = list(exact)[:-1]
        per_loose = groups.groupBy(*shared, *loose).agg(F.sum("n").alias("m"), *exact_sums)
        totals = per_loose.agg(
            F.sum("m").alias("rows"),
            F.sum("exact_affected").alias("exact_affected"),
            F.sum("exact_extra").alias("exact_extra"),
            F.sum(F.when(m > 1, m).otherwise(0)).alias("loose_affected"),
            F.sum(m - 1).alias("loose_extra"),
        )
    names = ("rows", "exact_affected", "exact_extra", "loose_affected", "loose_extra")
    return totals.select(*[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names])


def keep_first(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """One row of each group of identical rows, the first by order_by.

    Columns outside the comparison (such as order_by) decide in their order and keep the
    first row's values. Row keys are grouped, with map-side combine; only keys that occur
    twice are kept, each with its first place. An anti-join drops the rows behind them,
    and rows that are equal throughout collapse last. A table without duplicates comes
    back as it is.
    """
    columns = data_columns(df, columns, order_by)
    rest = [c for c in order_by if c not in columns]
    rest += [c for c in df.columns if c not in columns and c not in rest]
    keys = {f"__k{i}": c for i, c in enumerate(X.row_keys(_cells(df, columns)))}
    place = F.struct(F.lit(0).alias("p"), *[X.ref(c).alias(f"p{n}") for n, c in enumerate(rest)])
    marked = df.withColumns(keys).withColumn("__place", place)
    places = marked.groupBy(*keys, "__place").agg(F.count("*").alias("copies"))
    groups = places.groupBy(*keys).agg(
        F.sum("copies").alias("n"), F.min(F.struct("__place", "copies")).alias("m")
    )
    repeated = keep(
        groups.where("n > 1").select(
            *[F.col(n).alias(n + "r") for n in keys],
            F.col("m.__place").alias("__first"),
            (F.col("m.copies") > 1).alias("__tied"),
        )
    )
    if repeated.isEmpty():
        return df
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(n + "r")) for n in keys])
    is_first = F.col("__place").eqNullSafe(F.col("__first"))
    behind = same & (~is_first | F.col("__tied"))
    tied = same & is_first & F.col("__tied")
    single = marked.join(repeated, behind, "left_anti").drop(*keys, "__place")
    equal = marked.join(repeated, tied, "left_semi").drop(*keys, "__place")
    return single.unionByName(equal.dropDuplicates())
