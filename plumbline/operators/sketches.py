"""Approximate distinct counts that merge: stored sketches of columns, part by part.

A part of a table leaves one row a column with its counts and a HyperLogLog sketch, in
one scan and without moving a value. Profiles of parts, days or sources merge from these
rows, so the values aren't read again. Exact counts are facts.cardinality.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators.facts import FRACTIONAL, kind_of

#: 2**14 registers: a sketch is at most 8 KB and errs by 0.8 % in one standard deviation.
LG_REGISTERS = 14
#: Bounds hold for all but a share of 6e-5 of the estimates.
DEVIATIONS = 4.0


def _value(df: DataFrame, name: str) -> Column:
    """Equal values alike: numbers as text, without a negative zero."""
    c = X.ref(name)
    if kind_of(df.schema[name].dataType) == FRACTIONAL:
        c = F.when(c == 0, F.abs(c)).otherwise(c)
    return c.cast("string")


def column_sketches(df: DataFrame, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(ordinal, column, rows, non_null, sketch) of each column; sketch is null without values."""
    stats = []
    for i, name in enumerate(df.columns):
        c = X.ref(name)
        sketch = F.when(F.count(c) > 0, F.hll_sketch_agg(_value(df, name), F.lit(lg_registers)))
        stats.append(F.struct(
            F.lit(i).alias("ordinal"), F.lit(name).alias("column"), F.count("*").alias("rows"),
            F.count(c).alias("non_null"), sketch.alias("sketch"),
        ))
    return df.agg(F.array(*stats).alias("s")).select(F.inline("s"))


def merged(sketches: DataFrame) -> DataFrame:
    """Rows of column_sketches of many parts as one row a column."""
    return sketches.groupBy("ordinal", "column").agg(
        F.sum("rows").alias("rows"),
        F.sum("non_null").alias("non_null"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def estimates(sketches: DataFrame, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """column, rows, non_null, unique_estimate and its bounds."""
    error = DEVIATIONS * 1.04 / math.sqrt(2**lg_registers)
    n = F.when(F.col("non_null") > 0, F.hll_sketch_estimate("sketch")).otherwise(0)
    return sketches.select("ordinal", "column", "rows", "non_null", n.alias("unique_estimate")).select(
        "*",
        F.floor(F.col("unique_estimate") / (1 + error)).alias("unique_low"),
        F.ceil(F.col("unique_estimate") / (1 - error)).alias("unique_high"),
    )
