"""Column profile over column facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import exprs as X
from plumbline.operators.facts import (
    BOOLEAN,
    FRACTIONAL,
    INTEGRAL,
    NUMERIC,
    STRING,
    TEMPORAL,
    value_counts,
)

# Columns with up to this many distinct values get a value distribution.
FEW_VALUES = 25
# Distinct counts and shares that make text categorical.
CATEGORICAL_VALUES, CATEGORICAL_ROWS, CATEGORICAL_SHARE = 20, 50, 0.05


def null_count() -> Column:
    return F.col("rows") - F.col("non_null")


def dimensions(facts: DataFrame, file_format: str) -> DataFrame:
    """Rows, columns, cells and null cells per dataset."""
    return facts.groupBy("dataset_id").agg(
        F.max("rows").alias("row_count"),
        F.count("*").alias("column_count"),
        F.sum("rows").alias("total_cells"),
        F.sum(null_count()).alias("null_cells"),
        F.lit(file_format).alias("file_format"),
    )


# Bytes of one value of a fixed-width type.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}


def footprint(facts: DataFrame) -> DataFrame:
    """Bytes per dataset: UTF-8 bytes of text, fixed widths of the other values."""
    dtype = F.col("original_dtype")
    width = reduce(
        lambda w, t: w.when(dtype == t, WIDTHS[t]), WIDTHS, F.when(F.lit(False), 0)
    ).otherwise(8)
    size = F.when(F.col("kind") == STRING, F.coalesce("octets", F.lit(0))).otherwise(
        width * F.col("non_null")
    )
    total = F.col("bytes")
    human = (
        F.when(total < 1024, F.concat(X.text(total), F.lit(" B")))
        .when(total < 1024 * 1024, F.concat(X.fixed(total / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(X.fixed(total / (1024 * 1024), 2), F.lit(" MB")))
    )
    return (
        facts.groupBy("dataset_id")
        .agg(F.sum(size).cast("bigint").alias("bytes"))
        .withColumn("size", human)
    )


# ---- logical types ------------------------------------------------------------------


def with_types(facts: DataFrame) -> DataFrame:
    """Adds date detection and the logical type of every column."""
    n = F.nullif(F.col("non_null"), F.lit(0))
    looked_at = F.coalesce("date_values", "non_null")
    seen = F.nullif(looked_at, F.lit(0))
    iso, delimited, named = map(F.col, ("iso", "delimited", "named"))
    family = (
        F.when(iso / seen >= 0.8, "ISO 8601 (YYYY-MM-DD)")
        .when(delimited / seen >= 0.8, "Delimited Date (MM/DD/YYYY or DD/MM/YYYY)")
        .when(named / seen >= 0.8, "Named Month Date")
        .when((iso + delimited + named) / seen >= 0.7, "Standard Date")
    )
    written_date = (
        (F.col("kind") == STRING)
        & (F.col("short_numbers") / seen <= 0.3)
        & family.isNotNull()
        & (F.col("dates") / seen >= 0.9)
        & (F.col("dates") == F.col("dates_in_range"))
    )
    temporal = F.col("kind") == TEMPORAL
    is_date = temporal | F.coalesce(written_date, F.lit(False))
    # {true, false}, {yes, no}, {y, n} or {t, f}, each completely present
    truth_words = F.coalesce(F.col("truth_bits").isin(3, 12, 48, 192), F.lit(False))
    unique, filled = F.col("unique"), F.col("non_null")
    few = (unique <= CATEGORICAL_VALUES) | (
        (filled > CATEGORICAL_ROWS) & (unique / n <= CATEGORICAL_SHARE)
    )
    return (
        facts.withColumn("is_date", is_date)
        .withColumn(
            "date_confidence",
            F.when(temporal, 1.0).when(is_date, X.quotient(F.col("dates"), looked_at, 100)),
        )
        .withColumn("date_format", F.when(temporal, "datetime64").when(is_date, family))
        .withColumn("date_earliest", F.when(is_date, F.col("earliest")))
        .withColumn("date_latest", F.when(is_date, F.col("latest")))
        .withColumn(
            "inferred_type",
            F.when(is_date, "datetime")
            .when((F.col("kind") == BOOLEAN) | truth_words, "boolean")
            .when(F.col("kind").isin(*NUMERIC), "numeric")
            .when((filled > 0) & few, "categorical")
            .otherwise("text"),
        )
    )


def has_distribution() -> Column:
    return F.col("inferred_type").isin("categorical", "boolean") | F.col("unique").between(
        1, FEW_VALUES
    )


# ---- value distributions ------------------------------------------------------------

TOP_VALUES = "dataset_id string, ordinal int, column string, rank int, value string, count bigint, percentage double"


def top_values(cells: DataFrame, typed_facts: DataFrame, top_n: int = 10) -> DataFrame:
    """The most frequent values of low-cardinality columns, ties by value.

    Only qualifying columns are read again. The rank filter is applied before
    the shuffle (Spark limits each group per task), so a task sends at most
    top_n rows per column.
    """
    chosen = typed_facts.where(has_distribution() & (F.col("non_null") > 0))
    ordinals = [r["ordinal"] for r in chosen.select("ordinal").collect()]
    if not ordinals:
        return cells.sparkSession.createDataFrame([], TOP_VALUES)
    counts = reduce(
        DataFrame.unionByName,
        [
            c.select(F.col("ordinal").cast("int").alias("ordinal"), X.text(F.col("value")).alias("value"), "n")
            for c in value_counts(cells, ordinals, whole=True)
        ],
    )
    order = Window.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n)
    return ranked.join(
        F.broadcast(chosen.select("dataset_id", "ordinal", "column", "non_null")), "ordinal"
    ).select(
        "dataset_id", "ordinal", "column", "rank", "value", F.col("n").alias("count"),
        X.pct(F.col("n"), F.col("non_null")).alias("percentage"),
    )


# ---- assembly -----------------------------------------------------------------------


def finite(c: Column) -> Column:
    """Four decimals; infinities and NaN become null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.round(c, 4))


def assemble(typed_facts: DataFrame, top: DataFrame) -> DataFrame:
    """One row per column with the parts that fit its type as structs."""
    rows, filled = F.col("rows"), F.col("non_null")
    kind = F.col("inferred_type")
    numbers = (kind == "numeric") & (filled > 0)
    texts = kind.isin("text", "categorical") & (filled > 0)
    numeric = F.struct(
        *[
            finite(F.col(source)).alias(name)
            for name, source in (
                ("min", "mn"), ("max", "mx"), ("mean", "mean"), ("median", "q50"),
                ("std", "sd"), ("q25", "q25"), ("q50", "q50"), ("q75", "q75"),
            )
        ]
    )
    lengths = F.struct(
        F.col("len_min").alias("min_length"),
        F.col("len_max").alias("max_length"),
        X.quotient(F.col("len_sum"), filled, 100).alias("avg_length"),
    )
    dates = F.struct(
        F.col("is_date"),
        F.col("date_confidence").alias("confidence"),
        F.col("date_format").alias("detected_format"),
        F.col("date_earliest").alias("earliest"),
        F.col("date_latest").alias("latest"),
    )
    listed = top.groupBy("dataset_id", "ordinal").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value", "count", "percentage"))),
            lambda v: F.struct(v["value"], v["count"], v["percentage"]),
        ).alias("top_values")
    )
    columns = typed_facts.select(
        "dataset_id",
        "ordinal",
        F.col("column").alias("name"),
        "inferred_type",
        "original_dtype",
        filled.alias("non_null_count"),
        null_count().alias("null_count"),
        X.pct(null_count(), rows).alias("null_percentage"),
        F.col("unique").alias("unique_count"),
        X.pct(F.col("unique"), rows).alias("unique_percentage"),
        F.when(numbers, numeric).alias("numeric_stats"),
        F.when(texts, lengths).alias("text_stats"),
        F.when(F.col("is_date"), dates).alias("date_stats"),
    )
    return columns.join(listed, ["dataset_id", "ordinal"], "left").orderBy(
        "dataset_id", "ordinal"
    )


def flat(profile: DataFrame) -> DataFrame:
    """The profile with its structs spread into columns and the first top value."""
    top = F.try_element_at("top_values", F.lit(1))
    return profile.select(
        "dataset_id", "ordinal", "name", "inferred_type", "non_null_count", "null_count",
        "null_percentage", "unique_count", "unique_percentage",
        F.col("numeric_stats.min").alias("min"),
        F.col("numeric_stats.max").alias("max"),
        F.col("numeric_stats.mean").alias("mean"),
        F.col("numeric_stats.median").alias("median"),
        F.col("numeric_stats.std").alias("std"),
        F.col("numeric_stats.q25").alias("q25"),
        F.col("numeric_stats.q75").alias("q75"),
        F.col("text_stats.min_length").alias("min_length"),
        F.col("text_stats.max_length").alias("max_length"),
        F.col("text_stats.avg_length").alias("avg_length"),
        F.col("date_stats.confidence").alias("date_confidence"),
        F.col("date_stats.detected_format").alias("date_format"),
        F.col("date_stats.earliest").alias("earliest"),
        F.col("date_stats.latest").alias("latest"),
        top["value"].alias("top_value"),
        top["count"].alias("top_count"),
        top["percentage"].alias("top_percentage"),
    )
