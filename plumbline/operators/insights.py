"""Compact summaries and deterministic insights from profile, issues and score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import constants as k
from plumbline.functions import exprs as X
from plumbline.functions import sqltext as Q
from plumbline.operators import facts as fx
from plumbline.operators.privacy import redact_text
from plumbline.operators.score import DIMENSIONS

IS_TEXT_ISSUE = "(contains(type, 'text') or contains(type, 'whitespace'))"
TOP_PRIORITIES = 5
TOP_OBSERVATIONS = 3
SAMPLES = 2


def column_summary(profile: DataFrame) -> DataFrame:
    """Name, type, null share, distinct count and number or length statistics."""
    is_number = "numeric_stats is not null"
    return profile.selectExpr(
        "dataset_id",
        "ordinal",
        "name",
        "inferred_type",
        "null_percentage",
        "unique_count",
        "numeric_stats.min as min",
        "numeric_stats.max as max",
        "numeric_stats.mean as mean",
        "numeric_stats.median as median",
        f"if({is_number}, null, text_stats.min_length) as min_length",
        f"if({is_number}, null, text_stats.max_length) as max_length",
        f"if({is_number}, null, text_stats.avg_length) as avg_length",
    )


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.drop("method")


def redacted_samples(
    df: DataFrame, issues: DataFrame, order_by: Sequence[str], samples: int = SAMPLES
) -> DataFrame:
    """The first values of each column with a text issue, with personal data masked.

    One scan serves all columns; a task passes on the first rows of each by order key.
    """
    wanted = [
        r["column"]
        for r in issues.where(f"{IS_TEXT_ISSUE} and column is not null")
        .select("column")
        .distinct()
        .orderBy("column")
        .collect()
    ]
    texts = [c for c in wanted if c in df.columns and fx.kind_of(df.schema[c].dataType) == fx.STRING]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, sample_no int, sample string")
    place = F.struct(*[X.ref(c).alias(f"p{i}") for i, c in enumerate(order_by or df.columns)])
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), X.text(X.ref(c)).alias("value")) for c in texts]
    )
    rows = df.select(place.alias("place"), F.explode(cells).alias("cell")).select("place", "cell.*")
    first = F.row_number().over(Window.partitionBy("column").orderBy("place"))
    return (
        rows.where("value is not null")
        .withColumn("sample_no", first)
        .where(F.col("sample_no") <= samples)
        .select("column", "sample_no", redact_text(F.col("value")).alias("sample"))
    )


def executive_summary(scores: DataFrame, dimensions: DataFrame) -> DataFrame:
    """One sentence chosen by the overall score."""

    def weak(limit: int, default: str) -> str:
        named = ", ".join(f"if({d} < {limit}, '{d}', null)" for d in DIMENSIONS)
        return f"coalesce(nullif(concat_ws(', ', {named}), ''), {Q.literal(default)})"

    slots = {
        "f": "upper(file_format)",
        "s": "overall",
        "r": Q.grouped("row_count"),
        "k": "column_count",
        "completeness": "completeness",
        "validity": "validity",
    }
    moderate = slots | {"dims": weak(75, k.SUMMARY_MODERATE_DEFAULT)}
    critical = slots | {"dims": weak(60, k.SUMMARY_CRITICAL_DEFAULT)}
    text = Q.choose(
        [
            ("overall >= 85", Q.fill(k.SUMMARY_STRONG, **slots)),
            ("overall >= 60", Q.fill(k.SUMMARY_MODERATE, **moderate)),
        ],
        Q.fill(k.SUMMARY_CRITICAL, **critical),
    )
    return scores.join(dimensions, "dataset_id").selectExpr("dataset_id", f"{text} as summary")


def priorities(issues: DataFrame, dimensions: DataFrame) -> DataFrame:
    """The first five issues, high before medium, each with its advice."""
    order = Window.partitionBy("dataset_id").orderBy(
        F.expr("if(severity = 'high', 0, 1)"), "ordinal"
    )
    first = (
        issues.where("severity in ('high', 'medium')")
        .withColumn("rank", F.row_number().over(order))
        .where(f"rank <= {TOP_PRIORITIES}")
    )
    slots = {
        "c": f"coalesce(column, {Q.literal(k.PRIORITY_NO_COLUMN)})",
        "n": Q.grouped("affected_rows"),
        "p": "percentage",
        "r": Q.grouped("row_count"),
        "title": "initcap(replace(type, '_', ' '))",
        "description": "description",
    }
    texts = [
        Q.choose(
            [(f"type = '{t}'", Q.fill(v[i], **slots)) for t, v in k.PRIORITY_TEXTS.items()],
            Q.fill(k.PRIORITY_OTHER[i], **slots),
        )
        for i in range(4)
    ]
    parts = ("issue", "importance", "explanation", "recommendation")
    nothing = [f"coalesce({p}, {Q.literal(v)}) as {p}" for p, v in zip(parts, k.PRIORITY_NONE, strict=True)]
    advised = first.join(dimensions.select("dataset_id", "row_count"), "dataset_id").selectExpr(
        "dataset_id", "rank", *[f"{t} as {p}" for t, p in zip(texts, parts, strict=True)]
    )
    return (
        dimensions.select("dataset_id")
        .join(advised, "dataset_id", "left")
        .selectExpr("dataset_id", "coalesce(rank, 1) as rank", *nothing)
    )


def cleaning_plan(issues: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Numbered steps for the issue types that are present."""
    empties = "array_sort(collect_list(if(type = 'empty_column', struct(ordinal, column), null)))"
    has = lambda *types: f"coalesce(bool_or(type in ({Q.words(types)})), false)"
    flags = (
        dimensions.select("dataset_id")
        .join(issues, "dataset_id", "left")
        .groupBy("dataset_id")
        .agg(
            F.expr(f"array_join(transform({empties}, e -> e.column), ', ')").alias("names"),
            F.expr(has("empty_column")).alias("empty"),
            F.expr(has("duplicate_rows")).alias("copies"),
            F.expr(
                has("invalid_email", "impossible_percentage", "negative_value_violation")
            ).alias("rules"),
            F.expr(has("missing_values", "high_missing_percentage")).alias("missing"),
            F.expr(has("outliers")).alias("outliers"),
        )
    )
    steps = ", ".join(
        f"if({flag}, {text}, null)"
        for flag, text in (
            ("empty", Q.fill(k.PLAN_EMPTY, names="names")),
            ("copies", Q.literal(k.PLAN_DUPLICATES)),
            ("rules", Q.literal(k.PLAN_RULES)),
            ("missing", Q.literal(k.PLAN_MISSING)),
            ("outliers", Q.literal(k.PLAN_OUTLIERS)),
        )
    )
    listed = f"filter(array({steps}), s -> s is not null)"
    return flags.selectExpr(
        "dataset_id",
        f"posexplode(if(size({listed}) = 0, array({Q.literal(k.PLAN_NOTHING)}), {listed})) "
        "as (position, text)",
    ).selectExpr(
        "dataset_id",
        "cast(position + 1 as int) as step",
        "format_string('Step %d: %s', position + 1, text) as action",
    )


def text_observations(issues: DataFrame) -> DataFrame:
    order = Window.partitionBy("dataset_id").orderBy("ordinal")
    return (
        issues.where(IS_TEXT_ISSUE)
        .withColumn("position", F.row_number().over(order))
        .where(f"position <= {TOP_OBSERVATIONS}")
        .selectExpr(
            "dataset_id",
            "position",
            "format_string('Column \\'%s\\': %s', column, description) as observation",
        )
    )


def client_summary(issues: DataFrame, dimensions: DataFrame, scores: DataFrame) -> DataFrame:
    """The short client-side form: a sentence, the first three issues, a fixed plan."""
    counts = dimensions.join(scores, "dataset_id").join(
        issues.groupBy("dataset_id").agg(F.count("*").alias("found")), "dataset_id", "left"
    )
    sentence = Q.fill(
        k.CLIENT_SUMMARY,
        r=Q.grouped("row_count"),
        k="column_count",
        s="overall",
        n="coalesce(found, 0)",
    )
    summary = counts.selectExpr(
        "dataset_id", "'summary' as part", "1 as position", f"{sentence} as headline",
        "cast(null as string) as importance", "cast(null as string) as detail",
        "cast(null as string) as recommendation",
    )
    advice = Q.fill(
        k.CLIENT_RECOMMENDATION, n="affected_rows", c="coalesce(column, 'dataset')"
    )
    first = issues.where("ordinal <= 3").selectExpr(
        "dataset_id",
        "'issue' as part",
        "cast(ordinal as int) as position",
        "replace(type, '_', ' ') as headline",
        "if(severity = 'high', 'Critical', 'Medium') as importance",
        "description as detail",
        f"{advice} as recommendation",
    )
    plan = dimensions.selectExpr(
        "dataset_id", f"posexplode(array({Q.words(k.CLIENT_PLAN)})) as (position, headline)"
    ).selectExpr(
        "dataset_id", "'plan' as part", "cast(position + 1 as int) as position", "headline",
        "cast(null as string) as importance", "cast(null as string) as detail",
        "cast(null as string) as recommendation",
    )
    return summary.unionByName(first).unionByName(plan)
