"""Quality score: weighted dimensions with textual deductions.

Points are decimals, so their sum does not depend on the order in which Spark
adds them, and half-even rounding meets exact ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import constants as k
from plumbline.functions import sqltext as Q

DIMENSIONS = ("completeness", "validity", "uniqueness", "consistency")
VALIDITY_TYPES = (
    "invalid_email", "impossible_percentage", "negative_value_violation", "malformed_phone",
    "invalid_date",
)
TEXT_TYPES = (
    "near_empty_text", "extremely_long_text", "repeated_text_anomaly",
    "whitespace_formatting_anomaly",
)


def _flat(points: float) -> str:
    return f"cast({points} as decimal(20,6))"


def _share(factor: float, low: float, high: float, percentage: str = "percentage") -> str:
    exact = f"cast(cast({percentage} as decimal(9,2)) * cast({factor} as decimal(9,4)) as decimal(20,6))"
    return f"least({_flat(high)}, greatest({_flat(low)}, {exact}))"


def _rules(penalties: dict) -> list[tuple[str, str, str, str]]:
    """(dimension, condition, points, note) for each kind of issue, as SQL."""
    w = penalties
    is_high = "severity = 'high'"
    is_type = lambda t: f"type = '{t}'"
    return [
        (
            "completeness",
            is_type("empty_column"),
            _flat(w["empty_column"]),
            k.SCORE_NOTES["empty_column"],
        ),
        (
            "completeness",
            is_type("high_missing_percentage"),
            f"if({is_high}, {_flat(w['high_missing'])}, {_flat(w['elevated_missing'])})",
            k.SCORE_NOTES["high_missing_percentage"],
        ),
        (
            "validity",
            f"type in ({Q.words(VALIDITY_TYPES)})",
            f"if({is_high}, {_share(w['high_factor'], 5, 35)}, "
            f"{_share(w['medium_factor'], 5, 35)})",
            k.SCORE_NOTES["validity"].replace("{y}", "{y_words}"),
        ),
        *[
            ("uniqueness", is_type(t), _share(factor, 0, most), k.SCORE_NOTES[t])
            for t, factor, most in (
                ("duplicate_rows", 1.5, 60),
                ("duplicate_identifier", 1.2, 40),
                ("normalized_duplicate_rows", 0.8, 25),
            )
        ],
        (
            "consistency",
            is_type("constant_column"),
            _flat(w["constant"]),
            k.SCORE_NOTES["constant_column"],
        ),
        (
            "consistency",
            is_type("low_variance_column"),
            _flat(w["low_variance"]),
            k.SCORE_NOTES["low_variance_column"],
        ),
        ("consistency", is_type("outliers"), _share(0.5, 3, 20), k.SCORE_NOTES["outliers"]),
        (
            "consistency",
            f"type in ({Q.words(TEXT_TYPES)})",
            _share(0.3, 2, 15),
            k.SCORE_NOTES["text"],
        ),
    ]


_SLOTS = {
    "c": "column",
    "n": "affected_rows",
    "p": "percentage",
    "d": Q.fixed("points", 1),
    "y": "type",
    "y_words": "replace(type, '_', ' ')",
}


def deductions(
    issues: DataFrame, dimensions: DataFrame, penalties: dict = k.SCORE_PENALTIES
) -> DataFrame:
    """Every deduction: dimension, position in the issue list, points and note."""
    rules = _rules(penalties)
    dimension = Q.choose([(when, Q.literal(d)) for d, when, _, _ in rules])
    points = Q.choose([(when, value) for _, when, value, _ in rules])
    note = Q.choose([(when, Q.fill(template, **_SLOTS)) for _, when, _, template in rules])
    from_issues = (
        issues.selectExpr("*", f"{dimension} as dimension", f"{points} as points")
        .where("dimension is not null")
        .selectExpr("dataset_id", "dimension", "ordinal as position", "points", f"{note} as note")
    )
    null_pct = Q.pct("null_cells", "total_cells")
    from_nulls = (
        dimensions.where("null_cells > 0")
        .selectExpr("dataset_id", "null_cells as affected_rows", f"{null_pct} as percentage")
        .selectExpr("*", f"{_share(1, 0, 40)} as points")
        .selectExpr(
            "dataset_id",
            "'completeness' as dimension",
            "0 as position",
            "points",
            f"{Q.fill(k.SCORE_NOTES['null_cells'], **_SLOTS)} as note",
        )
    )
    return from_nulls.unionByName(from_issues)


def dimension_scores(
    issues: DataFrame, dimensions: DataFrame, penalties: dict = k.SCORE_PENALTIES
) -> DataFrame:
    """Four rows per dataset: dimension, points lost, score, notes in issue order."""
    wanted = dimensions.selectExpr(
        "dataset_id", f"explode(array({Q.words(DIMENSIONS)})) as dimension"
    )
    lost = deductions(issues, dimensions, penalties)
    joined = wanted.join(lost, ["dataset_id", "dimension"], "left")
    return (
        joined.groupBy("dataset_id", "dimension")
        .agg(
            F.expr("coalesce(sum(points), cast(0 as decimal(20,6)))").alias("points"),
            F.expr("collect_list(if(note is null, null, struct(position, note)))").alias("found"),
        )
        .selectExpr(
            "dataset_id",
            "dimension",
            "cast(points as double) as deducted",
            "greatest(0, least(100, cast(bround(100 - points, 0) as int))) as score",
            "transform(array_sort(found), d -> d.note) as notes",
        )
    )


def score(
    issues: DataFrame,
    dimensions: DataFrame,
    weights: dict = k.SCORE_WEIGHTS,
    penalties: dict = k.SCORE_PENALTIES,
) -> DataFrame:
    """One row per dataset: overall, the four dimensions and the explanation."""
    perfect = Q.choose(
        [(f"dimension = '{d}'", Q.literal(text)) for d, text in k.SCORE_PERFECT.items()]
    )
    head = {"k": "initcap(dimension)", "s": "score"}
    with_notes = Q.fill(k.SCORE_LINE, **head, notes="array_join(notes, '; ')")
    without = Q.fill(k.SCORE_LINE_PERFECT, **head, notes=perfect)
    lines = dimension_scores(issues, dimensions, penalties).selectExpr(
        "dataset_id", "dimension", "score", f"if(size(notes) > 0, {with_notes}, {without}) as line"
    )
    wide = lines.groupBy("dataset_id").agg(
        *[
            F.expr(f"max({value}) filter (where dimension = '{d}')").alias(f"{d}{suffix}")
            for value, suffix in (("score", ""), ("line", "_line"))
            for d in DIMENSIONS
        ]
    )
    weighted = " + ".join(f"cast({weights[d]} as decimal(9,4)) * {d}" for d in DIMENSIONS)
    shares = {
        slot: str(int(weights[d] * 100))
        for slot, d in zip(("wc", "wv", "wu", "ws"), DIMENSIONS, strict=True)
    }
    top_line = Q.fill(k.SCORE_OVERALL_LINE, s="overall", **shares)
    return wide.selectExpr(
        "*", f"greatest(0, least(100, cast(bround({weighted}, 0) as int))) as overall"
    ).selectExpr(
        "dataset_id",
        "overall",
        *DIMENSIONS,
        f"array({top_line}, {', '.join(d + '_line' for d in DIMENSIONS)}) as explanation",
    )


# ---- tiers --------------------------------------------------------------------------


def tier(score_column: Column, labels: tuple = k.REPORT_TIERS) -> Column:
    return (
        F.when(score_column >= 85, labels[0])
        .when(score_column >= 70, labels[1])
        .when(score_column >= 50, labels[2])
        .otherwise(labels[3])
    )


def with_tiers(scores: DataFrame) -> DataFrame:
    return scores.select(
        "dataset_id",
        "overall",
        tier(F.col("overall")).alias("report_tier"),
        tier(F.col("overall"), k.DASHBOARD_TIERS).alias("dashboard_tier"),
    )


def bands(scores: DataFrame) -> DataFrame:
    """Per dimension: band and distance to the target score."""
    long = scores.unpivot(["dataset_id"], list(DIMENSIONS), "dimension", "score")
    value = F.col("score")
    return long.select(
        "dataset_id",
        "dimension",
        "score",
        F.when(value >= 85, "excellent")
        .when(value >= 70, "good")
        .when(value >= 50, "fair")
        .otherwise("critical")
        .alias("band"),
        F.greatest(F.lit(0), F.lit(k.TARGET_SCORE) - value).alias("below_target"),
    )
