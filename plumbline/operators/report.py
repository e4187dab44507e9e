"""Report data and dashboard roll-ups over profile, issues and score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions import sqltext as Q

VALIDATION_WORDS = ("invalid", "constant", "low_variance", "negative")
# Two validity types whose names hold none of the words above.
VALIDATION_EXTRA = ("impossible", "malformed")
TOP_VALIDATION = 8
TOP_RECOMMENDATIONS = 4
TOP_NULL_COLUMNS = 8


def missing_totals(profile: DataFrame) -> DataFrame:
    """Null cells, all cells, their share, and how many columns have nulls."""
    return (
        profile.groupBy("dataset_id")
        .agg(
            F.sum("null_count").alias("total_missing"),
            F.sum(F.col("null_count") + F.col("non_null_count")).alias("total_cells"),
            F.count_if(F.col("null_count") > 0).alias("columns_with_nulls"),
            F.count("*").alias("column_count"),
        )
        .selectExpr(
            "dataset_id",
            "total_missing",
            "total_cells",
            f"{Q.pct('total_missing', 'total_cells')} as missing_pct",
            "columns_with_nulls",
            "column_count",
        )
    )


def issue_sections(issues: DataFrame, complete: bool = False) -> DataFrame:
    """Duplicate, validation and outlier sections; an issue may be in none."""
    words = VALIDATION_WORDS + (VALIDATION_EXTRA if complete else ())
    validation = " or ".join(f"contains(type, '{w}')" for w in words)
    section = Q.choose(
        [
            ("contains(type, 'duplicate')", "'duplicate'"),
            (validation, "'validation'"),
            ("contains(type, 'outlier')", "'outlier'"),
        ]
    )
    return issues.selectExpr(f"{section} as section", "*").where("section is not null")


def text_columns(profile: DataFrame) -> DataFrame:
    return profile.where("inferred_type = 'text' or text_stats is not null").selectExpr(
        "dataset_id",
        "ordinal",
        "name",
        "inferred_type",
        "text_stats.min_length as min_length",
        "text_stats.max_length as max_length",
        "text_stats.avg_length as avg_length",
    )


def column_lines(profile: DataFrame) -> DataFrame:
    """One line of statistics per column, long and short."""
    f = lambda value, digits=1: Q.fixed(value, digits)
    n, t = "numeric_stats", "text_stats"
    top = "try_element_at(top_values, 1)"
    long = Q.choose(
        [
            (
                f"{n}.mean is not null",
                f"concat('Min: ', {f(n + '.min')}, ' • Mean: ', {f(n + '.mean')}, "
                f"' • Max: ', {f(n + '.max')})",
            ),
            (
                f"{t}.avg_length is not null",
                f"concat('Len min: ', {t}.min_length, ' • avg: ', {f(t + '.avg_length')}, "
                f"' • max: ', {t}.max_length)",
            ),
            (
                f"{top} is not null",
                f"concat('Top: \\'', {top}.value, '\\' (', {f(top + '.percentage')}, '%)')",
            ),
        ],
        "'—'",
    )
    short = Q.choose(
        [
            (
                f"{n}.mean is not null",
                f"concat('[', {f(n + '.min')}, ', ', {f(n + '.max')}, '] μ=', {f(n + '.mean')})",
            ),
            (
                f"{t}.avg_length is not null",
                f"concat('len avg=', {f(t + '.avg_length')}, ' (max ', {t}.max_length, ')')",
            ),
            (
                f"{top} is not null",
                f"concat('top: \\'', substring({top}.value, 1, 10), '\\' (', "
                f"{f(top + '.percentage', 0)}, '%)')",
            ),
        ],
        "'—'",
    )
    return profile.selectExpr(
        "dataset_id",
        "ordinal",
        "name",
        f"{long} as line",
        f"substring({short}, 1, 32) as short_line",
    )


def top_validation(issues: DataFrame, limit: int = TOP_VALIDATION) -> DataFrame:
    """The first validation issues in report form."""
    order = Window.partitionBy("dataset_id").orderBy("ordinal")
    return (
        issue_sections(issues)
        .where("section = 'validation'")
        .withColumn("position", F.row_number().over(order))
        .where(f"position <= {limit}")
        .selectExpr(
            "dataset_id",
            "position",
            "upper(severity) as severity",
            "substring(initcap(replace(type, '_', ' ')), 1, 18) as issue",
            "substring(coalesce(column, 'Dataset'), 1, 14) as column",
            f"{Q.grouped('affected_rows')} as rows",
            "substring(description, 1, 60) as explanation",
        )
    )


def top_recommendations(priorities: DataFrame, limit: int = TOP_RECOMMENDATIONS) -> DataFrame:
    return priorities.where(f"rank <= {limit}")


def cleaning_section(datasets: DataFrame, audit: DataFrame | None) -> DataFrame:
    """Audit rows per dataset, or one row saying that cleaning was not executed."""
    columns = ("type", "description", "affected_rows", "cells_modified")
    if audit is None:
        steps = datasets.selectExpr(
            "dataset_id", "cast(null as int) as step", "cast(null as string) as type",
            "cast(null as string) as description", "cast(null as bigint) as affected_rows",
            "cast(null as bigint) as cells_modified",
        )
    else:
        steps = audit.select("dataset_id", "step", *columns)
    return (
        datasets.select("dataset_id")
        .join(steps, "dataset_id", "left")
        .selectExpr(
            "dataset_id",
            "if(type is null, 'not executed', 'executed') as status",
            "coalesce(step, 0) as step",
            *columns,
        )
    )


SECTIONS = (
    "Dataset Overview", "Overall Quality Score", "Dimension Scores", "Column Profile",
    "Missing-Value Analysis", "Duplicate Analysis", "Validation Problems", "Outliers",
    "Text-Quality Findings", "Executive Summary", "Priority Recommendations",
    "Cleaning Summary",
)


def report(
    *,
    dimensions: DataFrame,
    footprint: DataFrame,
    scores: DataFrame,
    profile: DataFrame,
    issues: DataFrame,
    summary: DataFrame,
    priorities: DataFrame,
    plan: DataFrame,
    observations: DataFrame,
    audit: DataFrame | None = None,
    cleaning_summary: DataFrame | None = None,
) -> DataFrame:
    """All twelve sections as rows: section number and title, position, key, value."""
    from plumbline.operators.score import tier

    parts: list[DataFrame] = []

    def add(no: int, df: DataFrame, pairs: str) -> None:
        """pairs is an array of (position, key, value) structs as SQL."""
        parts.append(
            df.selectExpr("dataset_id", f"inline({pairs})").selectExpr(
                "dataset_id",
                f"{no} as section_no",
                f"{Q.literal(SECTIONS[no - 1])} as section",
                "cast(col1 as int) as position",
                "cast(col2 as string) as key",
                "cast(col3 as string) as value",
            )
        )

    def pair(position: str | int, key: str, value: str) -> str:
        return f"struct({position} as col1, {key} as col2, cast({value} as string) as col3)"

    overview = dimensions.join(footprint, "dataset_id")
    add(
        1,
        overview,
        "array("
        + ", ".join(
            pair(i, Q.literal(name), value)
            for i, (name, value) in enumerate(
                (
                    ("Total Rows", Q.grouped("row_count")),
                    ("Total Columns", "column_count"),
                    ("Memory Footprint", "size"),
                    ("Format", "upper(file_format)"),
                ),
                start=1,
            )
        )
        + ")",
    )
    tiered = scores.withColumn("tier", tier(F.col("overall")))
    add(
        2,
        tiered,
        f"concat(array({pair(0, 'tier', 'overall')}), "
        f"transform(explanation, (e, i) -> {pair('i + 1', Q.literal('explanation'), 'e')}))",
    )
    add(
        3,
        scores,
        "array("
        + ", ".join(
            pair(i, Q.literal(d.title()), d)
            for i, d in enumerate(
                ("completeness", "validity", "uniqueness", "consistency"), start=1
            )
        )
        + ")",
    )
    add(4, column_lines(profile), f"array({pair('ordinal', 'name', 'line')})")
    add(
        5,
        missing_totals(profile),
        "array("
        + pair(1, "'Total Missing Cells'", Q.grouped("total_missing"))
        + ", "
        + pair(2, "'Missing Share'", f"concat({Q.fixed('missing_pct', 2)}, '%')")
        + ", "
        + pair(
            3,
            "'Columns with Missing Data'",
            "concat(columns_with_nulls, ' of ', column_count)",
        )
        + ")",
    )
    sections = issue_sections(issues)
    # the report shows the first duplicate issue only, whatever its kind
    first_duplicate = (
        sections.where("section = 'duplicate'")
        .groupBy("dataset_id")
        .agg(F.min_by("description", "ordinal").alias("description"))
    )
    add(6, first_duplicate, f"array({pair(1, Q.literal('duplicates'), 'description')})")
    described = f"array({pair('ordinal', 'concat(type, coalesce(concat(' + Q.literal(': ') + ', column), ' + Q.literal('') + '))', 'description')})"
    add(7, sections.where("section = 'validation'"), described)
    add(8, sections.where("section = 'outlier'"), described)
    add(
        9,
        text_columns(profile).where("avg_length is not null"),
        f"""array({pair("ordinal", "name", "concat('min len ', min_length, ', avg len ', "
        + Q.fixed('avg_length', 1) + ", ', max len ', max_length)")})""",
    )
    add(9, observations, f"array({pair('1000 + position', Q.literal('observation'), 'observation')})")
    add(10, summary, f"array({pair(1, Q.literal('summary'), 'summary')})")
    add(11, priorities, f"array({pair('rank', 'issue', 'recommendation')})")
    add(11, plan, f"array({pair('100 + step', Q.literal('plan'), 'action')})")
    cleaning = cleaning_section(dimensions, audit)
    add(
        12,
        cleaning,
        f"array({pair('step', 'coalesce(type, status)', 'coalesce(description, status)')})",
    )
    if cleaning_summary is not None:
        add(
            12,
            cleaning_summary,
            "array("
            + ", ".join(
                pair(100 + i, Q.literal(c), Q.grouped(c))
                for i, c in enumerate(
                    ("original_rows", "cleaned_rows", "rows_removed", "cells_modified")
                )
            )
            + ")",
        )
    return reduce(DataFrame.unionByName, parts).orderBy("dataset_id", "section_no", "position")


# ---- dashboard roll-ups -------------------------------------------------------------


def overview(issues: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Total and high issues, missing cells, duplicate rows, affected rows and share."""
    found = issues.groupBy("dataset_id").agg(
        F.count("*").alias("issues"),
        F.count_if(F.col("severity") == "high").alias("high"),
        F.sum("affected_rows").alias("affected"),
        F.expr(
            "max(affected_rows) filter (where type = 'duplicate_rows')"
        ).alias("copies"),
    )
    joined = dimensions.join(found, "dataset_id", "left")
    affected = "least(coalesce(affected, 0), row_count)"
    return joined.selectExpr(
        "dataset_id",
        "coalesce(issues, 0) as total_issues",
        "coalesce(high, 0) as high_issues",
        "null_cells as total_missing",
        "coalesce(copies, 0) as duplicate_rows",
        f"{affected} as affected_rows",
        f"{Q.quotient('100 * ' + affected, 'row_count', 10)} as affected_percentage",
    )


def top_null_columns(profile: DataFrame, limit: int = TOP_NULL_COLUMNS) -> DataFrame:
    """Columns with the highest null share and their colour band."""
    order = Window.partitionBy("dataset_id").orderBy(F.desc("null_percentage"), "ordinal")
    return (
        profile.withColumn("position", F.row_number().over(order))
        .where(f"position <= {limit}")
        .selectExpr(
            "dataset_id",
            "position",
            "name",
            "null_count",
            "null_percentage",
            "case when null_percentage > 20 then 'high' when null_percentage > 5 then 'medium' "
            "when null_percentage > 0 then 'low' else 'none' end as band",
        )
    )


def _whole_percent(part: str, whole: str) -> str:
    return f"cast({Q.quotient('100 * ' + part, whole, 1)} as bigint)"


def type_distribution(profile: DataFrame) -> DataFrame:
    total = F.sum("columns").over(Window.partitionBy("dataset_id"))
    return (
        profile.groupBy("dataset_id", "inferred_type")
        .agg(F.count("*").alias("columns"))
        .withColumn("total", total)
        .selectExpr(
            "dataset_id",
            "inferred_type",
            "columns",
            f"{_whole_percent('columns', 'total')} as percentage",
        )
    )


def severity_distribution(by_severity: DataFrame) -> DataFrame:
    """Counts and whole percentages of the three severities."""
    total = F.sum("issues").over(Window.partitionBy("dataset_id"))
    label = (
        "case severity when 'high' then 'High (Critical)' "
        "when 'medium' then 'Medium (Warning)' else 'Low (Notice)' end"
    )
    return by_severity.withColumn("total", total).selectExpr(
        "dataset_id",
        f"{label} as label",
        "issues",
        f"{_whole_percent('issues', 'total')} as percentage",
    )

