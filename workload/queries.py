"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import Assessment
from plumbline.functions import constants
from plumbline.functions import exprs as X
from plumbline.operators import (
    clean,
    insights,
    issues,
    missing,
    outliers,
    privacy,
    profile,
    report,
    score,
    texture,
    uniqueness,
    validity,
)
from plumbline.operators import facts as fx
from plumbline.operators import history, sketches
from plumbline.operators import quantiles as qt
from plumbline.session import ensure_checkpoint_dir
from plumbline.sources import csv, flatten, intake, json, sinks
from plumbline.streaming import limiter
from workload import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def customers(spark: SparkSession, sf: str) -> Assessment:
    return Assessment(
        views.dirty_customer(spark, sf),
        "dirty_customer",
        columns=views.CUSTOMER_COLUMNS,
        order_by=["row_id"],
    )


def orders(spark: SparkSession, sf: str) -> Assessment:
    return Assessment(
        views.dirty_order(spark, sf),
        "dirty_order",
        columns=views.ORDER_COLUMNS,
        order_by=["row_id"],
    )


def lineitem(spark: SparkSession, sf: str) -> Assessment:
    return Assessment(views.table(spark, sf, "lineitem"), "lineitem")


def documents(spark: SparkSession, sf: str) -> Assessment:
    return Assessment(views.table(spark, sf, "documents"), "documents", order_by=["doc_id"])


# ---- profile ------------------------------------------------------------------------


@query
def profile_dims(spark, sf):
    return lineitem(spark, sf).dimensions()


@query
def profile_bytes(spark, sf):
    return documents(spark, sf).footprint()


@query
def profile_nulls(spark, sf):
    return customers(spark, sf).facts().select(
        "column",
        F.col("non_null").alias("non_null_count"),
        profile.null_count().alias("null_count"),
        X.pct(profile.null_count(), F.col("rows")).alias("null_percentage"),
    )


@query
def profile_distinct(spark, sf):
    return lineitem(spark, sf).facts("unique").select(
        "column",
        F.col("unique").alias("unique_count"),
        X.pct(F.col("unique"), F.col("rows")).alias("unique_percentage"),
    )


def _numeric(a: Assessment) -> DataFrame:
    stats = ("mn", "mx", "mean", "sd", "q25", "q50", "q75")
    facts = a.facts("numbers", "quartiles").where(F.col("mn").isNotNull())
    return facts.select("column", *[profile.finite(F.col(s)).alias(s) for s in stats])


@query
def profile_numeric(spark, sf):
    return _numeric(lineitem(spark, sf))


@query
def profile_numeric_dirty(spark, sf):
    return _numeric(customers(spark, sf))


@query
def quartiles_bracketed(spark, sf):
    """Quantiles of columns with many and with few distinct values."""
    df = views.table(spark, sf, "lineitem").select("l_extendedprice", "l_partkey", "l_tax")
    _, found = fx.scan(df, [])
    counts = {i: f["non_null"] for i, f in found.items()}
    rows = qt.quantiles(df, counts)
    return spark.createDataFrame(
        [(df.columns[i], *q) for i, q in rows.items()],
        "column string, q25 double, q50 double, q75 double",
    ).select("column", *[F.round(q, 4).alias(q) for q in ("q25", "q50", "q75")])


def _lengths(a: Assessment) -> DataFrame:
    return a.facts("lengths").where("kind = 'string' and non_null > 0").select(
        "column",
        F.col("len_min").alias("min_length"),
        F.col("len_max").alias("max_length"),
        X.quotient(F.col("len_sum"), F.col("non_null"), 100).alias("avg_length"),
    )


@query
def profile_text_length(spark, sf):
    return _lengths(documents(spark, sf))


@query
def profile_text_length_dirty(spark, sf):
    return _lengths(customers(spark, sf))


def _top(a: Assessment) -> DataFrame:
    return a.top_values().select("column", "rank", "value", "count", "percentage")


@query
def profile_top_values(spark, sf):
    return _top(lineitem(spark, sf))


@query
def profile_top_values_dirty(spark, sf):
    return _top(orders(spark, sf))


@query
def profile_dates(spark, sf):
    return orders(spark, sf).typed_facts().where("is_date").select(
        "column", "date_confidence", "date_format", "date_earliest", "date_latest"
    )


@query
def profile_full(spark, sf):
    return profile.flat(customers(spark, sf).profile())


@query
def profile_full_orders(spark, sf):
    return profile.flat(orders(spark, sf).profile())


# ---- typing -------------------------------------------------------------------------


@query
def infer_physical(spark, sf):
    df = views.dirty_order(spark, sf).select(
        *[X.text(X.ref(c)).alias(c) for c in views.ORDER_COLUMNS]
    )
    return csv.infer_physical(df).select("column", "filled", "physical_type")


@query
def infer_dates(spark, sf):
    return customers(spark, sf).typed_facts().select(
        "column", "is_date", "date_confidence", "date_format", "date_earliest", "date_latest"
    )


@query
def infer_logical(spark, sf):
    return orders(spark, sf).typed_facts().select("column", "inferred_type")


@query
def infer_logical_customer(spark, sf):
    return customers(spark, sf).typed_facts().select("column", "inferred_type")


@query
def email_candidates(spark, sf):
    return orders(spark, sf).facts("validity").selectExpr(
        "column", f"{validity.EMAIL_CANDIDATE} as email_candidate"
    )


# ---- issues -------------------------------------------------------------------------


@query
def issues_missing(spark, sf):
    return customers(spark, sf).find(missing.RULES)


@query
def issues_dup_rows(spark, sf):
    copies = customers(spark, sf).row_copies()
    return issues.number(uniqueness.row_issues(copies).where("type = 'duplicate_rows'"))


@query
def issues_dup_normalized(spark, sf):
    copies = customers(spark, sf).row_copies()
    return issues.number(uniqueness.row_issues(copies).where("type <> 'duplicate_rows'"))


@query
def profile_distinct_merged(spark, sf):
    """Distinct counts merged from stored sketches of three parts, against the exact ones."""
    lines, path = views.table(spark, sf, "lineitem"), scratch(spark)
    for flag in ("A", "N", "R"):
        sketches.column_sketches(lines.where(F.col("l_returnflag") == flag)).write.mode("append").parquet(path)
    found = sketches.estimates(sketches.merged(spark.read.parquet(path)))
    exact = lineitem(spark, sf).facts("unique").select("column", F.col("unique").alias("unique_count"))
    within = F.col("unique_count").between(F.col("unique_low"), F.col("unique_high"))
    return found.join(exact, "column").select("column", "rows", "non_null", "unique_count", within.alias("within_bounds"))


@query
def duplicate_counts_lineitem(spark, sf):
    return lineitem(spark, sf).row_copies()


@query
def issues_dup_ids(spark, sf):
    return customers(spark, sf).find(uniqueness.IDENTIFIER_RULES, "unique_identifiers")


@query
def issues_constant(spark, sf):
    return customers(spark, sf).find([validity.CONSTANT], "unique", "shown")


@query
def issues_low_variance(spark, sf):
    return customers(spark, sf).find([validity.LOW_VARIANCE], "unique")


@query
def issues_email(spark, sf):
    return customers(spark, sf).find([validity.EMAIL], "unique", "validity")


@query
def issues_email_candidate(spark, sf):
    return orders(spark, sf).find([validity.EMAIL], "unique", "validity")


@query
def issues_percentage(spark, sf):
    return customers(spark, sf).find([validity.PERCENTAGE], "unique", "validity")


@query
def issues_negative(spark, sf):
    return customers(spark, sf).find([validity.NEGATIVE], "unique", "validity")


@query
def issues_phone(spark, sf):
    return customers(spark, sf).find([validity.PHONE], "unique", "validity")


@query
def issues_date(spark, sf):
    return orders(spark, sf).find([validity.DATE], "unique", "validity")


@query
def outlier_fences(spark, sf):
    return outliers.fence_rows(lineitem(spark, sf).facts("quartiles"))


@query
def issues_outliers(spark, sf):
    return customers(spark, sf).find(outliers.RULES, "outliers")


@query
def issues_outliers_events(spark, sf):
    return Assessment(views.table(spark, sf, "events"), "events").find(outliers.RULES, "outliers")


@query
def issues_near_empty(spark, sf):
    return customers(spark, sf).find([texture.NEAR_EMPTY], "texture", "lengths")


@query
def issues_long_text(spark, sf):
    return documents(spark, sf).find([texture.LONG], "long")


@query
def issues_repeated_text(spark, sf):
    return documents(spark, sf).find([texture.REPEATED], "texture")


@query
def issues_whitespace(spark, sf):
    return documents(spark, sf).find([texture.SPACING], "texture")


@query
def issues_all(spark, sf):
    return customers(spark, sf).issues()


@query
def issues_all_orders(spark, sf):
    return orders(spark, sf).issues()


@query
def issues_by_severity(spark, sf):
    return customers(spark, sf).issues_by_severity()


@query
def issues_filter(spark, sf):
    return issues.filter_issues(customers(spark, sf).issues(), "high", "Email")


@query
def issues_sorted(spark, sf):
    found = issues.sort_issues(customers(spark, sf).issues())
    return found.select("position", "type", "severity", "column", "affected_rows")


@query
def issues_filter_search(spark, sf):
    return issues.filter_issues(customers(spark, sf).issues(), search="Email")


@query
def issues_filter_severity(spark, sf):
    return issues.filter_issues(customers(spark, sf).issues(), "medium")


SORT_KEYS = ("severity", "affected_rows", "percentage", "column", "issue")


def _sorted_by(key: str, descending: bool) -> Query:
    def run(spark, sf):
        found = issues.sort_issues(customers(spark, sf).issues(), key, descending)
        return found.select("position", "type", "severity", "column", "affected_rows")

    run.__name__ = f"issues_sorted_{key}_{'down' if descending else 'up'}"
    return run


for _key in SORT_KEYS:
    for _descending in (True, False):
        query(_sorted_by(_key, _descending))


# ---- score --------------------------------------------------------------------------


def _dimension(spark, sf, name: str) -> DataFrame:
    a = customers(spark, sf)
    scores = score.dimension_scores(a.issues(), a.dimensions())
    return scores.where(F.col("dimension") == name).select(
        "dimension", "deducted", "score", F.array_join("notes", "; ").alias("notes")
    )


@query
def score_completeness(spark, sf):
    return _dimension(spark, sf, "completeness")


@query
def score_validity(spark, sf):
    return _dimension(spark, sf, "validity")


@query
def score_uniqueness(spark, sf):
    return _dimension(spark, sf, "uniqueness")


@query
def score_consistency(spark, sf):
    return _dimension(spark, sf, "consistency")


@query
def score_overall(spark, sf):
    return customers(spark, sf).score().drop("explanation")


@query
def score_overall_orders(spark, sf):
    return orders(spark, sf).score().drop("explanation")


@query
def score_weighted(spark, sf):
    weights = {"completeness": 0.1, "validity": 0.2, "uniqueness": 0.3, "consistency": 0.4}
    return customers(spark, sf).score(weights=weights).drop("explanation")


@query
def score_explanations(spark, sf):
    return customers(spark, sf).score().select(
        "dataset_id", F.posexplode("explanation").alias("position", "line")
    )


@query
def score_tier(spark, sf):
    return score.with_tiers(customers(spark, sf).score())


@query
def score_bands(spark, sf):
    return score.bands(customers(spark, sf).score())


# ---- cleaning -----------------------------------------------------------------------


def cleaned_customers(spark, sf) -> clean.Cleaning:
    return clean.clean(
        views.dirty_customer(spark, sf),
        "dirty_customer",
        columns=views.CUSTOMER_COLUMNS,
        order_by=["row_id"],
    )


def _customer_batches(spark, sf):
    """Dirty customers in four batches by ranges of row_id, as they would arrive."""
    df = views.dirty_customer(spark, sf)
    last = df.agg(F.max("row_id")).first()[0] or 0
    return [df.where(f"row_id * 4 div {last + 1} = {i}") for i in range(4)]


@query
def clean_dedup_batches(spark, sf):
    past = history.RowHistory(spark, scratch(spark))
    kept = []
    for i, batch in enumerate(_customer_batches(spark, sf)):
        kept.append(past.add(batch, f"batch-{i}", views.CUSTOMER_COLUMNS, ["row_id"]))
    return reduce(DataFrame.unionByName, kept)


@query
def duplicate_counts_batches(spark, sf):
    past = history.RowHistory(spark, scratch(spark))
    for i, batch in enumerate(_customer_batches(spark, sf)):
        past.add(batch, f"batch-{i}", views.CUSTOMER_COLUMNS, ["row_id"])
    return past.copies()


@query
def clean_dedup(spark, sf):
    return cleaned_customers(spark, sf).deduplicated


@query
def clean_trim(spark, sf):
    df = views.dirty_customer(spark, sf)
    return df.select(
        "row_id",
        *[clean.trim(F.col(c)).alias(c) for c in ("customer_name", "comment", "mixed")],
    )


@query
def clean_collapse(spark, sf):
    df = views.dirty_customer(spark, sf)
    return df.select("row_id", clean.collapse(F.col("comment")).alias("comment"))


@query
def clean_email(spark, sf):
    df = views.dirty_customer(spark, sf)
    return df.select("row_id", clean.lower_email(F.col("email")).alias("email"))


@query
def clean_nulls(spark, sf):
    df = views.dirty_customer(spark, sf)
    return df.select(
        "row_id",
        *[clean.null_placeholders(F.col(c)).alias(c) for c in ("comment", "mixed", "email")],
    )


@query
def clean_full(spark, sf):
    return cleaned_customers(spark, sf).cleaned


@query
def clean_audit(spark, sf):
    audit = cleaned_customers(spark, sf).audit()
    return audit.withColumn("affected_columns", F.array_join("affected_columns", ", "))


@query
def clean_summary(spark, sf):
    return cleaned_customers(spark, sf).summary()


def _warnings(spark, sf, kind: str) -> DataFrame:
    found = cleaned_customers(spark, sf).warnings(kind)
    return found.select("kind", "column", "affected_rows", "warning")


@query
def clean_warn_outliers(spark, sf):
    return _warnings(spark, sf, "outliers")


@query
def clean_warn_negatives(spark, sf):
    return _warnings(spark, sf, "negatives")


@query
def clean_warn_email(spark, sf):
    return _warnings(spark, sf, "malformed_email")


@query
def clean_warn_nulls(spark, sf):
    return _warnings(spark, sf, "mostly_null")


# ---- privacy ------------------------------------------------------------------------


def _documents_redacted(spark, sf, redact) -> DataFrame:
    df = views.table(spark, sf, "documents")
    return df.select("doc_id", redact(F.col("text")).alias("text"))


@query
def redact_email(spark, sf):
    return _documents_redacted(spark, sf, privacy.redact_email)


@query
def redact_ssn(spark, sf):
    return _documents_redacted(spark, sf, privacy.redact_ssn)


@query
def redact_card(spark, sf):
    return _documents_redacted(spark, sf, privacy.redact_card)


@query
def redact_phone(spark, sf):
    return _documents_redacted(spark, sf, privacy.redact_phone)


@query
def redact_text(spark, sf):
    return _documents_redacted(spark, sf, privacy.redact_text)


@query
def redact_table(spark, sf):
    return privacy.redact_table(views.table(spark, sf, "conversations"))


@query
def mask_sensitive(spark, sf):
    df = views.dirty_customer(spark, sf).select(
        "row_id", F.col("mostly_null").alias("api_key_hint"), F.col("age").alias("token_age")
    )
    return privacy.redact_table(df)


@query
def redact_nested(spark, sf):
    df = views.dirty_customer(spark, sf).select(
        "row_id",
        F.struct("email", F.col("phone_number").alias("password"), "age").alias("contact"),
    )
    nested = privacy.redact_table(df)
    return nested.select("row_id", "contact.email", "contact.password", "contact.age")


# ---- insights -----------------------------------------------------------------------


@query
def summary_columns(spark, sf):
    return insights.column_summary(customers(spark, sf).profile())


@query
def summary_issues(spark, sf):
    return insights.issue_summary(customers(spark, sf).issues())


@query
def summary_samples(spark, sf):
    return customers(spark, sf).samples()


@query
def insight_summary(spark, sf):
    return customers(spark, sf).executive_summary()


@query
def insight_priority(spark, sf):
    return customers(spark, sf).priorities()


@query
def insight_plan(spark, sf):
    return customers(spark, sf).cleaning_plan()


@query
def insight_text(spark, sf):
    return customers(spark, sf).text_observations()


@query
def insight_client(spark, sf):
    return customers(spark, sf).client_summary()


# ---- report and roll-ups ------------------------------------------------------------


@query
def report_missing(spark, sf):
    return report.missing_totals(customers(spark, sf).profile())


@query
def report_sections(spark, sf):
    found = report.issue_sections(customers(spark, sf).issues())
    return found.select("section", "type", "column", "affected_rows", "percentage")


@query
def report_sections_complete(spark, sf):
    found = report.issue_sections(customers(spark, sf).issues(), complete=True)
    return found.select("section", "type", "column", "affected_rows", "percentage")


@query
def report_text_columns(spark, sf):
    return report.text_columns(customers(spark, sf).profile())


@query
def report_column_lines(spark, sf):
    return report.column_lines(customers(spark, sf).profile())


@query
def report_top_validation(spark, sf):
    return report.top_validation(customers(spark, sf).issues())


@query
def report_recommendations(spark, sf):
    return report.top_recommendations(customers(spark, sf).priorities())


@query
def report_cleaning(spark, sf):
    a, c = customers(spark, sf), cleaned_customers(spark, sf)
    return report.cleaning_section(a.dimensions(), c.audit())


@query
def report_full(spark, sf):
    a, c = customers(spark, sf), cleaned_customers(spark, sf)
    return a.report(c.audit(), c.summary())


@query
def overview_kpis(spark, sf):
    a = customers(spark, sf)
    return report.overview(a.issues(), a.dimensions())


@query
def top_null_columns(spark, sf):
    return report.top_null_columns(customers(spark, sf).profile())


@query
def type_distribution(spark, sf):
    return report.type_distribution(customers(spark, sf).profile())


@query
def severity_distribution(spark, sf):
    return report.severity_distribution(customers(spark, sf).issues_by_severity())


# ---- sources and sinks --------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder name in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"


@query
def scan_table(spark, sf):
    return views.table(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count("*").alias("orders"), F.min("o_totalprice").alias("lowest")
    )


@query
def scan_csv(spark, sf):
    """Written as CSV, read back with null tokens and inferred types."""
    path = scratch(spark)
    sinks.write_csv(views.dirty_customer(spark, sf), path)
    return csv.read_csv(spark, path, quoted_newlines=False)


@query
def sink_csv(spark, sf):
    """Every cleaned column, read back in its type."""
    path = scratch(spark)
    cleaned = cleaned_customers(spark, sf).cleaned
    sinks.write_csv(cleaned, path)
    reader = spark.read.schema(cleaned.schema)
    return reader.options(header="true", escape='"', multiLine="true").csv(path)


@query
def sink_json(spark, sf):
    """Every cleaned column, read back in its type."""
    path = scratch(spark)
    cleaned = cleaned_customers(spark, sf).cleaned
    sinks.write_json(cleaned, path)
    return spark.read.schema(cleaned.schema).json(path)


@query
def scan_json_lines(spark, sf):
    path = scratch(spark)
    events = views.table(spark, sf, "events")
    props = F.from_json("props", "struct<k: bigint>").alias("props")
    sinks.write_json(events.select("event_id", "event_type", "value", props), path)
    return json.read_json(spark, path)


@query
def sink_audit(spark, sf):
    path = scratch(spark)
    sinks.append_audit(cleaned_customers(spark, sf).audit(), path)
    return sinks.read_audit(spark, path).select(
        "dataset_id", "step", "type", "affected_rows", "cells_modified"
    )


@query
def json_flatten(spark, sf):
    events = views.table(spark, sf, "events")
    props = F.from_json("props", "struct<k: bigint>").alias("props")
    return flatten.flatten(events.select("event_id", props))


@query
def json_nested_text(spark, sf):
    events = views.table(spark, sf, "events")
    cell = F.struct(F.col("value").alias("v"), F.col("event_type").alias("t"), F.array("user_id").alias("ids"))
    return flatten.nested_to_json(events.select("event_id", cell.alias("cell")))


# ---- JSON documents over several files ------------------------------------------------


def _documents(spark, sf, one_text) -> DataFrame:
    """Suppliers as one JSON document per nation, each in a file of its own, read back."""
    suppliers = views.table(spark, sf, "supplier")
    rows = suppliers.groupBy("s_nationkey").agg(
        F.array_sort(F.collect_list(F.struct(*suppliers.columns))).alias("rows")
    )
    path = scratch(spark)
    texts = rows.select(one_text(F.col("rows"), suppliers.columns).alias("value"))
    texts.write.option("maxRecordsPerFile", 1).text(path)
    return json.read_json(spark, path)


@query
def scan_json_records(spark, sf):
    return _documents(spark, sf, lambda rows, names: F.to_json(rows))


@query
def scan_json_wrapper(spark, sf):
    return _documents(
        spark, sf, lambda rows, names: F.to_json(F.struct(F.lit(1).alias("meta"), rows.alias("data")))
    )


@query
def scan_json_record_map(spark, sf):
    def record_map(rows, names):
        keys = F.transform(rows, lambda r: F.concat(F.lit("r"), r["s_suppkey"]))
        return F.to_json(F.map_from_arrays(keys, rows))

    return _documents(spark, sf, record_map)


@query
def scan_json_columns(spark, sf):
    def columns(rows, names):
        return F.to_json(F.struct(*[F.transform(rows, _field(n)).alias(n) for n in names]))

    return _documents(spark, sf, columns)


def _field(name):
    return lambda r: r[name]


@query
def scan_json_object(spark, sf):
    nations = views.table(spark, sf, "nation")
    path = scratch(spark)
    texts = nations.select(F.to_json(F.struct(*nations.columns)).alias("value"))
    texts.write.option("maxRecordsPerFile", 1).text(path)
    return json.read_json(spark, path)


@query
def scan_json_scalars(spark, sf):
    return _documents(spark, sf, lambda rows, names: F.to_json(F.transform(rows, _field("s_acctbal"))))


@query
def scan_json_bom(spark, sf):
    return _documents(spark, sf, lambda rows, names: F.concat(F.lit("\ufeff"), F.to_json(rows)))


@query
def scan_csv_cut(spark, sf):
    """Documents with line breaks and quotes in their cells, cut by byte ranges."""
    path = scratch(spark)
    docs = views.table(spark, sf, "documents").select("doc_id", F.concat(F.lit('"'), "text", F.lit('",\n')).alias("text"), "lang")
    sinks.write_csv(docs, path)
    return csv.read_csv(spark, path, large=0)


@query
def scan_json_cut(spark, sf):
    """Customers as one document per nation, cut by byte ranges whatever their size."""
    customers = views.table(spark, sf, "customer")
    rows = customers.groupBy("c_nationkey").agg(
        F.array_sort(F.collect_list(F.struct(*customers.columns))).alias("rows")
    )
    path = scratch(spark)
    texts = rows.select(F.to_json(F.struct(F.lit("x,]").alias("note"), F.col("rows").alias("items"))).alias("value"))
    texts.write.option("maxRecordsPerFile", 1).text(path)
    return json.read_json(spark, path, large=0)


@query
def scan_csv_folder(spark, sf):
    """Files whose headers differ in order and in one column."""
    path = scratch(spark)
    suppliers = views.table(spark, sf, "supplier")
    odd = F.col("s_suppkey") % 2 == 1
    sinks.write_csv(suppliers.where(odd), f"{path}/a")
    rest = suppliers.where(~odd).select(*reversed(suppliers.columns[:-1]))
    sinks.write_csv(rest, f"{path}/b")
    return csv.read_csv(spark, f"{path}/*", quoted_newlines=False)


# ---- intake -------------------------------------------------------------------------


@query
def preview(spark, sf):
    return intake.preview(views.table(spark, sf, "orders"), ["o_orderkey"]).drop("o_orderdate")


@query
def preview_shape(spark, sf):
    return intake.preview_shape(views.table(spark, sf, "orders"))


@query
def sanitize_filename(spark, sf):
    pages = views.table(spark, sf, "pages")
    return pages.select("page_id", intake.sanitize_filename(F.col("url")).alias("filename"))


CONTENT_TYPES = ("text/csv", "Application/JSON; charset=utf-8", "image/png", "", "text/xml")


def manifest(spark, sf) -> DataFrame:
    kinds = F.array(*[F.lit(c) for c in CONTENT_TYPES])
    pages = views.table(spark, sf, "pages")
    suffix = F.when(F.col("page_id") % 3 == 0, ".csv").when(F.col("page_id") % 3 == 1, ".JSON")
    return pages.select(
        "page_id",
        F.concat(F.col("url"), F.coalesce(suffix, F.lit(".txt"))).alias("filename"),
        F.element_at(kinds, (F.col("page_id") % 5 + 1).cast("int")).alias("content_type"),
        (F.length("html") * (F.col("page_id") % 4) * 40_000).cast("bigint").alias("size"),
    )


@query
def mime_rules(spark, sf):
    checked = intake.check_manifest(manifest(spark, sf), constants.MAX_FILE_BYTES)
    return checked.select("page_id", "size", "verdict")


@query
def intake_audit(spark, sf):
    """Files written from the given tables in hashed parts, and their verdicts."""
    path = scratch(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sinks.write_csv(views.table(spark, sf, "orders").repartition(parts, "o_orderkey"), f"{path}/orders")
    sinks.write_json(views.table(spark, sf, "customer").repartition(parts, "c_custkey"), f"{path}/customer")
    names = views.table(spark, sf, "part").select(F.col("p_name").cast("string"))
    names.repartition(parts, "p_name").write.text(f"{path}/part")
    checked = intake.check_folder(spark, path)
    # how many files there are is the session's choice, that there are some is not
    return checked.groupBy("format", "verdict").agg(
        (F.count("*") > 0).alias("files"), F.sum("bad_lines").alias("bad_lines")
    )


@query
def intake_content(spark, sf):
    """Contents under file names, accepted and rejected."""
    docs = views.table(spark, sf, "documents").select("doc_id", "text")
    events = views.table(spark, sf, "events").select("event_id", "props")
    kind = F.col("event_id") % 3
    cut = F.when(kind == 0, F.expr("left(props, length(props) - 1)")).when(kind == 1, F.concat("props", F.lit("\n"), "props"))
    texts = docs.select(
        F.concat(F.lit("d"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".csv").otherwise(".JSON")).alias("filename"),
        F.when(F.col("doc_id") % 5 == 0, "").when(F.col("doc_id") % 5 == 1, F.lit(" \n ")).otherwise(F.col("text")).alias("content"),
    ).unionByName(
        events.select(
            F.concat(F.lit("e"), "event_id", F.lit(".json")).alias("filename"),
            F.coalesce(cut, F.col("props")).alias("content"),
        )
    )
    return texts.select("filename", intake.content_verdict(F.col("filename"), F.col("content")).alias("verdict"))


AS_OF = "2024-01-20 12:00:00"


@query
def retention(spark, sf):
    events = views.table(spark, sf, "events")
    return intake.retained(events, "ts", AS_OF, 24).select("event_id", "user_id")


@query
def retention_purged(spark, sf):
    return intake.purge_summary(views.table(spark, sf, "events"), "ts", AS_OF, 24)


def _event_datasets(spark, sf) -> DataFrame:
    name = F.concat(F.lit("dataset_"), F.col("event_type")).alias("dataset_id")
    return views.table(spark, sf, "events").select("event_id", name)


@query
def delete_dataset(spark, sf):
    return intake.delete_dataset(_event_datasets(spark, sf), "dataset_click")


@query
def delete_dataset_summary(spark, sf):
    return intake.delete_summary(_event_datasets(spark, sf), "dataset_click")


# ---- rate limiting ------------------------------------------------------------------

DAY = 86_400


@query
def window_counts(spark, sf):
    events = views.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return limiter.window_counts(events, "user_id", "ts", DAY).drop("ts")


@query
def rate_limit(spark, sf):
    events = views.table(spark, sf, "events").select("event_id", "user_id", "ts")
    limited = limiter.rate_limit(
        events, "user_id", "ts", limit=3, seconds=DAY, tie_break=["event_id"]
    )
    return limited.drop("ts")
