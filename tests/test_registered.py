"""Registered queries against their SQL on the smallest given tables."""

import math
from pathlib import Path

import duckdb
import pytest

from workload.expected import EXPECTED
from workload.queries import QUERIES

SF = Path("/root/testdata/sf0.001")
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the given tables are not here")

CHECKED = (
    "profile_bytes", "profile_numeric", "profile_top_values_dirty", "profile_full",
    "infer_physical", "duplicate_counts_lineitem", "issues_date", "issues_repeated_text",
    "issues_whitespace", "issues_all", "issues_all_orders", "score_explanations",
    "clean_full", "clean_audit", "clean_warn_outliers", "redact_text", "summary_samples",
    "insight_client", "report_column_lines", "scan_csv", "json_nested_text",
    "sanitize_filename", "mime_rules", "window_counts", "intake_audit", "intake_content",
    "quartiles_bracketed", "rate_limit",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else str(v)


def rows_of(rows, names):
    order = [names.index(n) for n in sorted(names)]
    return sorted(([plain(r[i]) for i in order] for r in rows), key=str)


def test_every_expectation_has_a_query():
    assert set(EXPECTED) <= set(QUERIES)
    assert set(QUERIES) - set(EXPECTED) == {"report_full"}


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, str(SF))
    expected = duck.execute(EXPECTED[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(expected.fetchall(), names)


def test_report_has_all_sections(spark):
    rows = QUERIES["report_full"](spark, str(SF)).collect()
    assert {r["section_no"] for r in rows} == set(range(1, 13))
