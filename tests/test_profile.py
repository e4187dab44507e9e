"""Profiles, types and exact quantiles."""

import numpy as np
import pytest
import tables
from pyspark.sql import functions as F

from plumbline import Assessment
from plumbline.functions import names
from plumbline.operators import facts as fx
from plumbline.operators import quantiles as qt


def test_profile_of_six_rows(check):
    p = {r["name"]: r for r in check(tables.SIX_ROWS).profile().collect()}
    rating = p["rating"]["numeric_stats"]
    assert p["rating"]["inferred_type"] == "numeric"
    assert (rating["min"], rating["max"], rating["mean"]) == (4.0, 20.0, 12.0)
    assert (rating["q25"], rating["q50"], rating["q75"]) == (8.0, 12.0, 16.0)
    assert p["rating"]["null_percentage"] == 16.67
    top = p["team"]["top_values"][0]
    assert (top["value"], top["count"], top["percentage"]) == ("Kiln", 3, 50.0)
    assert p["opened_at"]["inferred_type"] == "datetime"
    assert p["opened_at"]["date_stats"]["earliest"] == "2020-03-01 00:00:00"
    assert p["model_year"]["inferred_type"] == "numeric"
    assert p["model_year"]["date_stats"] is None
    assert p["remark"]["null_count"] == 2  # an empty cell and N/A


def test_first_format_decides_when_asked(check):
    text = "order_date\n2023-01-01\n01/02/2023\n2023-02-30\n2023-03-01\n"
    strict = check(text, strict_first_format=True).issues().where("type = 'invalid_date'")
    each = check(text).issues().where("type = 'invalid_date'")
    assert strict.first()["affected_rows"] == 2 and each.first()["affected_rows"] == 1
    day_first = "order_date\n13/02/2023\n01/02/2023\n12/31/2023\n"
    found = check(day_first, strict_first_format=True).issues().where("type = 'invalid_date'")
    assert found.first()["affected_rows"] == 1


def test_first_format_without_an_order(spark):
    df = spark.createDataFrame([("2023-01-01",), ("01/02/2023",)], "order_date string")
    found = Assessment(df, strict_first_format=True).issues().where("type = 'invalid_date'")
    assert found.first()["affected_rows"] == 1


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("2023-1-5", "2023-01-05"), ("2023/01/05", "2023-01-05"), ("2023-13-45", None),
        ("2023-01-05T10:30:00Z", "2023-01-05"), ("2023-01-05 23:30:00-05:00", "2023-01-06"),
        ("1/31/2023", "2023-01-31"), ("31-1-2023", "2023-01-31"), ("31/31/2023", None),
        ("5 Mar 2023", "2023-03-05"), ("March 5, 2023", "2023-03-05"), ("Mar 5 2023", "2023-03-05"),
        ("5 Mai 2023", None), ("12 March 2020 we went home", None), ("10:30", None), ("2023", None),
    ],
)
def test_written_dates(spark, text, day):
    from plumbline.functions import exprs as X

    ts = X.parse_date(F.col("s"))
    row = spark.createDataFrame([(text,)], "s string").select(F.date_format(ts, "yyyy-MM-dd"))
    assert row.first()[0] == day


def test_approximate_cardinality_is_close(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("a"))
    assert fx.approximate_cardinality(df).first()["unique"] == pytest.approx(1000, rel=0.1)


@pytest.mark.parametrize("partitions", [1, 8])
def test_result_does_not_depend_on_partitioning(load, partitions):
    df = load(tables.MESSY)
    columns = [c for c in df.columns if c != "__row"]
    df = df.orderBy(F.desc("age")).repartition(partitions)
    a = Assessment(df, "test", columns=columns, order_by=["__row"])
    assert a.score().first()["overall"] == 37


def test_edge_frames(spark):
    empty = Assessment(spark.createDataFrame([], "a int, b string, `c.d` double"))
    assert empty.issues().count() == 0
    assert empty.score().first()["overall"] == 100
    one = Assessment(
        spark.createDataFrame([(1, None, True, 2.0)], "id int, b string, c boolean, `x.y` double")
    )
    types = {r["name"]: r["inferred_type"] for r in one.profile().collect()}
    assert types == {"id": "numeric", "b": "text", "c": "boolean", "x.y": "numeric"}
    assert [r["type"] for r in one.issues().collect()] == ["empty_column"]


def test_nan_counts_as_null_and_infinity_is_not_shown(spark):
    df = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,), (-0.0,), (0.0,)], "v double")
    row = Assessment(df).profile().first()
    assert row["null_count"] == 1 and row["unique_count"] == 3
    assert row["numeric_stats"]["max"] is None and row["numeric_stats"]["min"] == 0.0


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.lognormal(3, 2, 6000), np.full(4000, 12.5), -rng.random(3001)])
    df = spark.createDataFrame([(float(v), float(i % 3), None) for i, v in enumerate(values)], "a double, b double, c int")
    found = qt.quantiles(df.repartition(5), {0: len(values), 1: len(values), 2: 0})
    assert found[0] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])), rel=1e-12)
    assert found[1] == [0.0, 1.0, 2.0] and 2 not in found


def test_long_values_count_exactly_by_digest(spark):
    texts = ["x" * 5000 + str(i % 40) for i in range(200)] + ["short"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert fx.cardinality(df)[0] == {"unique": 41, "top": 5, "repeated": 200}


def test_top_values_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).cast("string").alias("a"), (F.col("id") % 3).alias("b"))
    plan = Assessment(df).top_values()._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_name_rules():
    assert names.is_identifier("User ID") is False and names.is_identifier("user_id")
    assert names.is_identifier("email") and not names.is_identifier("customer_email")
    assert names.is_non_negative("item_count") and names.is_non_negative("age")
    assert not names.is_non_negative("price_change") and not names.is_non_negative("percentage")
    assert names.is_percentage("corporate") and names.is_dated("sentiment")
    assert names.is_cleaning_non_negative("discount_rate")
