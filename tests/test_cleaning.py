"""Cleaning, audit, duplicates and redaction."""

import pytest
import tables
from pyspark.sql import functions as F

from plumbline.operators.clean import Cleaning
from plumbline.operators.duplicates import duplicate_counts, keep_first
from plumbline.operators.privacy import redact_table, redact_text


def cleaning(load, text):
    df = load(text)
    return Cleaning(
        df, "test", columns=[c for c in df.columns if c != "__row"], order_by=["__row"]
    )


def test_steps_and_cells(load):
    c = cleaning(load, tables.TO_CLEAN)
    steps = {r["type"]: (r["affected_rows"], r["cells_modified"]) for r in c.audit().collect()}
    # "none" is a null token only for cleaning, not for the CSV scan
    assert steps == {
        "remove_duplicates": (1, 0),
        "trim_whitespace": (1, 2),
        "normalize_whitespace": (1, 1),
        "normalize_email_casing": (1, 1),
        "standardize_missing": (2, 2),
    }
    s = c.summary().first()
    assert (s["original_rows"], s["cleaned_rows"], s["rows_removed"], s["cells_modified"]) == (5, 4, 1, 6)
    rows = {r["id"]: r for r in c.cleaned.collect()}
    assert rows[2]["email"] == "tom@mill.example" and rows[2]["notes"] is None
    assert rows[3]["name"] == "Ulla Dahl" and rows[3]["age"] == -4
    assert [r["kind"] for r in c.warnings().collect()] == ["negatives", "malformed_email"]


def test_messy_warnings(load):
    c = cleaning(load, tables.MESSY)
    assert {r["type"]: r["affected_rows"] for r in c.audit().collect()} == {
        "remove_duplicates": 1,
        "trim_whitespace": 1,
    }
    found = [(r["kind"], r["column"]) for r in c.warnings().orderBy("ordinal").collect()]
    assert found == [
        ("outliers", "age"), ("outliers", "deposit_total"), ("outliers", "damage_rate"),
        ("negatives", "age"), ("negatives", "deposit_total"), ("negatives", "damage_rate"),
        ("malformed_email", "email"), ("mostly_null", "remarks"),
    ]


def copies(spark):
    rows = [(i, i % 50, "t" * (i % 3)) for i in range(300)] + [(1000 + i, 7, "hot") for i in range(500)]
    return spark.createDataFrame(rows, "k int, a int, b string").repartition(6)


def expected_firsts(df):
    first = {}
    for r in sorted(df.collect()):
        first.setdefault((r["a"], r["b"]), r["k"])
    return sorted((k, *ab) for ab, k in first.items())


def test_keep_first_is_the_first_by_order(spark):
    df = copies(spark)
    out = keep_first(df, ["a", "b"], ["k"])
    assert sorted(tuple(r) for r in out.collect()) == expected_firsts(df)


def test_keep_first_of_rows_equal_throughout(spark):
    rows = [(1, "x"), (1, "x"), (2, "x"), (None, None), (None, None), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "k int, b string")
    assert sorted(map(str, keep_first(df).collect())) == sorted(map(str, set(df.collect())))
    assert sorted(map(str, keep_first(df, ["b"], ["k"]).collect())) == sorted(
        map(str, spark.createDataFrame([(1, "x"), (None, None)], df.schema).collect())
    )


def test_order_by_a_cleaned_text_column(spark):
    rows = [("b ", "A@B.de", 1), ("b ", "A@B.de", 1), ("a", "nope", -2)]
    df = spark.createDataFrame(rows, "name string, email string, s1_age int")
    c = Cleaning(df, columns=["name", "email", "s1_age"], order_by=["name"])
    assert c.summary().first()["cleaned_rows"] == 2
    assert Cleaning(df).summary().first()["rows_removed"] == 1


def test_cleaning_keeps_columns_without_a_type(spark):
    df = spark.sql("select * from values (1, null, 'a '), (1, null, 'a '), (2, null, 'b') t(`x.y`, nothing, t)")
    c = Cleaning(df)
    assert c.cleaned.dtypes == df.dtypes and c.cleaned.count() == 2
    assert c.summary().first()["rows_removed"] == 1


def test_assess_and_clean_take_the_same_columns(spark):
    from plumbline import assess

    df = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 6)], "row_id int, t string, n int")
    assert assess(df, order_by=["row_id"]).row_copies().first()["exact_extra"] == 1
    assert Cleaning(df, order_by=["row_id"]).summary().first()["rows_removed"] == 1


def test_keep_first_leaves_a_table_without_copies_alone(spark):
    df = spark.range(100).withColumn("b", F.col("id").cast("string"))
    assert keep_first(df).sameSemantics(df)


def test_duplicate_counts_with_nulls(spark):
    rows = [(None, "A "), (None, "a"), (None, "A "), (1, "x"), (1, None), (1, None)]
    row = duplicate_counts(spark.createDataFrame(rows, "n int, t string")).first()
    assert tuple(row) == (6, 4, 2, 5, 3)


def test_digest_separates_shifted_cells(spark):
    rows = [("a", "bc"), ("ab", "c"), (None, "abc"), ("", "abc"), ("~", "abc")]
    assert duplicate_counts(spark.createDataFrame(rows, "x string, y string")).first()["exact_extra"] == 0


def test_redaction_of_a_sentence(spark):
    text = "Mail jane.doe@example.com or call +1-555-867-5309, SSN 123-45-6789, card 4111 1111 1111 1111."
    out = spark.createDataFrame([(text,)], "t string").select(redact_text(F.col("t"))).first()[0]
    assert out == (
        "Mail [EMAIL_REDACTED] or call [PHONE_REDACTED], SSN [SSN_REDACTED], card [CARD_REDACTED]."
    )


def test_redaction_of_nested_cells(spark):
    df = spark.createDataFrame(
        [({"note": "a@b.com", "token": "abc"}, [("x@y.org", 7)], None)],
        "m map<string,string>, s array<struct<mail:string,api_key:int>>, password string",
    )
    row = redact_table(df).first()
    assert row["m"] == {"note": "[EMAIL_REDACTED]", "token": "[SENSITIVE_REDACTED]"}
    assert row["s"][0]["mail"] == "[EMAIL_REDACTED]"
    assert row["s"][0]["api_key"] == "[SENSITIVE_REDACTED]"
    assert row["password"] is None


def test_batches_equal_one_run(spark, tmp_path):
    from plumbline.operators.duplicates import duplicate_counts, keep_first
    from plumbline.operators.history import RowHistory

    rows = [(i, draw, None if i % 7 == 0 else "x" * (i % 3), -0.0 if i % 2 else 0.0) for i, draw in enumerate([1, 2, 1, 3, 5] * 12)]
    df = spark.createDataFrame(rows, "row_id int, n int, t string, f double")
    columns, kept = ["n", "t", "f"], []
    for i in range(3):
        past = RowHistory(spark, str(tmp_path / "keys"), buckets=4 + i)  # as another session would
        kept += past.add(df.where(f"row_id div 20 = {i}"), f"b{i}", columns, ["row_id"]).collect()
    with pytest.raises(ValueError, match="added before"):
        past.add(df, "b1", columns, ["row_id"])
    assert sorted(kept) == sorted(keep_first(df, columns, ["row_id"]).collect())
    whole = duplicate_counts(df.select(columns), with_normalized=False).first()
    assert tuple(past.copies().first()) == (whole["rows"], whole["exact_affected"], whole["exact_extra"])
    assert tuple(RowHistory(spark, str(tmp_path / "none")).copies().first()) == (0, 0, 0)


def test_sketches_of_parts_merge(spark):
    from plumbline.operators import sketches

    df = spark.range(60_000).selectExpr("id", "id % 977 as few", "cast(null as int) as none", "if(id % 2 = 0, 0.0D, -0.0D) as zero")
    parts = [sketches.column_sketches(df.where(f"id % 3 = {i}")) for i in range(3)]
    united = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = {r["column"]: r for r in sketches.estimates(sketches.merged(united)).collect()}
    for column, n in (("id", 60_000), ("few", 977), ("none", 0), ("zero", 1)):
        assert got[column]["unique_low"] <= n <= got[column]["unique_high"] and got[column]["rows"] == 60_000
