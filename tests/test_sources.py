"""CSV and JSON scans, sinks and intake."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plumbline.sources import intake, sinks
from plumbline.sources.csv import read_csv
from plumbline.sources.json import JsonError, detect_shape, dropped_lines, read_json


@pytest.fixture
def write(tmp_path):
    def to_file(name: str, content) -> str:
        path = tmp_path / name
        path.write_bytes(content if isinstance(content, bytes) else content.encode("utf-8"))
        return str(path)

    return to_file


def test_csv_types_null_tokens_and_names(spark, write):
    text = (
        "﻿n,x,flag,t,t,empty,big\n"
        '1,1.5,True,N/A,"a ""quoted"" cell, with comma",,99999999999999999999\n'
        "\n"
        '-2,NaN,false, N/A ,"two\nlines",NULL,1\n'
        "3,2,,none,é,,2\n"
    )
    df = read_csv(spark, write("a.csv", text))
    assert dict(df.dtypes) == {
        "n": "bigint", "x": "double", "flag": "boolean", "t": "string", "t.1": "string",
        "empty": "double", "big": "double",
    }
    rows = df.orderBy(F.desc("n")).collect()
    assert [r["t"] for r in rows] == ["none", None, " N/A "]
    assert [r["t.1"] for r in rows] == ["é", 'a "quoted" cell, with comma', "two\nlines"]
    assert [r["x"] for r in rows] == [2.0, 1.5, None]


def test_csv_with_too_many_fields(spark, write):
    path = write("b.csv", "a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, path).collect()


def test_csv_folder_with_other_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,x\n')
    (tmp_path / "b.csv").write_text('b,a\nz,3\n')
    (tmp_path / "c.csv").write_text('a,"c, d"\n5,"l\nm"\n')
    df = read_csv(spark, str(tmp_path))
    assert df.columns == ["a", "b", "c, d"] and dict(df.dtypes)["a"] == "bigint"
    assert sorted(map(tuple, df.collect())) == [(1, "x", None), (3, "z", None), (5, None, "l\nm")]


SHAPES = {
    "records": ([{"product": "x", "price": 1.5, "ok": True}, {"product": "y", "price": 2, "ok": False}],
                ["product", "price", "ok"], 2),
    "wrapper": ({"meta": 1, "data": [{"id": 1, "user": {"name": "n", "city": "c"}, "tags": ["a", "é"]}]},
                ["id", "user.city", "user.name", "tags"], 1),
    "record_map": ({"r1": {"a": 1, "b": {"c": 2}}, "r2": {"a": 2.5}}, ["a", "b"], 2),
    "columns": ({"c2": [1, 2, 3], "c1": ["x", "y", "z"]}, ["c2", "c1"], 3),
    "object": ({"id": 1, "name": "n", "nested": {"b": 1, "a": [1, 2]}}, ["id", "name", "nested"], 1),
    "scalars": ([1, 2, 3], ["value"], 3),
}


@pytest.mark.parametrize("shape", list(SHAPES))
@pytest.mark.parametrize("bom", ["", "﻿"])
def test_json_shapes(spark, write, shape, bom):
    data, columns, rows = SHAPES[shape]
    path = write(f"{shape}.json", bom + json.dumps(data, ensure_ascii=False, indent=1))
    assert detect_shape(spark, path)[0] == shape
    df = read_json(spark, path)
    assert df.columns == columns and df.count() == rows


def test_json_cells(spark, write):
    path = write("o.json", json.dumps({"id": 1, "nested": {"b": "é\n", "a": [1, None]}}))
    assert read_json(spark, path).first()["nested"] == '{"a": [1, null], "b": "é\\n"}'
    uneven = write("u.json", json.dumps({"a": [1, 2], "b": [1]}))
    assert detect_shape(spark, uneven)[0] == "object"
    assert read_json(spark, uneven).first()["a"] == "[1, 2]"
    scalars = read_json(spark, write("s.json", '["a", "b"]'))
    assert sorted(r["value"] for r in scalars.collect()) == ["a", "b"]
    assert read_json(spark, write("e.json", "[]")).columns == []
    assert read_json(spark, write("blank.json", "  \n")).columns == []


def test_json_lines_drop_bad_lines(spark, write):
    path = write("l.json", '{"id": 1, "p": {"k": "a"}}\nnot json\n{"id": 2, "p": {"k": "b"}}\n')
    df = read_json(spark, path)
    assert df.columns == ["id", "p.k"] and sorted(r["id"] for r in df.collect()) == [1, 2]
    assert tuple(dropped_lines(spark, path).first()) == (3, 1)
    with pytest.raises(JsonError):
        read_json(spark, write("bad.json", "{ not a valid json\nat all"))


def test_sinks_keep_padding_and_refuse_the_source(spark, tmp_path):
    df = spark.createDataFrame([(1, "  padded "), (2, 'q"uote'), (3, None)], "id int, t string")
    path = str(tmp_path / "out")
    sinks.write_csv(df, path)
    back = {r["id"]: r["t"] for r in read_csv(spark, path).collect()}
    assert back == {1: "  padded ", 2: 'q"uote', 3: None}
    with pytest.raises(ValueError):
        sinks.write_json(df, path, source=f"file:{path}/")


def test_audit_table_returns_the_latest_run(spark, tmp_path):
    schema = "dataset_id string, step int, type string"
    path = str(tmp_path / "audit")
    sinks.append_audit(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], schema), path)
    sinks.append_audit(spark.createDataFrame([("a", 1, "z"), ("b", 1, "w")], schema), path)
    rows = sinks.read_audit(spark, path).collect()
    assert sorted((r["dataset_id"], r["type"]) for r in rows) == [("a", "z"), ("b", "w")]


def test_folder_verdicts(spark, write, tmp_path):
    write("good.csv", "a,b\n1,é\n")
    write("bad.csv", b"\xff\xfe\x00\x00\x80")
    write("blank.csv", " \n ")
    write("empty.json", b"")
    write("good.json", '﻿{"a": 1}')
    write("lines.json", '{"a": 1}\n{"a": 2}\n')
    write("broken.json", "{ not valid")
    write("notes.txt", "x")
    write("with space.csv", "a\n1\n")
    write("large.csv", "a\n" + "1\n" * 100)
    found = intake.check_folder(spark, str(tmp_path), max_bytes=100).collect()
    assert len(found) == 10
    assert {r["filename"]: r["verdict"] for r in found} == {
        "with_space.csv": "accepted",
        "good.csv": "accepted", "bad.csv": "not UTF-8 text", "blank.csv": "blank CSV",
        "empty.json": "empty file", "good.json": "accepted", "lines.json": "accepted",
        "broken.json": "invalid JSON", "notes.txt": "unsupported extension",
        "large.csv": "file too large",
    }


@pytest.mark.parametrize(
    ("name", "safe"),
    [
        ("../../etc/passwd.csv", "passwd.csv"),
        ("my data (1).CSV", "my_data__1.csv"),
        ("a\x00b.json", "ab.json"),
        (".csv", "csv"),
        ("...", "dataset"),
        ("C:\\tmp\\x.csv", "C__tmp_x.csv"),
        ("folder/", "folder"),
    ],
)
def test_sanitized_names(spark, name, safe):
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(intake.sanitize_filename(F.col("n"))).first()[0] == safe


def test_retention_is_strict_and_ids_are_checked(spark):
    rows = [("d1", "2024-01-01 00:00:00"), ("d2", "2024-01-01 00:00:01"), ("d3", "2023-12-31 23:59:59")]
    df = spark.createDataFrame(rows, "dataset_id string, at string").withColumn("at", F.col("at").cast("timestamp"))
    kept = intake.retained(df, "at", "2024-01-02 00:00:00")
    assert sorted(r["dataset_id"] for r in kept.collect()) == ["d1", "d2"]
    assert intake.purge_summary(df, "at", "2024-01-02 00:00:00").first()["purged"] == 1
    with pytest.raises(ValueError):
        intake.delete_dataset(df, "../x")
    named = spark.createDataFrame([("abcdefgh",), ("other_id",)], "dataset_id string")
    assert intake.delete_dataset(named, "abcdefgh").count() == 1
    assert intake.delete_summary(named, "missing-one").first()["deleted"] is False


def test_json_folder_of_several_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": [{"a": 1}, {"a": 2}]}')
    (tmp_path / "b.json").write_text('[{"a": 3}]')
    (tmp_path / "c.json").write_text('{"r1": {"a": 4}, "r2": {"a": 5}}')
    (tmp_path / "d.json").write_text('{"r9": {"a": 6, "b": "x"}}')
    (tmp_path / "e.json").write_text('{"a": 7}\n{"a": 8}\n5\n{broken\n')
    (tmp_path / "f.json").write_text('{"b": ["y", "z"], "a": [9, 10]}')
    (tmp_path / "g g.json").write_text("[]")
    df = read_json(spark, str(tmp_path))
    assert sorted((r["a"], r["b"]) for r in df.collect()) == [
        (1, None), (2, None), (3, None), (4, None), (5, None), (6, "x"), (7, None), (8, None), (9, "y"), (10, "z"),
    ]
    assert tuple(dropped_lines(spark, str(tmp_path / "e.json")).first()) == (4, 2)


ODD = ["a,b", '"', '\\\\', '\\', '[{"x": 1}, ', '\\",', "é,한😀", "line\nbreak", "", ",,,,", "}", '{"k": [', " "]
RECORDS = [{"id": i, "t": ODD[i % 13] * (1 + i % 5), "n": {"a": [i, 2], "b": {"c": "]}"}, "d": None}} for i in range(60)]
CUT = {
    "records": RECORDS,
    "scalars": [*ODD * 4, None, 1, "x, y", 2.5],
    "wrapper": {"meta": {"d": [{"a": 1}]}, "n": 5, "s": "a,]", "data": RECORDS, "z": []},
    "record_map": {f'r{i}"{ODD[i % 13]}': r for i, r in enumerate(RECORDS)},
    "columns": {"c,2": list(range(52)), 'c"1': ODD * 4, "c0": [[i, {"x": "],"}] for i in range(52)]},
}


@pytest.mark.parametrize("shape", list(CUT))
def test_json_documents_cut_anywhere(spark, tmp_path, shape):
    for i in range(2):  # one line, and many with other bytes
        text = json.dumps(CUT[shape], ensure_ascii=i == 1, indent=1 if i and shape != "columns" else None)
        (tmp_path / f"{i}.json").write_text("\ufeff" * i + text + "\n" * i)
    whole = read_json(spark, str(tmp_path))
    kept = {c: spark.conf.get(c, None) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in (397,):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
            cut = read_json(spark, str(tmp_path), large=0)
            assert cut.dtypes == whole.dtypes
            assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
    finally:
        for c, v in kept.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def test_json_that_is_no_document(spark, write):
    for text in ("[1, 2", "[1}", "[1,,2]", "[1,]", '{"a" 1}', '["a]'):
        with pytest.raises(JsonError):
            read_json(spark, write("bad.json", text), large=0)
    assert read_json(spark, write("lines.json", '{"a": 1}\n{"a": 2}\n'), large=0).count() == 2
    assert read_json(spark, write("e.json", " [ ] "), large=0).columns == []
    assert read_json(spark, write("o.json", '{"a": [1], "b": [1, 2]}'), large=0).first()["b"] == "[1, 2]"


def test_csv_cut_anywhere(spark, tmp_path):
    import csv

    draw = random.Random(4)
    odd = ["a,b", 'q"q', '"', "two\nlines", "\n\n", ",\n,", '",\n"', "é한😀", "", "plain", " x ", 'end"', "\n\"\n"]
    for name, end in (("a", "\n"), ("b", "\r\n")):
        with open(tmp_path / f"{name}.csv", "w", newline="") as f:
            out = csv.writer(f, lineterminator=end)
            out.writerow(["id", "te,xt", "multi\nline" if name == "a" else "multi", "n"])
            for i in range(120):
                out.writerow([i, draw.choice(odd), draw.choice(odd) * draw.randrange(1, 6), i / 2])
    kept = {c: spark.conf.get(c, None) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for name in ("a", "b"):
        whole = read_csv(spark, str(tmp_path / f"{name}.csv"))
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", "331")
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            cut = read_csv(spark, str(tmp_path / f"{name}.csv"), large=0)
            assert cut.dtypes == whole.dtypes
            got = sorted(map(str, cut.collect()))
        finally:
            for c, v in kept.items():
                spark.conf.unset(c) if v is None else spark.conf.set(c, v)
        assert got == sorted(map(str, whole.collect())) and len(got) == 120


def test_csv_cut_keeps_plain_quotes(spark, write):
    text = 'a,b\n5" pipe,x\n\n"un""closed, 1\n2",y\nz,"\n"\nlast,"no break"'
    whole, cut = (read_csv(spark, write("p.csv", text), large=n) for n in (1 << 30, 0))
    assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect())) and cut.count() == 4
    with pytest.raises(Exception, match="more fields"):
        read_csv(spark, write("b.csv", "a,b\n1,2\n3,4,5\n6\n"), large=0).collect()
