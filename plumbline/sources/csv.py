"""CSV scan and physical type inference."""

from __future__ import annotations

from collections import Counter
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import constants as k
from plumbline.functions import exprs as X
from plumbline.operators.facts import melt
from plumbline.sources import ranges

INTEGER = r"^\s*[+-]?\d+\s*$"
FLOAT = (
    r"(?i)^\s*[+-]?(?:\d+\.?\d*(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?|inf|infinity)\s*$"
)
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")


#: With line breaks in quotes allowed, files beyond this are cut by byte ranges.
LARGE_BYTES = 64 << 20


def read_csv(
    spark: SparkSession, path: str, *, quoted_newlines: bool = True, large: int = LARGE_BYTES
) -> DataFrame:
    """A CSV file or folder with header rows, typed from its values.

    quoted_newlines allows line breaks inside quotes. Files up to ``large`` bytes are then
    one task each, larger ones are split and cut where a record ends; switch it off for
    files without such breaks, which any task can split at any line.
    Files of a folder may order their columns differently or lack some; a
    missing column is null. A row with more fields than its header is an error.
    """
    text = scan_text(spark, path, quoted_newlines=quoted_newlines, large=large)
    return cast_inferred(text, infer_physical(text))


def scan_text(
    spark: SparkSession, path: str, *, quoted_newlines: bool = True, large: int = LARGE_BYTES
) -> DataFrame:
    """The files as text columns with null tokens nulled.

    Files with the same first line are read together; names and first lines of the
    files reach the driver. Line breaks inside a header are understood in files beyond
    ``large``, and in others where all have the same header.
    """
    parts = []
    rest: str | list[str] = path
    if quoted_newlines:
        listed = spark.read.format("binaryFile").load(path)  # names and sizes alone, no content
        sizes = listed.select("_metadata.file_path", "_metadata.file_size").collect()
        big = sorted(unquote(r["file_path"]) for r in sizes if r["file_size"] > large)
        if big:
            parts = _cut(spark, big)
            rest = sorted({unquote(r["file_path"]) for r in sizes} - set(big))
    if rest:
        parts += _scanned(spark, rest, quoted_newlines)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _cut(spark: SparkSession, files: list[str]) -> list[DataFrame]:
    """The rows of large files, a table per header."""
    records = ranges.csv_records(spark, files)
    first = F.min_by(F.struct("number", "value"), "number").alias("first")
    headers: dict[str, list[tuple[str, int]]] = {}
    for r in records.groupBy("file").agg(first).orderBy("file").collect():
        headers.setdefault(r["first"]["value"], []).append((r["file"], r["first"]["number"]))
    out = []
    for header, found in headers.items():
        of = spark.createDataFrame(found, "file string, head long")
        rows = records.join(of, "file").filter("number > head").select("value")
        names = column_names(_cells_of(spark, header))
        schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", __surplus string"
        cells = rows.select(F.from_csv("value", F.lit(schema), {"escape": '"'}).alias("r")).select("r.*")
        out.append(_named(cells, names))
    return out


def _scanned(spark: SparkSession, path: str | list[str], quoted_newlines: bool) -> list[DataFrame]:
    reader = spark.read.options(
        escape='"', multiLine=str(quoted_newlines).lower(), encoding="UTF-8"
    )
    by_header: dict[str, list[str]] = {}
    for r in _first_lines(spark, path).orderBy("file").collect():
        by_header.setdefault(r["header"], []).append(unquote(r["file"]))
    if len(by_header) < 2:
        head = reader.option("header", "false").csv(path).first()
        return [_rows(reader, path, column_names([] if head is None else list(head)))]
    return [
        _rows(reader, files, column_names(_cells_of(spark, header)))
        for header, files in by_header.items()
    ]


def _first_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, header): the first line with content of each file."""
    begins = spark.read.text(path).where("_metadata.file_block_start = 0 and value <> ''")
    lines = begins.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.monotonically_increasing_id().alias("i"), "value").alias("line"),
    )
    firsts = lines.groupBy("file").agg(F.min("line").alias("m"))
    return firsts.select("file", F.col("m.value").alias("header"))


def _cells_of(spark: SparkSession, header: str) -> list[str | None]:
    """The cells of one CSV line."""
    line = spark.createDataFrame([(header,)], "value string")
    schema = ", ".join(f"c{i} string" for i in range(header.count(",") + 1))
    cells = list(line.select(F.from_csv("value", F.lit(schema), {"escape": '"'}).alias("c")).select("c.*").first())
    commas = F.regexp_replace("value", r'"(?:[^"]|"")*"', "")
    n = line.select(F.length(F.regexp_replace(commas, "[^,]", ""))).first()[0] + 1
    return cells[:n]


def _rows(reader, path: str | list[str], names: list[str]) -> DataFrame:
    """The rows under a header."""
    schema = ", ".join(f"c{i} string" for i in range(len(names))) + ", __surplus string"
    return _named(reader.options(header="true", enforceSchema="true").schema(schema).csv(path), names)


def _named(raw: DataFrame, names: list[str]) -> DataFrame:
    too_many = F.raise_error(F.lit("a row has more fields than the header")).cast("boolean")
    raw = raw.where(F.when(F.col("__surplus").isNull(), F.lit(True)).otherwise(too_many))
    return raw.select(*[null_tokens(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def column_names(header: list[str | None]) -> list[str]:
    """Header cells as unique names: a repeated name gets .1, .2 and so on."""
    seen: Counter = Counter()
    out = []
    for i, cell in enumerate(header):
        name = (cell or "").lstrip("﻿") or f"Unnamed: {i}"
        out.append(f"{name}.{seen[name]}" if seen[name] else name)
        seen[name] += 1
    return out


def null_tokens(c: Column) -> Column:
    return F.when(~c.isin(*k.CSV_NULL_TOKENS), c)


def physical_counts(df: DataFrame) -> DataFrame:
    """Per text column: values, and how many read as integer, number or boolean."""
    v = F.col("value")
    is_integer = v.rlike(INTEGER) & F.btrim(v).try_cast("bigint").isNotNull()
    is_number = v.rlike(FLOAT)
    return (
        melt(df, range(len(df.columns)), "string")
        .groupBy("ordinal")
        .agg(
            F.count("*").alias("filled"),
            F.count_if(is_integer).alias("integers"),
            F.count_if(is_number).alias("numbers"),
            F.count_if(v.isin(*BOOLEANS)).alias("booleans"),
        )
    )


def infer_physical(df: DataFrame) -> DataFrame:
    """Column, counts and inferred type; a column without values counts as double."""
    names = F.array(*[F.struct(F.lit(str(i)).alias("ordinal"), F.lit(c).alias("column")) for i, c in enumerate(df.columns)])
    columns = df.sparkSession.range(1).select(F.inline(names))
    filled = F.coalesce("filled", F.lit(0))
    return columns.join(physical_counts(df), "ordinal", "left").select(
        F.col("ordinal").cast("int").alias("ordinal"),
        "column",
        filled.cast("bigint").alias("filled"),
        F.when(filled == 0, "double")
        .when(F.col("integers") == filled, "bigint")
        .when(F.col("numbers") == filled, "double")
        .when(F.col("booleans") == filled, "boolean")
        .otherwise("string")
        .alias("physical_type"),
    )


def cast_inferred(df: DataFrame, inferred: DataFrame) -> DataFrame:
    types = {r["column"]: r["physical_type"] for r in inferred.collect()}
    return df.select(
        *[
            (X.ref(c) if types[c] == "string" else F.btrim(X.ref(c)).try_cast(types[c])).alias(c)
            for c in df.columns
        ]
    )
