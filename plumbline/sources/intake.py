"""File intake: verdicts over folders and manifests, previews, retention."""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import datetime
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import constants as k
from plumbline.functions import exprs as X

PREVIEW_ROWS = 5


# ---- names --------------------------------------------------------------------------


def file_name(path: Column) -> Column:
    """The last path segment without NUL characters."""
    bare = F.regexp_replace(path, "\x00", "")
    return F.regexp_extract(F.regexp_replace(bare, r"(?:/\.?)+$", ""), r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """From the last dot, when it is neither the first nor the last character."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def sanitize_filename(path: Column) -> Column:
    """A safe file name: no folders, only letters, digits, _ and - before the suffix."""
    name = file_name(path)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")
    safe_stem = F.btrim(F.regexp_replace(stem, r"[^a-zA-Z0-9_\-]", "_"), F.lit("._"))
    safe_suffix = F.regexp_replace(extension(path), r"[^a-zA-Z0-9.]", "")
    return F.concat(F.coalesce(F.nullif(safe_stem, F.lit("")), F.lit("dataset")), safe_suffix)


# ---- verdicts -----------------------------------------------------------------------


def mime_verdict(path: Column, content_type: Column) -> Column:
    """accepted, or the first rule a file name and MIME type break."""
    ext = extension(path)
    mime = F.btrim(F.regexp_extract(F.lower(content_type), r"^([^;]*)", 1))
    given = content_type.isNotNull() & (content_type != "")
    blocked = F.lit(False)
    for prefix in k.BLOCKED_MIME_PREFIXES:
        blocked = blocked | F.startswith(mime, F.lit(prefix))
    return (
        F.when(~ext.isin(*k.EXTENSIONS), "unsupported extension")
        .when(given & blocked, "disallowed MIME type")
        .when(given & (ext == ".csv") & ~mime.isin(*k.CSV_MIMES), "MIME type not valid for CSV")
        .when(given & (ext == ".json") & ~mime.isin(*k.JSON_MIMES), "MIME type not valid for JSON")
        .otherwise("accepted")
    )


def check_manifest(manifest: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Verdict rows for (filename, content_type, size); no size limit unless one is given."""
    size = F.col("size")
    verdict = mime_verdict(F.col("filename"), F.col("content_type"))
    too_large = F.lit(False) if max_bytes is None else size > max_bytes
    return manifest.select(
        "*",
        F.when(verdict != "accepted", verdict)
        .when(size == 0, "empty file")
        .when(too_large, "file too large")
        .otherwise("accepted")
        .alias("verdict"),
    )


def _is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def content_verdict(path: Column, text: Column) -> Column:
    """accepted, or what is wrong with a whole text under a file name.

    A JSON text is one document, or every line with content is one.
    """
    body = F.regexp_replace(text, "^﻿", "")
    lines = F.filter(F.split(body, r"\r\n|\n|\r"), lambda line: X.strip(line) != "")
    lines_ok = (F.size(lines) > 0) & F.forall(lines, _is_json)
    json_ok = F.is_valid_utf8(text) & (_is_json(body) | lines_ok)
    return (
        F.when(~extension(path).isin(*k.EXTENSIONS), "unsupported extension")
        .when(F.octet_length(text) == 0, "empty file")
        .when((extension(path) == ".csv") & ~F.is_valid_utf8(text), "not UTF-8 text")
        .when((extension(path) == ".csv") & (X.strip(text) == ""), "blank CSV")
        .when((extension(path) == ".json") & ~F.coalesce(json_ok, F.lit(False)), "invalid JSON")
        .otherwise("accepted")
    )


def check_folder(spark: SparkSession, folder: str, max_bytes: int | None = None) -> DataFrame:
    """One verdict row per file of a folder, with the lines that are no JSON by themselves.

    There is no size limit unless one is given. Contents are checked line by line, all
    lines of every file, so a file need not fit one row. Only a JSON file that isn't
    JSON by lines is read whole: a document over many lines is one value by nature.
    The names of the files are on the driver, as in any read of a folder.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.col("path")
    known = extension(path).isin(*k.EXTENSIONS)
    # Spark lists empty files but does not scan them
    location = F.regexp_replace("path", r"^(\w+):/+", "$1:/").alias("path")
    found = spark.createDataFrame([(unquote(f),) for f in files.inputFiles()], "path string")
    empty = found.select(location).join(files.select(location), "path", "left_anti")
    listed = files.select(location, "length").unionByName(
        empty.select("path", F.lit(0).cast("bigint").alias("length"))
    )
    too_large = F.lit(False) if max_bytes is None else F.col("length") > max_bytes
    text = spark.read.option("recursiveFileLookup", "true")
    where = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), r"^(\w+):/+", "$1:/")
    bare = F.regexp_replace("value", "^﻿", "")  # repairs what is no text, so that is asked first
    lines = text.text(folder).select(
        where.alias("path"), bare.alias("value"), F.is_valid_utf8("value").alias("valid")
    ).where(known)
    is_json_file = extension(path) == ".json"
    filled = X.strip(F.col("value")) != ""
    by_lines = lines.groupBy("path").agg(
        F.count_if(filled).alias("filled"),
        F.count_if(filled & is_json_file & ~_is_json(F.col("value"))).alias("bad_lines"),
        F.count_if(~F.col("valid")).alias("not_text"),
    )
    doubtful = by_lines.where(is_json_file & (F.col("bad_lines") > 0)).select("path")
    whole = text.text(folder, wholetext=True).select(where.alias("path"), bare.alias("value"))
    documents = whole.join(doubtful, "path", "left_semi").where(_is_json(F.col("value")))
    documents = documents.select("path", F.lit(True).alias("document"))
    checked = listed.join(by_lines, "path", "left").join(documents, "path", "left")
    no_lines = F.coalesce(F.col("filled"), F.lit(0)) == 0
    bad = (F.col("bad_lines") > 0) & F.col("document").isNull()
    not_text = F.coalesce(F.col("not_text"), F.lit(0)) > 0
    verdict = (
        F.when(~known, "unsupported extension")
        .when(F.col("length") == 0, "empty file")
        .when(too_large, "file too large")
        .when((extension(path) == ".csv") & not_text, "not UTF-8 text")
        .when((extension(path) == ".csv") & no_lines, "blank CSV")
        .when(is_json_file & (not_text | no_lines | F.coalesce(bad, F.lit(False))), "invalid JSON")
        .otherwise("accepted")
    )
    return checked.select(
        sanitize_filename(path).alias("filename"),
        F.regexp_replace(extension(path), r"^\.", "").alias("format"),
        F.col("length").alias("size_bytes"),
        verdict.alias("verdict"),
        F.when(F.col("document").isNull(), F.coalesce("bad_lines", F.lit(0))).otherwise(0).alias("bad_lines"),
    )


# ---- preview ------------------------------------------------------------------------


def preview(df: DataFrame, order_by: Sequence[str], rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows by a key (a top-k per task, then merged)."""
    return df.orderBy(*[X.ref(c) for c in order_by]).limit(rows)


def preview_shape(df: DataFrame) -> DataFrame:
    """One row: column names, column count and the true row count."""
    return df.agg(F.count("*").alias("row_count")).select(
        F.lit(", ".join(df.columns)).alias("columns"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        "row_count",
    )


# ---- retention ----------------------------------------------------------------------


def _age_limit(as_of: datetime | str, hours: float) -> Column:
    return F.lit(as_of).cast("timestamp") - F.make_dt_interval(secs=F.lit(hours * 3600.0))


def retained(
    df: DataFrame, ts: str, as_of: datetime | str, hours: float = k.RETENTION_HOURS
) -> DataFrame:
    """Entries not older than the retention period; exactly at the limit stays."""
    return df.where(X.ref(ts) >= _age_limit(as_of, hours))


def purge_summary(
    df: DataFrame, ts: str, as_of: datetime | str, hours: float = k.RETENTION_HOURS
) -> DataFrame:
    expired = X.ref(ts) < _age_limit(as_of, hours)
    return df.agg(
        F.count_if(expired).alias("purged"),
        (F.count("*") - F.count_if(expired)).alias("retained"),
    )


def _checked_id(dataset_id: str) -> str:
    if not re.match(k.DATASET_ID, dataset_id or ""):
        raise ValueError("a dataset id has 8 to 64 letters, digits, _ or -")
    return dataset_id


def delete_dataset(df: DataFrame, dataset_id: str, id_column: str = "dataset_id") -> DataFrame:
    """All rows but the dataset's; apply it to its audit table as well."""
    wanted = _checked_id(dataset_id)
    return df.where(~X.ref(id_column).eqNullSafe(F.lit(wanted)))


def delete_summary(df: DataFrame, dataset_id: str, id_column: str = "dataset_id") -> DataFrame:
    """One row: rows deleted and whether anything was there."""
    gone = F.count_if(X.ref(id_column) == F.lit(_checked_id(dataset_id)))
    return df.agg(gone.alias("deleted_rows"), (gone > 0).alias("deleted"))
