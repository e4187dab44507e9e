"""Exact duplicates by progressive refinement, built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import keep

BLANKS = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 64


def exact_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    digest_all: bool = False,
) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without the characters of ``BLANKS``; a null text is
    empty, and all empty texts are equal. Of equal texts the one with the most code
    points stays, then the one with the least id (null last). Rows are grouped by
    length; those of lengths with company by a hash of their first characters; and only
    those still in company by the hash of the whole text. text_sha256 is null for rows
    that were alone before, unless ``digest_all`` asks for all digests, which are then
    computed while the text is read for the first time. Repeated rows, with equal ids,
    are all kept or all dropped. Other columns are not looked at.

    Only keys are shuffled when ``digest_all`` is set, never texts. A text held by a
    third of the rows is one row per task in every count; the last join is split by
    adaptive execution where its key is hot.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.regexp_replace(text, BLANKS, "")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.length(text).alias("n_chars"), plain.alias("plain")
    ).select(
        "doc_id",
        "n_chars",
        F.octet_length("plain").alias("size"),
        F.xxhash64(F.substring("plain", 1, prefix_chars)).alias("prefix"),
        (F.unhex(F.sha2("plain", 256)) if digest_all else F.col("plain")).alias("content"),
    )
    if digest_all:
        rows = keep(rows)
    lengths = rows.groupBy("size").count().filter("count > 1").select("size")
    in_company = rows.select("size", "prefix").join(lengths, "size", "left_semi")
    prefixes = in_company.groupBy("size", "prefix").count().filter("count > 1").drop("count")
    digest = F.col("content") if digest_all else F.unhex(F.sha2("content", 256))
    ends = rows.join(prefixes, ["size", "prefix"], "left_semi").withColumn("digest", digest)
    first = F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("z"), "doc_id")
    groups = (
        ends.groupBy("digest")
        .agg(F.count("*").alias("n"), F.min(first).alias("first"))
        .filter("n > 1")
        .select("digest", "n", F.col("first.doc_id").alias("first_id"))
    )
    if digest_all:
        out = rows.withColumn("digest", F.col("content")).join(groups, "digest", "left")
    else:
        alone = rows.join(prefixes, ["size", "prefix"], "left_anti")
        out = ends.select("doc_id", "digest").join(groups, "digest", "left").unionByName(
            alone.select("doc_id"), allowMissingColumns=True
        )
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
