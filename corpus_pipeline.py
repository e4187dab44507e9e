"""The training corpus, stage by stage: each stage works on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
Null, empty, very long and repeated texts, empty tables and further columns are handled
as the operators say; further columns travel along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import decontaminate, mixing, near_dups, quality, token_store
from plumbline.llm.queries import table, word_tokenizer
from plumbline.session import keep, shared_folder


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_enough(docs, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dups.without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"), spread=decontaminate.MAX_EDITS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources draws them; drawn again, they repeat."""
    return mixing.mixed(docs).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store of the drawn documents, read back: one row per drawn document."""
    path = shared_folder(spark)
    token_store.write_store(docs, path, word_tokenizer())
    return token_store.read_documents(spark, path)


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]
#: The classifier, the embedding search and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, start, n_tokens, ids_crc32."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
