"""Writing cleaned rows and audits; the source is never overwritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.flatten import nested_to_json


def _refuse_source(path: str, source: str | None) -> None:
    def clean(p: str) -> str:
        return p.removeprefix("file:").replace("//", "/").rstrip("/")

    if source is not None and clean(path) == clean(source):
        raise ValueError("the cleaned copy must not replace its source")


def write_csv(df: DataFrame, path: str, source: str | None = None) -> None:
    """A folder of UTF-8 CSV files with header; fails if path exists."""
    _refuse_source(path, source)
    writer = nested_to_json(df).write.options(header="true", escape='"', encoding="UTF-8")
    # Spark strips padding when it writes CSV unless told not to
    keep_padding = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    writer.options(**keep_padding).csv(path)


def write_json(df: DataFrame, path: str, source: str | None = None) -> None:
    """A folder of JSON Lines files in which null cells stay visible."""
    _refuse_source(path, source)
    df.write.option("ignoreNullFields", "false").json(path)


def append_audit(audit: DataFrame, path: str) -> None:
    """Add the audit rows of a cleaning run to the audit table."""
    audit.withColumn("recorded_at", F.current_timestamp()).write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """The latest run of each dataset in the audit table."""
    audit = spark.read.parquet(path)
    latest = audit.groupBy("dataset_id").agg(F.max("recorded_at").alias("recorded_at"))
    return audit.join(latest, ["dataset_id", "recorded_at"])
