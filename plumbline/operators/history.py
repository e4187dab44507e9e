"""Row copies in a table that grows batch by batch.

The keys of all rows so far stand in a folder, a part per batch, each key with how often
the batch had it. A new batch is compared with them by one anti-join on keys that are
bucketed alike, so the history isn't moved and its rows aren't read again. Keeping first
rows and counting copies batch after batch gives what one run over all rows gives.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import exprs as X
from plumbline.operators import duplicates
from plumbline.operators.facts import FRACTIONAL, kind_of

KEY = "__row_key"
NAME = re.compile(r"[A-Za-z0-9_.=-]+")


def row_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """SHA-256 over the typed cells of the columns, nulls included."""
    cells = []
    for i, c in enumerate(columns):
        cell = X.ref(c)
        if kind_of(df.schema[c].dataType) == FRACTIONAL:
            cell = F.when(cell == 0, F.abs(cell)).otherwise(cell)
        cells.append(cell.alias(f"c{i}"))
    return F.unhex(F.sha2(F.to_json(F.struct(*cells), {"ignoreNullFields": "false"}), 256))


class RowHistory:
    """Rows seen so far, by their keys, in one folder.

    A batch counts once its part is written whole, and a batch of the same name is not
    taken twice: run again after a failure, it first drops what was left of it.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[tuple[str, int]]:
        """(name, buckets) of the whole parts."""
        path, files = self._path("")
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        whole = [n for n in names if files.exists(self._path(f"{n}/_SUCCESS")[0])]
        return sorted((n.rsplit(",", 1)[0], int(n.rsplit(",", 1)[1])) for n in whole)

    def keys(self) -> list[DataFrame]:
        """(key, n) of each batch, bucketed by key."""
        out = []
        for name, buckets in self.batches():
            table = f"keys_{uuid.uuid4().hex}"
            self.spark.sql(
                f"create table {table} ({KEY} binary, n bigint) using parquet clustered by ({KEY}) "
                f"sorted by ({KEY}) into {buckets} buckets location '{self.folder}/{name},{buckets}'"
            )
            out.append(self.spark.table(table))
            self.spark.sql(f"drop table {table}")  # the files stay
        return out

    def add(
        self, batch: DataFrame, name: str, columns: Sequence[str] | None = None, order_by: Sequence[str] = ()
    ) -> DataFrame:
        """The rows of batch that no earlier batch has, one of each, the first by order_by."""
        if not NAME.fullmatch(name):
            raise ValueError(f"not a batch name: {name!r}")
        if name in dict(self.batches()):
            raise ValueError(f"batch {name} was added before")
        columns = duplicates.data_columns(batch, columns, order_by)
        first = duplicates.keep_first(batch, columns, order_by)
        kept = first.withColumn(KEY, row_key(batch, columns))
        for old in self.keys():
            kept = kept.join(old.select(KEY), KEY, "left_anti")
        counts = batch.select(row_key(batch, columns).alias(KEY)).groupBy(KEY).agg(F.count("*").alias("n"))
        path, files = self._path(f"{name},{self.buckets}")
        files.delete(path, True)
        table = f"keys_{uuid.uuid4().hex}"
        writer = counts.repartition(self.buckets, KEY).sortWithinPartitions(KEY).write
        writer.option("path", str(path)).bucketBy(self.buckets, KEY).sortBy(KEY).saveAsTable(table)
        self.spark.sql(f"drop table {table}")
        return kept.drop(KEY)

    def copies(self) -> DataFrame:
        """One row: rows, exact_affected, exact_extra over all batches."""
        paths = [f"{self.folder}/{name},{buckets}" for name, buckets in self.batches()]
        if not paths:
            return self.spark.createDataFrame([(0, 0, 0)], "rows bigint, exact_affected bigint, exact_extra bigint")
        n = F.col("n")
        # parts may differ in buckets, so they are read as plain files here
        parts = self.spark.read.schema(f"{KEY} binary, n bigint").parquet(*paths)
        groups = parts.groupBy(KEY).agg(F.sum("n").alias("n"))
        return groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
            F.coalesce(F.sum(F.when(n > 1, n)), F.lit(0)).alias("exact_affected"),
            F.coalesce(F.sum(n - 1), F.lit(0)).alias("exact_extra"),
        )
