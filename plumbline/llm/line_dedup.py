"""Lines that many documents hold, kept only in the first document that has them.

The lines seen so far are a small number of sorted runs of 128-bit line hashes, in
levels: a batch of documents adds one run to level 0, and when a level holds ``fanout``
runs they are merged into one run of the next level, so n batches leave about
``fanout * log(n)`` runs and every hash is rewritten once a level. Runs are tables
bucketed and sorted by hash: a new batch's hashes are dealt out once by the same buckets
and merge-anti-joined with every run where it lies, without moving the history.

Batches come in ascending order of ids, so the batch that brings a line first holds its
smallest id. Built-in functions only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import keep, shared_folder

#: Runs of one level that are merged into a run of the next.
FANOUT = 3
#: Batches into which a whole table is cut, by ranges of ids.
BATCHES = 6
LEAST_LETTERS = 10
#: A line with this share of a batch's lines or more is told to all tasks instead of
#: being dealt out: there can be no more than 1024 such lines.
HOT_PARTS = 1024

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_hashes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_LETTERS
) -> DataFrame:
    """(doc_id, tie, place, h1, h2) of each line whose key has at least ``least`` letters.

    tie tells rows of the same id with different texts apart; place counts from 0. Two
    different keys share both hashes with a chance of 2**-128.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("tie"),
        F.posexplode(F.split(text, "\n", -1)).alias("place", "line"),
    )
    keys = lines.select("doc_id", "tie", "place", key_of(F.col("line")).alias("key"))
    return keys.filter(F.char_length("key") >= least).select(
        "doc_id", "tie", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2")
    )


class LineRuns:
    """The lines of all batches so far, as levelled runs in one folder.

    Runs carry their level and the batches they cover in their names, and count once
    they are whole; opening a folder again goes on where the last whole batch ended. A
    merged run replaces what it covers, so that a merge cut short loses nothing.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str | None = None,
        fanout: int = FANOUT,
        buckets: int | None = None,
    ) -> None:
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared_folder(spark)
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, str] = {}
        self._open()

    # a run's name: level, first and last batch, buckets

    @staticmethod
    def _parts(run: str) -> tuple[int, int, int, int]:
        level, first, last, buckets = run.split("-")
        return int(level), int(first), int(last), int(buckets)

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _open(self) -> None:
        at, files = self._files(self.folder)
        if not files.exists(at):
            return
        found = []
        for entry in files.listStatus(at):
            name = entry.getPath().getName()
            done, _ = self._files(f"{self.folder}/{name}/_SUCCESS")
            if files.exists(done):
                found.append(name)
        for name in found:
            _, first, last, _ = self._parts(name)
            covers = [self._parts(other) for other in found if other != name]
            if not any(f <= first and last <= l for _, f, l, _ in covers):
                self._register(name)

    def _register(self, run: str) -> None:
        table = f"runs_{uuid.uuid4().hex}"
        buckets = self._parts(run)[3]
        self.spark.sql(
            f"create table {table} (h1 bigint, h2 bigint) using parquet clustered by (h1, h2) "
            f"sorted by (h1, h2) into {buckets} buckets location '{self.folder}/{run}'"
        )
        self.runs[run] = table

    def _bucketed(self, rows: DataFrame, path: str) -> str:
        """The name of a table of rows, which are dealt out by (h1, h2) already."""
        table = f"runs_{uuid.uuid4().hex}"
        writer = rows.sortWithinPartitions("h1", "h2").write.option("path", path)
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(table)
        return table

    def _write(self, hashes: DataFrame, run: str) -> None:
        self.runs[run] = self._bucketed(hashes, f"{self.folder}/{run}")

    def _forget(self, run: str) -> None:
        self.spark.sql(f"drop table {self.runs.pop(run)}")
        at, files = self._files(f"{self.folder}/{run}")
        files.delete(at, True)

    def close(self) -> None:
        """The tables' names go; the runs stay in their folder."""
        for table in self.runs.values():
            self.spark.sql(f"drop table {table}")
        self.runs = {}

    def ordered(self) -> list[str]:
        return sorted(self.runs, key=self._parts)

    def _compact(self) -> None:
        level = 0
        while True:
            full = [r for r in self.ordered() if self._parts(r)[0] == level]
            if len(full) < self.fanout:
                return
            # a hash is in one run only, so a merge is a union
            merged = reduce(DataFrame.union, [self.spark.table(self.runs[r]) for r in full])
            merged = merged.repartition(self.buckets, "h1", "h2")
            first, last = min(self._parts(r)[1] for r in full), max(self._parts(r)[2] for r in full)
            self._write(merged, f"{level + 1}-{first:06d}-{last:06d}-{self.buckets}")
            for run in full:
                self._forget(run)
            level += 1

    def add(self, lines: DataFrame) -> DataFrame:
        """Rows of lines (as line_hashes gives them) that are to go; the rest is remembered.

        A line goes if an earlier batch had it, or if another document of this batch with
        a smaller id has it. lines is read three times and should be a written table. Null
        ids come after all others.
        """
        keys = lines.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("first"),
            F.max("doc_id").alias("last"),
            F.bool_or(F.col("doc_id").isNull()).alias("nameless"),
            F.count("*").alias("n"),
            F.lit(False).alias("seen"),
        )
        for i, run in enumerate(self.ordered()):
            old = self.spark.table(self.runs[run]).withColumn(f"in{i}", F.lit(True)).hint("merge")
            keys = keys.join(old, ["h1", "h2"], "left")
            keys = keys.withColumn("seen", F.col("seen") | F.col(f"in{i}").isNotNull()).drop(f"in{i}")
        repeated = (F.col("first") < F.col("last")) | (F.col("nameless") & F.col("first").isNotNull())
        told = keys.withColumn("repeated", F.coalesce(repeated, F.lit(False)))
        told = told.select("h1", "h2", "first", "n", "seen", "repeated")
        table = self._bucketed(told, shared_folder(self.spark))
        decided = self.spark.table(table)
        batch = 1 + max([-1, *(self._parts(r)[2] for r in self.runs)])
        fresh = decided.filter("not seen").select("h1", "h2")
        self._write(fresh, f"0-{batch:06d}-{batch:06d}-{self.buckets}")
        self.spark.sql(f"drop table {table}")
        self._compact()
        known = decided.filter("seen or repeated").drop("repeated")
        total = decided.agg(F.sum("n")).first()[0] or 0
        hot = F.col("n") * HOT_PARTS >= total
        frequent = F.broadcast(known.filter(hot))
        goes = F.col("seen") | ~F.col("doc_id").eqNullSafe(F.col("first"))
        rest = lines.join(frequent.select("h1", "h2"), ["h1", "h2"], "left_anti")
        gone = lines.join(frequent, ["h1", "h2"]).filter(goes).select("doc_id", "tie", "place")
        return gone.union(
            rest.join(known.filter(~hot), ["h1", "h2"]).filter(goes).select("doc_id", "tie", "place")
        )


def drop_lines(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, text without the lines in gone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    places = gone.groupBy("doc_id", "tie").agg(F.sort_array(F.collect_set("place")).alias("places"))
    places = places.withColumnsRenamed({"doc_id": "of", "tie": "of_tie"})
    met = rows.join(places, rows.doc_id.eqNullSafe(places.of) & (rows.tie == places.of_tie), "left")
    lines = F.split("text", "\n", -1)
    n_gone = F.coalesce(F.size("places"), F.lit(0))

    def stretch(i: Column) -> Column:
        """The lines between two that go."""
        begin = F.when(i == 0, 0).otherwise(F.get("places", i - 1) + 1)
        end = F.coalesce(F.get("places", i), F.size("lines"))
        return F.slice("lines", begin + 1, end - begin)

    kept = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("places")), stretch)), "\n")
    return met.withColumn("lines", lines).select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        n_gone.cast("long").alias("n_dropped"),
        F.when(n_gone == 0, F.col("text")).otherwise(kept).alias("text"),
    )


def _bounds(docs: DataFrame, id_col: str, batches: int) -> list[float]:
    """Ids between batches of about equal size; where they lie changes no result."""
    if batches < 2 or not isinstance(docs.schema[id_col].dataType, T.NumericType):
        return []
    shares = [i / batches for i in range(1, batches)]
    ids = docs.select(F.col(id_col).cast("double").alias("id"))
    return sorted(set(ids.approxQuantile("id", shares, 0.01)))


def without_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = LEAST_LETTERS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_dropped, text (of the lines that stay).

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys of at
    least ``least`` code points that two or more documents hold stay in the document of
    the smallest id alone, there with all their lines. A null or empty text is one empty
    line. Rows of one id are one document; null ids are one document after all others.
    Texts of any length are cut by built-in functions; an empty table gives no rows.
    Other columns are not looked at. Ids that are no numbers go in one batch.
    """
    bounds = _bounds(docs, id_col, batches)
    batch = F.lit(0)
    for b in bounds:
        batch = batch + F.when(F.col("doc_id").cast("double") > b, 1).otherwise(0)
    batch = F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(batch)
    spark = docs.sparkSession
    path = shared_folder(spark)
    staged = line_hashes(docs, id_col, text_col, least).withColumn("batch", batch)
    staged.write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(staged.schema).parquet(path)
    runs = LineRuns(spark, fanout=fanout)
    gone = []
    for i in range(len(bounds) + 1):
        gone.append(keep(runs.add(lines.filter(F.col("batch") == i).drop("batch"))))
    runs.close()
    return drop_lines(docs, reduce(DataFrame.union, gone), id_col, text_col)
