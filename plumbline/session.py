"""Session defaults and reliable materialisation."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int | str = "*", name: str = "plumbline") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in spark.checkpoint.dir.

    Only a local master without that setting gets a temporary folder, which goes when
    Python ends: on a cluster it would be lost together with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir"
    )
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="plumbline-checkpoint-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    sc.setCheckpointDir(shared)


def materialize(df: DataFrame) -> DataFrame:
    """Compute once into reliable storage and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/written-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Compute once into a table in the shared folder and read it back.

    Costs one run, where an eager checkpoint runs its plan twice. Columns without a
    type hold nothing and come back as they were.
    """
    path = shared_folder(df.sparkSession)
    typed = [f for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]
    df.select(*[_named(f.name) for f in typed]).write.parquet(path)
    back = df.sparkSession.read.schema(T.StructType(typed)).parquet(path)
    if len(typed) == len(df.columns):
        return back
    names = {f.name for f in typed}
    return back.select(*[_named(c) if c in names else F.lit(None).alias(c) for c in df.columns])


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def remove(df: DataFrame) -> None:
    """Delete the files of a kept table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
