"""Sessions, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Defaults for a local session; a cluster sets its own and these stay out of its way.
LOCAL = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(cores: int | str = "*", app: str = "vellum", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster spark-submit makes it."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", os.environ.get("VELLUM_DRIVER_MEMORY", "12g"))
    for key, value in {**LOCAL, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Where it is unset, a local master gets a temporary folder of its own; on a cluster that is an error,
    because executors do not see each other's disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vellum-checkpoints-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder: it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: a lineage cut for wide or compressible rows."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/vellum-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written(), once everything that reads them is written itself; others are left alone."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows that one task sorts or holds where spread() deals them.
TASK_ROWS = 300_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by its keys in partitions of some TASK_ROWS of its rows, one a core at least: these stay as many where a shuffle of well compressed
    rows would be merged into few, so that a task's memory doesn't grow with the table."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
