"""A session with the settings the engine is written for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "gridloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, Arrow transfer; conf overrides, with __ for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset the warehouse, or on one machine a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_gridloom_folder", None)
    if not named:
        sc = spark.sparkContext
        alone = sc.master == "local" or sc.master.startswith("local[")
        named = f"file://{tempfile.mkdtemp(prefix='gridloom-')}" if alone else spark.conf.get("spark.sql.warehouse.dir")
        spark._gridloom_folder = named
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """df computed once, into the shared folder as a checkpoint; Spark deletes it when nothing refers to it any more, if it is told to clean checkpoints."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """(df read back from a Parquet table in the shared folder, the table's path): computed once, where a checkpoint is computed twice; dropped() deletes it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a table that no one reads any more."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


def dealt(df: DataFrame, *by: str, tasks: int | None = None) -> DataFrame:
    """df over all cores, four tasks each unless `tasks` is given: for work that a row's few bytes do not show, which the sizes of files would leave to a task or two. Rows that are equal in `by` meet."""
    n = tasks or 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n, *by)
