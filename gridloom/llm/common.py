"""What the corpus operators share: scratch tables in the shared folder, row keys, words."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager, suppress

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark takes a union of bucketed tables as bucketed also where it then reads them plainly, and leaves out the shuffle that a sum over it needs.
_UNION = "spark.sql.unionOutputPartitioning"
#: Characters of a job's plan that the driver keeps as text, each time the plan changes and until the application ends.
_PLAN = "spark.sql.maxPlanStringLength"
PLAN_TEXT = 4096
#: Until the rows of a held table are there, Spark reckons its size as the product of what it joins, and so adds Bloom filters of megabytes, which the driver serializes with every stage.
_BLOOM = "spark.sql.optimizer.runtime.bloomFilter.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset the
    warehouse, or on one machine a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_gridloom_dir", None)
    if not named:
        one = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        named = tempfile.mkdtemp(prefix="gridloom-") if one else spark.conf.get("spark.sql.warehouse.dir")
        named = f"file://{named}" if one else named
        spark._gridloom_dir = named
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no one reads any more."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the jobs inside, restored afterwards; double underscores stand for dots."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the jobs inside go when each job ends; their results are in tables by then. Unions inside are shuffled before sums. Of plans the driver keeps a short text."""
    with settings(spark, **{_CLEANUP: "true", _UNION: "false", _PLAN: str(PLAN_TEXT)}):
        yield


#: Rows that go to a Python worker at once. Texts can be long: the usual 10,000 of them fill a worker's memory, and the executor's buffers with it.
BATCH_ROWS = 1_000


def small_batches(df: DataFrame) -> DataFrame:
    """Lowers the session's Arrow batch size to BATCH_ROWS, also for the jobs that later read this result."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


#: Functions that empty the caches of this worker's modules.
CACHES: list[Callable[[], None]] = []


def release() -> None:
    """Workers serve one step after another: a step with its own needs lets go of what an earlier one remembered."""
    for empty in CACHES:
        empty()
    with suppress(OSError, AttributeError):  # give the pages back, where the C library can
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes of the documents' files for each task that writes a table.
TASK_BYTES = 8 << 20


def tasks_for(docs: DataFrame) -> int:
    """Tasks that suffice for what is made of docs: one for TASK_BYTES of their files, and two for each core."""
    small_batches(docs)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 50:  # not known
        return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def few(df: DataFrame, tasks: int | None) -> DataFrame:
    """Writing costs a few file operations a task, so small inputs are written by few tasks however finely they are dealt."""
    return df if tasks is None else df.coalesce(tasks)


def written(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """The rows as a table in the shared folder, read back: lineage is cut, and a lost executor costs nothing."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with tidy(spark):
        few(df, tasks).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(spark: SparkSession):
    """Gives a function that keeps a table's rows on the executors' disks until the block ends.

    For tables that several jobs of one step read; a lost executor's part is computed again.
    What outlives the step is written(). Joins inside get no Bloom filters.
    """
    rows: list[DataFrame] = []

    def keep(df: DataFrame, tasks: int | None = None) -> DataFrame:
        rows.append(few(df, tasks).persist(StorageLevel.DISK_ONLY))
        return rows[-1]

    try:
        with settings(spark, **{_BLOOM: "false"}):
            yield keep
    finally:
        for df in rows:
            df.unpersist()


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row: the whole input row; _id: its id, null as the largest; _fp: hash of its text.

    Rows are told apart by (_id, _fp): repeated rows share a key and get equal results.
    """
    small_batches(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text_col = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(row.alias("row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("_id"), F.xxhash64(text_col).alias("_fp"))


def words(text: Column) -> Column:
    """Words of a text in order; null or blank: none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
