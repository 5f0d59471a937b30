"""Incremental ingestion of landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def landing(spark: SparkSession, folder: str, schema: StructType, kind: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(folder)


def once(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Takes in what is new since the last call, exactly once, and ends."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Keyed state on the executors' disks, in the checkpoint folder from batch to batch.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def distinct_within(stream: DataFrame, key: str, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Rows whose key has not come within `delay` before; rows that are later than that are passed over. State goes with the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def first_of_key(stream: DataFrame, key: str) -> DataFrame:
    """Rows whose key has never come before, however late: each key stays in the state, as the done list of a job that resumes."""
    return stream.dropDuplicates([key])


def resumed(source: DataFrame, key: str, out: str, checkpoint: str, ts: str | None = None, delay: str = "1 hour") -> None:
    """Takes in what has landed since the last call, each key once over all calls (or, with `ts`, once within `delay`), and ends.

    What has been read and which keys are done are the checkpoint's state, not files beside
    the data: a run that is killed between landing and output starts again where it was.
    Null is a key like any other.
    """
    spark = source.sparkSession
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        once(first_of_key(source, key) if ts is None else distinct_within(source, key, ts, delay), out, checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def windowed_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", size: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Counts and sums by window; the same plan for a stream and a table."""
    source = events.withWatermark(ts, delay) if events.isStreaming else events
    out = source.groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")
