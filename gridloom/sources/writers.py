"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import batch_of
from ..schemas import PROBLEM


def json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line, nulls kept."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, so that a CSV can hold them."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])


def ledger(df: DataFrame, path: str) -> None:
    """Appended Parquet: writers commit whole files, so none waits for another."""
    df.write.mode("append").parquet(path)


def csv(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of CSV files, each with its header; appended files are read as one table with the others."""
    flat(df).write.mode("append" if append else "overwrite").option("header", True).option("escape", '"').csv(path)


def named_files(spark: SparkSession, files: dict[str, bytes], folder: str) -> None:
    """A few files under names of their own, written by the driver through the file system of the folder."""
    jvm = spark._jvm
    for name, data in files.items():
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()


def page(spark: SparkSession, sections: DataFrame, path: str, title: str, order: str = "uid", section: str = "html") -> None:
    """An HTML page of sections in order. For reports that are read: sections go through the driver one after the other."""
    jvm = spark._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    try:
        out.write(bytearray(f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{title}</title></head><body>\n".encode()))
        for r in sections.orderBy(order).select(section).toLocalIterator():
            out.write(bytearray((r[0] + "\n").encode()))
        out.write(bytearray(b"</body></html>\n"))
    finally:
        out.close()


def problem_cache(df: DataFrame, path: str) -> None:
    """Problems as Parquet, for readers.problem_cache()."""
    df.select(*[f.name for f in PROBLEM.fields]).write.mode("overwrite").parquet(path)


def splits(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def id_batches(df: DataFrame, path: str, column: str, size: int) -> None:
    """One folder for each batch of `size` ids, with `id,` lines."""
    out = batch_of(df.select(column).distinct(), size, column)
    out.select(F.concat(F.col(column).cast("string"), F.lit(",")).alias("value"), "batch").write.mode("overwrite").partitionBy("batch").text(path)
