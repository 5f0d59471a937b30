"""Readers: every source with a declared schema, never an inferred one."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import one_line_base64
from ..schemas import PROBLEM

#: The character sets of Spark's CSV reader.
SPARK_ENCODINGS = {"iso-8859-1", "us-ascii", "utf-8", "utf-16", "utf-16be", "utf-16le", "utf-32"}
CORRUPT = "_corrupt_record"


def json_lines(spark: SparkSession, path: str | list[str], schema: StructType, skip_bad: bool = False) -> DataFrame:
    """One object a line. Bad lines are an error unless they are skipped."""
    if not skip_bad:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    wide = StructType([*schema.fields]).add(CORRUPT, "string")
    parsed = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    rows = spark.read.text(path).filter(F.trim("value") != "").select(parsed.alias("r"))
    return rows.filter(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def json_files(spark: SparkSession, folder: str, schema: StructType, most: int | None = None, pattern: str = "*.jsonl") -> DataFrame:
    """All files of a folder in name order, the first `most` of them; adds file_name and file_ordinal.

    Names are compared in a small table of names only; the rows are joined to it.
    """
    rows = spark.read.schema(schema).option("pathGlobFilter", pattern).json(folder).withColumn("file_name", F.col("_metadata.file_name"))
    names = listing(spark, folder, pattern).select(F.regexp_extract("path", r"([^/]+)\z", 1).alias("file_name"))
    ranked = names.orderBy("file_name") if most is None else names.orderBy("file_name").limit(most)
    ordinal = F.rank().over(Window.orderBy("file_name")) - 1  # one row a file
    return rows.join(ranked.withColumn("file_ordinal", ordinal), "file_name")


def tasks(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """One JSON document a file, folders included; adds uid (file stem) and concept (its folder)."""
    body = StructType([f for f in schema.fields if f.name != "uid"])
    rows = spark.read.schema(body).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(path, r"([^/]+)\.json\z", 1).alias("uid"), F.regexp_extract(path, r"([^/]+)/[^/]+\z", 1).alias("concept"), "*")


def seeds(spark: SparkSession, folder: str) -> DataFrame:
    """Seed programs by their file names: (seed_id, uid, content)."""
    rows = spark.read.option("pathGlobFilter", "*.py").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("content"))
    uid = F.regexp_extract("file", r"\A([0-9a-f]{8})(?:_[a-zA-Z]+)?\.py\z", 1)
    return rows.filter(uid != "").select(F.regexp_replace("file", r"\.py\z", "").alias("seed_id"), uid.alias("uid"), "content")


def csv(spark: SparkSession, path: str, schema: StructType | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A header, quoted cells with new lines and doubled quotes; without a schema all columns are text. Encodings that Spark's reader does not know are decoded file by file."""
    if encoding.lower() not in SPARK_ENCODINGS:
        return _decoded_csv(spark, path, schema, encoding)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').option("encoding", encoding)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", False).csv(path)


def _decoded_csv(spark: SparkSession, path: str, schema: StructType | None, encoding: str) -> DataFrame:
    import csv as lines
    import io

    import pandas as pd

    files = spark.read.format("binaryFile").load(path).select("content")
    if schema is None:
        header = next(lines.reader(io.StringIO(files.first()[0].decode(encoding))))
        names = [h.strip() for h in header]
    else:
        names = schema.fieldNames()

    def rows(batches):
        for b in batches:
            for content in b["content"]:
                table = list(lines.DictReader(io.StringIO(content.decode(encoding), newline="")))
                yield pd.DataFrame({n: pd.Series([r.get(n) or None for r in table], dtype=object) for n in names})

    out = files.mapInPandas(rows, StructType([StructField(n, StringType()) for n in names]))
    return out if schema is None else out.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def probe_encoding(sample: bytes, encodings: Iterable[str] = ("utf-8", "cp949", "euc-kr", "iso-8859-1", "latin1")) -> str:
    """The first encoding that decodes the bytes."""
    for e in encodings:
        try:
            sample.decode(e)
            return e
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")


def selectors(spark: SparkSession, path: str, most: int = -1) -> DataFrame:
    """Comma-separated ids in files: (ordinal, id), empty ones left out; the first `most` where it is not negative."""
    lines = spark.read.text(path, wholetext=True)
    ids = F.filter(F.transform(F.split("value", r"[,\n]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    out = lines.select(F.posexplode(ids).alias("ordinal", "id"))
    return out if most < 0 else out.filter(F.col("ordinal") < most)


def media(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, base64) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length", one_line_base64(F.col("content")).alias("base64"))


def listing(spark: SparkSession, folder: str, pattern: str = "*", limit: int | None = None) -> DataFrame:
    """(path, length, empty, too_large) of a folder's files, from the file system's own listing: a scan would pass over empty files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    files = [(f.getPath().toString(), f.getLen()) for f in found if f.isFile()]
    rows = spark.createDataFrame(files, "path string, length long")
    return rows.select("path", "length", (F.col("length") == 0).alias("empty"), (F.col("length") > F.lit(limit if limit is not None else 2**62)).alias("too_large"))


def dataset(spark: SparkSession, name: str, split: str = "train") -> DataFrame:
    """A table by name, else a Parquet folder of the split, else an error."""
    if re.fullmatch(r"\w+(\.\w+){0,2}", name) and spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.read.parquet(f"{name}/{split}")


def media_ids(spark: SparkSession, path: str) -> DataFrame:
    """(uuid) of media named in log lines."""
    uid = F.regexp_extract("value", r"/(?:[^/\s]*?)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.gif", 1)
    return spark.read.text(path).select(uid.alias("uuid")).filter("uuid <> ''")


def problem_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROBLEM).parquet(path)
