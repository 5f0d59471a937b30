"""Incremental, reversible line dedup: sharded cuckoo filters before exact reference counts."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from .common import few, keyed, release, remove, scratch, shared_dir, tasks_for, tidy, written
from .cuckoo import Chain
from .substring_dedup import id_ranges

_BLANKS = b" \t\n\x0b\x0c\r"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Code points of a key that is compared.
LEAST = 10
#: Buckets of one filter; four slots each, so 128 KB.
BUCKETS = 1 << 14
_KEY = ["k1", "k2"]


def key_of(line: bytes) -> bytes | None:
    """Digest of a line's key: blanks stripped at both ends, A-Z lower-cased; None where that is too short to be compared."""
    line = line.strip(_BLANKS)
    if len(line) < LEAST or len(line) < 4 * LEAST and len(line.decode()) < LEAST:
        return None
    return blake2b(line.translate(_LOWER), digest_size=16).digest()


def keys(docs: DataFrame) -> DataFrame:
    """(_id, _fp, k1, k2): each key of each row once, as a digest of 128 bits; docs as from keyed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            found, owner = [], []
            for i, text in enumerate(b.column("text").cast(pa.large_binary())):
                own = set(map(key_of, text.as_py().split(b"\n"))) if text.is_valid else set()
                own.discard(None)
                found += own
                owner += [i] * len(own)
                if len(found) >= 50_000:
                    yield _batch(b, found, owner)
                    found, owner = [], []
            yield _batch(b, found, owner)

    return R.texts(docs).mapInArrow(run, "_id long, _fp long, k1 long, k2 long")


def _batch(b: pa.RecordBatch, found: list[bytes], owner: list[int]) -> pa.RecordBatch:
    k = np.frombuffer(b"".join(found), np.int64).reshape(-1, 2)
    own = np.array(owner, np.int64)
    return pa.RecordBatch.from_arrays([b.column("_id").take(own), b.column("_fp").take(own), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=["_id", "_fp", *_KEY])


class LineIndex:
    """Which documents hold which line keys; documents come and go in any order.

    * references: exact. Rows (k1, k2, _id, n) in immutable runs, bucketed by k1; the sum of n
      over all runs is how many rows of that document hold the key. A deletion is a run of
      negative counts.
    * filters: for each of `shards` ranges of hashes a chain of cuckoo filters of all keys
      with references. A new batch's keys that they don't know, most, are new without a look
      at the references; what they know is looked up there, so their errors cost time only.
    * shared: exact. (k1, k2, first): keys that two documents or more hold, with the smallest
      id. This is what cleaning joins with.

    A manifest row, written last, names the tables of each state; open(path) takes the latest.
    Work on a batch is spread by key after each key has been reduced to one row where it was
    read, so a line that every document has costs one row a task.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = 64, buckets: int = 48, tasks: int | None = None):
        shared_dir(spark)
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        self.spark, self.path, self.shards, self.tasks = spark, path or scratch(spark, "lines"), shards, tasks
        self.buckets, self.version = min(buckets, most), 0
        self.runs: list[str] = []
        self.filters: str | None = None
        self.shared: list[str] = []
        self.tables: dict[str, str] = {}

    # ---- state on disk

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LineIndex:
        """The index as it was after the last insert or delete that ended."""
        last = spark.read.json(f"{path}/manifest").orderBy(F.desc("version")).first()
        index = cls(spark, path, last["shards"], last["buckets"])
        index.version, index.runs, index.filters, index.shared = last["version"], list(last["runs"]), last["filters"], list(last["shared"])
        return index

    def _commit(self, runs: list[str], filters: str | None, shared: list[str]) -> None:
        self.version += 1
        row = (self.version, self.shards, self.buckets, runs, filters, shared)
        kinds = "version long, shards int, buckets int, runs array<string>, filters string, shared array<string>"
        self.spark.createDataFrame([row], kinds).coalesce(1).write.mode("append").json(f"{self.path}/manifest")
        self.runs, self.filters, self.shared = runs, filters, shared

    def _new(self, kind: str) -> str:
        return scratch(self.spark, kind).rsplit("/", 1)[1]

    def _store(self, rows: DataFrame, kind: str) -> str:
        name = self._new(kind)
        with tidy(self.spark):
            few(rows, self.tasks).write.parquet(f"{self.path}/{name}")
        return name

    def _store_run(self, rows: DataFrame) -> str:
        name = self._new("run")
        table = f"gridloom_{name.replace('-', '_')}"
        with tidy(self.spark):
            few(rows.repartition(self.buckets, "k1"), self.tasks).write.bucketBy(self.buckets, "k1").sortBy("k1").option("path", f"{self.path}/{name}").saveAsTable(table)
        self.tables[name] = table
        return name

    def _run(self, name: str) -> DataFrame:
        """A run as a bucketed table, which joins by key without being moved."""
        if name not in self.tables:
            table = f"gridloom_{name.replace('-', '_')}"
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} (k1 BIGINT, k2 BIGINT, _id BIGINT, n BIGINT) USING parquet CLUSTERED BY (k1) SORTED BY (k1) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{name}'")
            self.tables[name] = table
        return self.spark.table(self.tables[name])

    def references(self) -> DataFrame:
        """(k1, k2, _id, n), written: how many rows of each document hold each key."""
        every = self.spark.createDataFrame([], "k1 long, k2 long, _id long, n long")
        for r in self.runs:
            every = every.unionByName(self._run(r))
        return written(every.groupBy(*_KEY, "_id").agg(F.sum("n").alias("n")).filter("n <> 0"), "references", self.tasks)

    def close(self, delete: bool = True) -> None:
        """Forgets the catalogue's names; `delete`: the index's files, too."""
        for table in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        self.tables = {}
        if delete:
            remove(self.spark, self.path)

    # ---- filters

    def _sharded(self, some: DataFrame) -> DataFrame:
        return some.withColumn("shard", F.pmod("k1", F.lit(self.shards)).cast("int"))

    def _chains(self) -> DataFrame:
        if self.filters is None:
            return self.spark.createDataFrame([], "shard int, filters array<binary>")
        return self.spark.read.schema("shard int, filters array<binary>").parquet(f"{self.path}/{self.filters}")

    def _known(self, some: DataFrame) -> DataFrame:
        """Those of the distinct keys that the filters know. A shard's filters and its new keys meet in one task; shards are sized so that both are small."""

        def run(new: pa.Table, old: pa.Table) -> pa.Table:
            chain = Chain(BUCKETS, old.column("filters")[0].as_py() if len(old) else None)
            return new.filter(pa.array(chain.has(new.column("k2").to_numpy().view(np.uint64)))) if len(new) else new

        with_shard = self._sharded(some)
        return with_shard.groupBy("shard").cogroup(self._chains().groupBy("shard")).applyInArrow(run, with_shard.schema).drop("shard")

    def _changed(self, some: DataFrame, adding: bool) -> DataFrame:
        """All filters with the distinct keys put in or taken out."""

        def run(new: pa.Table, old: pa.Table) -> pa.Table:
            shard = (new if len(new) else old).column("shard")[0].as_py()
            chain = Chain(BUCKETS, old.column("filters")[0].as_py() if len(old) else None)
            h = new.column("k2").to_numpy().view(np.uint64)
            (chain.add if adding else chain.remove)(h)
            return pa.table({"shard": pa.array([shard], pa.int32()), "filters": pa.array([chain.tolist()], pa.list_(pa.binary()))})

        pairs = self._sharded(some.select(*_KEY)).groupBy("shard").cogroup(self._chains().groupBy("shard"))
        return pairs.applyInArrow(run, "shard int, filters array<binary>")

    # ---- references

    def _references(self, of: DataFrame) -> DataFrame:
        """(k1, k2, _id, n) as they stand, n > 0, of the given distinct keys. Only runs' buckets that meet are read together; nothing of a run moves."""
        parts = [self._run(r).join(of.select(*_KEY), _KEY, "left_semi") for r in self.runs]
        if not parts:
            return self.spark.createDataFrame([], "k1 long, k2 long, _id long, n long")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy(*_KEY, "_id").agg(F.sum("n").alias("n")).filter("n > 0")

    def _shared(self) -> DataFrame:
        if not self.shared:
            return self.spark.createDataFrame([], "k1 long, k2 long, first long")
        return self.spark.read.schema("k1 long, k2 long, first long").parquet(*[f"{self.path}/{s}" for s in self.shared]).groupBy(*_KEY).agg(F.min("first").alias("first"))

    # ---- what a user calls

    def insert(self, docs: DataFrame) -> None:
        """Adds the rows of docs, as from keyed(). A row that is there already counts once more, and has to be deleted once more."""
        found = written(keys(docs), "found", self.tasks)
        batch = written(found.groupBy(*_KEY).agg(F.min("_id").alias("first"), F.max("_id").alias("last")), "batch", self.tasks)
        if self.runs:
            maybe = written(self._known(batch.select(*_KEY)), "maybe", self.tasks)
            held = written(self._references(maybe).groupBy(*_KEY).agg(F.min("_id").alias("least"), F.max("_id").alias("most")), "held", self.tasks)
        else:
            held = self.spark.createDataFrame([], "k1 long, k2 long, least long, most long")
        both = batch.join(held, _KEY, "left").select(*_KEY, F.least("first", "least").alias("first"), F.greatest("last", "most").alias("last"))
        shared = self._store(both.filter("first < last").drop("last"), "shared")
        filters = self._store(self._changed(batch.join(held, _KEY, "left_anti"), True), "filters")
        run = self._store_run(found.groupBy(*_KEY, "_id").agg(F.count("*").alias("n")))
        self._commit([*self.runs, run], filters, [*self.shared, shared])

    def delete(self, docs: DataFrame) -> None:
        """Takes rows out again, given as they were inserted; rows that are not there change nothing. What only they held is new again, and where they held a key first the next document does."""
        found = written(keys(docs).groupBy(*_KEY, "_id").agg(F.count("*").alias("out")), "found", self.tasks)
        meant = found.select(*_KEY).distinct()
        held = written(self._references(meant), "held", self.tasks)
        less = held.join(found, [*_KEY, "_id"], "left").withColumn("out", F.least("n", F.coalesce("out", F.lit(0))))
        less = written(less, "less", self.tasks)
        left = less.withColumn("_id", F.expr("CASE WHEN n > out THEN _id END")).groupBy(*_KEY).agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
        left = written(left, "left", self.tasks)
        filters = self._store(self._changed(left.filter("first IS NULL"), False), "filters")
        shared = self._store(self._shared().join(left, _KEY, "left_anti").unionByName(left.filter("first < last").drop("last")), "shared")
        run = self._store_run(less.filter("out > 0").select(*_KEY, "_id", (-F.col("out")).alias("n")))
        self._commit([*self.runs, run], filters, [shared])

    def compact(self) -> None:
        """Sums all runs into one."""
        if self.runs:
            run = self._store_run(self.references())
            self._commit([run], self.filters, [self._store(self._shared(), "shared")])

    def clean(self, docs: DataFrame) -> DataFrame:
        """(row, n_lines, n_dropped, kept_text) of rows that are in the index, as it stands: lines go whose key a document of a smaller id holds."""
        marks = keys(docs).join(self._shared(), _KEY).filter("first < _id").select("_id", "_fp", *_KEY)
        marks = written(marks, "marks", self.tasks)
        lists = marks.groupBy("_id", "_fp").agg(F.collect_set(F.struct(*_KEY)).alias("gone"))  # one document's own keys
        some, rest = R.parted(docs.select("_id", "_fp", "row"), marks)
        joined = some.join(lists, ["_id", "_fp"], "left").select("row", "gone")
        joined = joined.unionByName(rest.select("row", F.lit(None).cast(joined.schema["gone"].dataType).alias("gone")))
        joined = few(joined.select("row", F.col("row.text").cast("string").alias("text"), "gone"), self.tasks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            for b in batches:
                lines, dropped, kept = [], [], []
                for text, gone in zip(b.column("text").cast(pa.large_binary()), b.column("gone"), strict=True):
                    own = (text.as_py() or b"").split(b"\n")
                    out = {np.array([g["k1"], g["k2"]], np.int64).tobytes() for g in gone.as_py() or ()}
                    stay = [x for x in own if key_of(x) not in out] if out else own
                    lines.append(len(own))
                    dropped.append(len(own) - len(stay))
                    kept.append(b"\n".join(stay).decode())
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], names=["row", "n_lines", "n_dropped", "kept_text"])

        return joined.mapInArrow(run, R.result(joined, n_lines="long", n_dropped="long", kept_text="string"))


def remove_repeated_lines(docs: DataFrame, batches: int = 3) -> DataFrame:
    """Drops lines whose key, of ten code points or more, stands in a document with a smaller id.

    Documents are inserted in `batches` ranges of ids into a LineIndex, as they would arrive,
    and cleaned by it. Returns (row, n_lines, n_dropped, kept_text) for every row. Null or
    empty text is one empty line. A null id counts as larger than every other; rows of one id
    are one document and drop nothing from each other. Lines repeated inside the document
    that keeps them stay, all of them. Repeated rows have equal results, an empty table gives
    an empty one, long texts are read whole; `row` holds the input's columns, whatever their
    names. Keys are compared by 128 bits.
    """
    spark, tasks = docs.sparkSession, tasks_for(docs)
    docs = keyed(docs)
    index = LineIndex(spark, shards=4 * tasks, buckets=tasks, tasks=tasks)
    for low, high in id_ranges(docs, batches):
        index.insert(docs.filter((F.col("_id") >= low) & (F.lit(True) if high is None else F.col("_id") < high)))
    out = written(index.clean(docs), "cleaned", tasks)
    index.close()
    return out
