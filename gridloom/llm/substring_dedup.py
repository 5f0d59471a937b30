"""Substring dedup against a log-structured index of the windows seen before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats as R
from . import windows as W
from .common import LAST, few, held, keyed, remove, scratch, settings, tasks_for, tidy, written


#: Joins of runs find them dealt and sorted by hash as they lie there: nothing is shuffled or sorted again.
MERGE = {"spark__sql__legacy__bucketedTableScan__outputOrdering": "true", "spark__sql__requireAllClusterKeysForCoPartition": "false", "spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__sources__bucketing__autoBucketedScan__enabled": "false"}


def _merged(one: DataFrame, other: DataFrame) -> DataFrame:
    """The rows of two runs by one merge join; what both have becomes one row."""
    a, b = (x.select("h", "c", F.col("first").alias(f"first{k}"), F.col("last").alias(f"last{k}"), F.col("n").alias(f"n{k}")) for k, x in enumerate((one, other)))
    both = a.hint("merge").join(b, ["h", "c"], "full_outer")
    n = F.coalesce("n0", F.lit(0)) + F.coalesce("n1", F.lit(0))
    return both.select("h", "c", F.least("first0", "first1").alias("first"), F.greatest("last0", "last1").alias("last"), n.alias("n"))


class FingerprintIndex:
    """Window hashes of every document seen so far, as sorted immutable runs.

    A run is a table bucketed and sorted by hash in the shared folder, one file a bucket, so
    a merge join with another run moves and sorts nothing. Each batch of documents becomes a new run that is joined with
    the older ones; a run at most `ratio` times as large as what came after it is then merged
    with it, which keeps the number of runs logarithmic. A run holds, for each distinct
    stretch of windows, the smallest id that has it: (h, c, first, last, n), n its places.

    Batches come in order of doc_id: ids in a batch are no smaller than in those before.
    """

    def __init__(self, spark: SparkSession, width: int = 50, gram: int = 12, buckets: int = 48, tasks: int | None = None, ratio: float = 2.0, together: int = R.TOGETHER):
        self.spark, self.unit = spark, R.Unit(width, gram, True)
        most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))  # Spark makes no table of more
        self.buckets, self.tasks, self.ratio, self.together = min(buckets, most), tasks, ratio, together
        self.runs: list[tuple[str, int]] = []
        self.paths: dict[str, str] = {}

    def _store(self, rows: DataFrame, dealt: bool = False) -> tuple[str, int]:
        """A new run; `dealt`: its rows lie in its buckets already."""
        path = scratch(self.spark, "run")
        name = f"gridloom_{path.rsplit('-', 1)[1]}"
        self.paths[name] = path
        with tidy(self.spark):
            few(rows if dealt else rows.repartition(self.buckets, "h"), self.tasks).write.bucketBy(self.buckets, "h").sortBy("h", "c").option("path", path).saveAsTable(name)
        return name, self.spark.table(name).count()

    def compact(self) -> None:
        """Merges the newest runs while the one before them is not much larger."""
        while len(self.runs) > 1 and self.runs[-2][1] <= self.ratio * self.runs[-1][1]:
            (a, _), (b, _) = self.runs[-2:]
            with settings(self.spark, **MERGE):
                self.runs[-2:] = [self._store(_merged(self.spark.table(a), self.spark.table(b)), dealt=True)]
            for name in (a, b):
                self._drop(name)

    def _drop(self, name: str) -> None:
        """What a batch found is written by then, so no one reads the run any more."""
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drops the index; what its batches gave stays."""
        for name, _ in self.runs:
            self._drop(name)
        self.runs = []

    def known(self, new: str) -> DataFrame:
        """What the index has, older runs and the newest, of the hashes in the newest."""
        fresh = self.spark.table(new)
        out = fresh
        for old, _ in self.runs:
            out = _merged(out, self.spark.table(old).hint("merge").join(fresh.select("h"), "h", "left_semi"))
        return out

    def ingest(self, batch: DataFrame, seen: DataFrame) -> DataFrame:
        """Spans (in words) of the batch that repeat windows of documents with smaller ids.

        batch: new documents, keyed(); seen: all documents up to and including them, in
        which candidate windows are verified.
        """
        unit, tasks = self.unit, self.tasks
        with held(self.spark) as keep:
            found = keep(R.records(batch, unit), tasks)
            new, size = self._store(found.groupBy("h", "c").agg(F.min(F.struct("_id", "_fp", "place")).alias("first"), F.max("_id").alias("last"), F.sum("times").alias("n")))
            with settings(self.spark, **MERGE):
                known = keep(self.known(new), tasks)
            anchors = known.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1")
            # a run that a smaller id has goes whole; at further places in documents of the first id, and where it
            # follows upon itself, what holds for the place that is compared holds too
            marks = known.join(anchors, "h", "left").select("h", "c", F.col("first").alias("of"), F.expr("first._id < last").alias("full"), F.expr("n > 1 AND m IS NOT NULL").alias("several"))
            placed = found.join(marks.filter("full OR several"), ["h", "c"]).withColumn("whole", F.expr("full AND of._id < _id"))
            placed = placed.filter("whole OR (several AND of._id >= _id AND (times > 1 OR NOT (of._fp = _fp AND of.place = place)))")
            placed = keep(placed.select("_id", "_fp", "place", "times", "of", "whole"), tasks)
            wanted = known.join(anchors, "h").select("h", "m", "first.*")
            windows = keep(R.fetched(seen, keep(wanted, tasks), unit), tasks)
            partly = written(R.resolved(windows, unit, True, self.together, tasks), "partly", tasks)
            spans = R.run_spans(placed.filter("whole"), unit.width).unionByName(R.carried(partly, placed.filter("NOT whole")))
            spans = written(spans, "spans", tasks).unionByName(partly.drop("place"))
        self.runs.append((new, size))
        self.compact()
        return spans


def id_ranges(docs: DataFrame, batches: int) -> list[tuple[int, int]]:
    """Ranges of _id with about equal numbers of rows, in order: [low, high)."""
    cuts = docs.agg(F.percentile_approx("_id", F.array(*[F.lit(k / batches) for k in range(1, batches)]), 10_000)).first()[0] if batches > 1 else []
    edges = [-LAST - 1, *sorted({int(c) + 1 for c in cuts or [] if c < LAST}), None]
    return list(zip(edges[:-1], edges[1:], strict=True))


def remove_repeated_words(docs: DataFrame, width: int = 50, batches: int = 3, index: FingerprintIndex | None = None, together: int = R.TOGETHER) -> DataFrame:
    """Removes each word that a window of `width` words covers which also starts in a document with a smaller id.

    Documents are ingested in `batches` ranges of ids, one after the other, into a
    FingerprintIndex; windows are judged on the input, not on what is left.

    Returns (row, n_words, spans: array of start and end in words, kept_text: the words left,
    joined by one space) for every row. Null text: no words. Texts of fewer than `width`
    words keep all. A null id counts as larger than every other. Rows with equal ids never
    remove from each other. An empty table gives an empty result. Long texts are read whole,
    in overlapping stretches. `row` holds the input's columns, whatever their names. Words are compared by 128 bits: two digests of a run's anchor and
    of its whole content, or of runs that share the anchor only two digests of each window.
    """
    spark, tasks = docs.sparkSession, tasks_for(docs)
    docs = keyed(docs)
    own = index is None
    index = FingerprintIndex(spark, width, buckets=tasks, tasks=tasks, together=together) if own else index
    spans = None
    for low, high in id_ranges(docs, batches):
        seen = docs if high is None else docs.filter(F.col("_id") < high)
        part = index.ingest(seen.filter(F.col("_id") >= low), seen)
        spans = part if spans is None else spans.unionByName(part)
    if own:
        index.close()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for x in batches for p in W.portions(x)):
            data, offsets = W.utf8(b.column("text"))
            start, end, _, bounds = W.words(data, offsets)
            gone = R.covered(b, bounds)
            edges = np.zeros(len(gone) + 1, bool)
            edges[1:-1] = gone[1:] != gone[:-1]
            edges[bounds] = True
            stops = np.flatnonzero(edges)
            first = stops[:-1][gone[stops[:-1]]] if len(gone) else np.zeros(0, np.int64)
            last = stops[np.searchsorted(stops, first, side="right")] if len(first) else first
            doc = np.searchsorted(bounds, first, side="right") - 1
            spans = pa.StructArray.from_arrays([pa.array(first - bounds[doc]), pa.array(last - bounds[doc])], names=["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(b) + 1)).astype(np.int32)), spans)
            stay = np.flatnonzero(~gone)
            owner = np.searchsorted(bounds, stay, side="right") - 1
            size = end[stay] - start[stay] + np.concatenate((owner[1:] == owner[:-1], [False]))[: len(stay)]
            to = np.cumsum(size)
            source = np.arange(to[-1] if len(to) else 0) + np.repeat(start[stay] - (to - size), size)
            text = np.concatenate((data, [np.uint8(32)]))[np.minimum(source, len(data))]
            joint = to[:-1][owner[1:] == owner[:-1]] - 1 if len(to) else np.zeros(0, np.int64)
            text[joint] = 32
            at = np.concatenate(([0], to))[np.searchsorted(stay, bounds)]
            kept = pa.Array.from_buffers(pa.string(), len(b), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(text.astype(np.uint8).tobytes())])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.diff(bounds)), lists, kept], names=["row", "n_words", "spans", "kept_text"])

    joined = R.with_spans(docs, spans)
    return few(joined, tasks).mapInArrow(cut, R.result(joined, n_words="long", spans="array<struct<start:long,end:long>>", kept_text="string"))
