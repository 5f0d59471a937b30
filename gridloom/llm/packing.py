"""Packing documents into training sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, tasks_for, written
from .cutting_stock import patterns
from .tokens import WordTokens, default_path

END = (1).to_bytes(4, "little")
#: Salts of one length whose cells are summed up together.
BLOCK = 1024


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): every document's ids cut every `capacity` ids."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.at(path)
        for b in batches:
            rows = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = words.ids(text.as_py()) + END
                n = len(ids) // 4
                rows += [(i, at, min(capacity, n - at), zlib.crc32(ids[4 * at : 4 * (at + capacity)]), n) for at in range(0, n, capacity)]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, capacity: int = 2048, grain: int = 8, tokenizer: str | None = None) -> DataFrame:
    """Packs all documents into sequences of at most `capacity` tokens.

    A document is its ids and then id 1, cut every `capacity` ids. The lengths' histogram
    (at most `capacity` counts, whatever the input) goes to the driver, in classes of
    `grain` tokens; column generation gives patterns of classes and how often each is used.
    Pieces are ranked within their class, longest first, and ranks are dealt to patterns:
    the pattern table is at most a few patterns for each class. The rank is a count of the
    shorter (length, salt) cells, from a table, plus the place in the piece's own cell; cells
    are salted so that a length that a third of all pieces share is no single group.

    Returns (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). Null or
    empty text: one piece, id 1. Null ids and repeated rows are packed like any other; of
    equal pieces any may come first. A long text is encoded whole, by one task. An empty table gives an empty result. Only doc_id and
    text are read. Rounding lengths up to `grain` costs about grain / 2 tokens a piece.
    """
    tasks = tasks_for(docs)
    cut = written(pieces(docs, capacity, tokenizer), "pieces", tasks)
    salts = max(1, cut.count() // 2_000)
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    cells = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    size = F.ceil(F.col("length") / grain).cast("long")
    cells = written(cells.withColumn("size", size), "cells", tasks)
    histogram = {r["size"]: r["n"] for r in cells.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    sizes = np.array(sorted(histogram), np.int64)
    rows, times = patterns(sizes, np.array([histogram[s] for s in sizes], np.int64), capacity // grain)
    # deal[size]: for each pattern with that size its first rank, its first sequence, and how many a sequence takes
    first = np.concatenate(([0], np.cumsum(times)))[:-1]
    deal = {}
    for k, s in enumerate(sizes):
        own = np.flatnonzero(rows[:, k])
        took = rows[own, k] * times[own]
        deal[int(s)] = np.cumsum(took) - took, first[own], rows[own, k]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, rank = b.column("size").to_numpy(), b.column("rank").to_numpy()
            sequence = np.zeros(len(s), np.int64)
            for one in np.unique(s):
                at = np.flatnonzero(s == one)
                start, base, each = deal[int(one)]
                p = np.searchsorted(start, rank[at], side="right") - 1
                sequence[at] = base[p] + (rank[at] - start[p]) // each[p]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], b.column("rank"), pa.array(sequence)], names=[*b.schema.names[:5], "rank", "sequence_id"])

    # cells of one size are as many as salts: sums of BLOCK salts come first, so no task orders all of them
    upto = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("block", F.floor(F.col("salt") / BLOCK))
    blocks = cells.groupBy("size", "length", "block").agg(F.sum("n").alias("n"))
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(upto(F.desc("length"), "block").partitionBy("size")), F.lit(0))).drop("n", "size")
    inside = F.coalesce(F.sum("n").over(upto("salt").partitionBy("length", "block")), F.lit(0))
    before = cells.withColumn("inside", inside).join(blocks, ["length", "block"]).select("length", "salt", "size", (F.col("before") + F.col("inside")).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("place", place).join(before, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", (F.col("before") + F.col("place") - 1).alias("rank"))
    out = ranked.mapInArrow(dealt, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, rank long, sequence_id long")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset")
    return few(out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset), tasks)


def sequences(docs: DataFrame, packed: DataFrame, capacity: int = 2048, pad: int = 0, tokenizer: str | None = None) -> DataFrame:
    """The packed sequences themselves: (sequence_id, input_ids, doc_ids), ids and the id of the document of each, padded to `capacity` except where the length is a power of two.

    docs must have one row for each doc_id.
    """
    path = tokenizer or default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.at(path)
        for b in batches:
            for x in b.to_pylist():
                ids = np.frombuffer(words.ids(x["text"]) + END, np.uint32).astype(np.int32)
                p = x["pieces"]
                yield pa.RecordBatch.from_arrays([pa.array([y["sequence_id"] for y in p]), pa.array([y["offset"] for y in p]), pa.array([x["doc_id"]] * len(p), pa.int64()), pa.array([ids[y["start"] : y["start"] + y["length"]] for y in p], pa.list_(pa.int32()))], names=["sequence_id", "offset", "doc_id", "ids"])

    lists = packed.groupBy("doc_id").agg(F.collect_list(F.struct("sequence_id", "offset", "start", "length")).alias("pieces"))
    parts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(lists, "doc_id").mapInArrow(cut, "sequence_id long, offset long, doc_id long, ids array<int>")
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids, owners = F.flatten("p.ids"), F.flatten(F.transform("p", lambda x: F.array_repeat(x["doc_id"], F.size(x["ids"]))))
    n = F.size(ids)
    fill = F.when(F.bit_count(n) == 1, 0).otherwise(capacity - n)
    return whole.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad), fill)).alias("input_ids"), F.concat(owners, F.array_repeat(F.lit(None).cast("long"), fill)).alias("doc_ids"))
