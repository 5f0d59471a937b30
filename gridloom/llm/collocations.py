"""Frequent phrases and their collocation scores: merged count-min sketches, then exact counts of what they let through."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .common import release, small_batches, tasks_for, written

U = np.uint64
#: Rows of a sketch. Few and wide: at ten to twenty times as many phrases as a row can hold apart, two wide rows beat four narrow ones.
DEPTH = 2
#: Bytes of documents' files for each cell of a row, and the bounds of a row's cells (powers of two). The merged sketch, which goes to every task, has DEPTH * MOST bytes at most.
FILE_BYTES, FEWEST, MOST = 16, 1 << 18, 1 << 26
#: Cells in a block, the unit in which sketches are merged.
BLOCK = 1 << 16
#: Bytes of text that are counted at once.
PORTION = 8 << 20
_KIND = np.zeros(256, np.uint8)
_KIND[[32, 9]] = 1
_KIND[[*b".,;:!?", 10, 11, 12, 13]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Texts and languages in tables of about PORTION bytes, or one row."""
    held, size = [], 0
    for b in (p for x in batches for p in W.portions(x, limit=PORTION)):
        held.append(b)
        size += b.nbytes
        if size >= PORTION:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


class Phrases:
    """The distinct phrases of a portion and how often each occurs, one length after the other.

    Words are numbered by an Arrow dictionary and phrases by pairs of numbers, so they are
    told apart exactly. A word's number carries its document's language.
    """

    def __init__(self, table: pa.Table):
        data, offsets = W.utf8(table.column("text"))
        data = _LOWER[data]
        kind = _KIND[data]
        solid = kind == 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        start = np.flatnonzero(solid & (edge[:-1] | np.concatenate(([True], ~solid[:-1]))))
        end = np.flatnonzero(solid & (edge[1:] | np.concatenate((~solid[1:], [True])))) + 1
        piece = np.cumsum(kind == 2)[start] if len(start) else start
        doc = np.searchsorted(offsets, start, side="right") - 1
        sizes = np.concatenate(([0], np.cumsum(end - start)))
        words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(data[solid])]).dictionary_encode()
        langs = pc.fill_null(table.column("lang").cast(pa.string()), "und").combine_chunks()
        langs = (langs.chunk(0) if isinstance(langs, pa.ChunkedArray) else langs).dictionary_encode()
        self.langs, self.words = langs.dictionary, words.dictionary.cast(pa.string())
        self.n_words = len(self.words)
        self.of_doc = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = self.of_doc[doc]
        self.follows = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])  # the word after this one is of the same piece
        h = W.word_hashes(*W.utf8(self.words))
        salt = W.word_hashes(*W.utf8(self.langs))
        #: of every level: for each phrase (place in the portion's own list) its last word, the phrase before that word, hash and count
        self.hash = W.mix(h[None, :] + W.mix(salt * U(3))[:, None]).ravel()
        self.plain = h
        number = self.lang * self.n_words + self.word
        self.count = np.bincount(number, minlength=len(self.hash))
        self.at = np.arange(len(number))
        self.number = number
        self.parts = [np.arange(len(self.hash)) % max(1, self.n_words)]
        self.lang_of = np.arange(len(self.hash)) // max(1, self.n_words)
        self.length = 1

    def keep(self, known: np.ndarray) -> None:
        """Only places of phrases for which this holds are extended."""
        on = known[self.number]
        self.at, self.number = self.at[on], self.number[on]

    def extend(self) -> None:
        """To phrases of one word more: those whose beginning and whose end were kept."""
        k = self.length
        began = np.zeros(len(self.word) + 1, bool)
        began[self.at] = True
        last = self.at + k
        ok = last < len(self.word)
        ok[ok] = began[self.at[ok] + 1] & self.follows[last[ok] - 1]
        at, before = self.at[ok], self.number[ok]
        key = before * self.n_words + self.word[at + k]
        unique, number, count = np.unique(key, return_inverse=True, return_counts=True)
        head, word = unique // max(1, self.n_words), unique % max(1, self.n_words)
        self.parts = [p[head] for p in self.parts] + [word]
        self.lang_of = self.lang_of[head]
        self.hash = W.mix(self.hash[head] * U(0x9E3779B97F4A7C15) + self.plain[word])
        self.count, self.at, self.number, self.length = count, at, number, k + 1

    def rows(self, chosen: np.ndarray) -> pa.RecordBatch:
        phrase = self.words.take(self.parts[0][chosen])
        for p in self.parts[1:]:
            phrase = pc.binary_join_element_wise(phrase, self.words.take(p[chosen]), " ")
        columns = [self.langs.take(self.lang_of[chosen]), pa.array(np.full(len(chosen), self.length, np.int32)), phrase, pa.array(self.count[chosen].astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "size", "phrase", "n"])

    def lang_rows(self) -> pa.RecordBatch:
        n = np.bincount(self.lang, minlength=len(self.langs))
        return pa.RecordBatch.from_arrays([self.langs, pa.array(np.zeros(len(n), np.int32)), pa.array([""] * len(n), pa.string()), pa.array(n.astype(np.int64))], names=["lang", "size", "phrase", "n"])


def cells(h: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each hash its cell in each row of a sketch."""
    mask = U(width - 1)
    return [(h & mask).astype(np.int64), ((h >> U(32)) & mask).astype(np.int64)]


def sketch(docs: DataFrame, width: int, enough: int, longest: int) -> np.ndarray:
    """Counts of all phrases of up to `longest` words, never too small, cut off at `enough`: DEPTH rows of `width` bytes.

    Each task counts into a sketch of its own; the tasks, as many as cores, send it in
    blocks, which are added up as they arrive, one block in memory for each number.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        own = np.zeros((DEPTH, width), np.uint16)
        for table in portions(batches):
            found = Phrases(table)
            for k in range(longest):
                if k:
                    found.extend()
                n = np.minimum(found.count, enough).astype(np.uint16)
                for row, at in zip(own, cells(found.hash, width), strict=True):
                    np.add.at(row, at, n)
                    row[at] = np.minimum(row[at], enough)  # so no cell grows beyond its type
        flat = own.astype(np.uint8).reshape(-1, min(BLOCK, width))
        for i in np.flatnonzero(flat.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([flat[i].tobytes()], pa.binary())], names=["block", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("block").to_pylist(), b.column("cells"), strict=True):
                x = np.frombuffer(x.as_buffer(), np.uint8)
                sums[i] = np.minimum(sums[i].astype(np.uint16) + x, enough).astype(np.uint8) if i in sums else x.copy()
        for i, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["block", "cells"])

    shape = "block int, cells binary"
    each = docs.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(count, shape)
    merged = written(each.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").mapInArrow(add, shape), "sketch")
    out = np.zeros((DEPTH * width // min(BLOCK, width), min(BLOCK, width)), np.uint8)
    for r in merged.toLocalIterator():
        out[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(DEPTH, width)


def frequent(docs: DataFrame, enough: int, longest: int, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, n) of every phrase that occurs `enough` times or more, exactly, and (lang, n) of all words.

    A phrase is only counted where the sketch lets through itself, its beginning and its
    end: whatever is frequent passes, since each of these counts is no smaller than its own.
    """
    if not 0 < enough < 256:
        raise ValueError("a sketch's cells count to 255")
    spark = docs.sparkSession
    if width is None:
        size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        width = min(MOST, max(FEWEST, 1 << max(0, (size // FILE_BYTES) - 1).bit_length()))
    tasks = tasks_for(docs)
    docs = small_batches(docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    table = spark.sparkContext.broadcast(sketch(docs, width, enough, longest))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        limits = table.value
        for portion in portions(batches):
            found = Phrases(portion)
            yield found.lang_rows()
            for k in range(longest):
                if k:
                    found.extend()
                known = found.count > 0
                for row, at in zip(limits, cells(found.hash, width), strict=True):
                    known &= row[at] >= enough
                found.keep(known)
                chosen = np.flatnonzero(known)
                for i in range(0, len(chosen), 50_000):
                    yield found.rows(chosen[i : i + 50_000])

    counted = docs.mapInArrow(count, "lang string, size int, phrase string, n long").groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    counted = written(counted.filter(f"size = 0 OR n >= {enough}"), "phrases", tasks)
    table.destroy()
    return counted.filter("size > 0"), counted.filter("size = 0").select("lang", "n")


def collocations(docs: DataFrame, enough: int = 10, share: int = 50, top: int = 2000, longest: int = 3, width: int | None = None) -> DataFrame:
    """Of each language the `top` best collocations: (lang, rank, phrase, a, l, r, n, score).

    Words are runs of anything but blanks within pieces that `[.,;:!?]` and line ends cut; A-Z
    is lower-cased, a missing language is `und`. Candidates are phrases of 2 to `longest`
    words that occur a >= `enough` times. Cut after its first k words, a phrase of parts with
    counts l and r scores floor(1000000 * a * a / (l * r)), by decimals of 38 digits; its
    worst cut counts, of equal ones the first. A candidate goes if a longer one that has its
    words in a row occurs at least `share` percent as often. Order: score, a, then the
    phrase's bytes.

    Null and empty texts have no words; a text of any length is counted whole, repeated rows
    count each, other columns are not read, an empty table gives an empty result.
    """
    phrases, words = frequent(docs, enough, longest, width)
    parts = phrases.select(F.col("lang").alias("pl"), F.col("phrase").alias("part"), F.col("n").alias("pn"))
    listed = phrases.filter("size > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
    cuts = listed.withColumn("k", F.explode(F.expr("sequence(1, size - 1)"))).select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("first"), F.expr("array_join(slice(w, k + 1, size - k), ' ')").alias("rest"))
    cuts = cuts.join(parts, F.expr("pl = lang AND part = first")).select("lang", "phrase", "a", "k", "rest", F.col("pn").alias("l"))
    cuts = cuts.join(parts, F.expr("pl = lang AND part = rest")).select("lang", "phrase", "a", "k", "l", F.col("pn").alias("r"))
    wide = lambda c: f"CAST({c} AS DECIMAL(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"CAST((CAST(1000000 AS DECIMAL(7, 0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')}) AS BIGINT)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = listed.filter("size > 2").select("lang", F.col("a").alias("longer"), "size", "w")
    inner = inner.withColumn("m", F.explode(F.expr("sequence(2, size - 1)"))).withColumn("s", F.explode(F.expr("sequence(1, size - m + 1)")))
    inner = inner.select("lang", F.expr("array_join(slice(w, s, m), ' ')").alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").filter(f"longer IS NULL OR {wide('longer')} * 100 < {wide('a')} * {share}")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = kept.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(F.broadcast(words), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
