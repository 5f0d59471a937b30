"""Spark side of the repeated-window search that both substring dedup operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import windows as W
from .common import release, written

RECORD = "h long, c long, _id long, _fp long, place long, times long"
#: Runs of one anchor that one task compares in memory; larger groups go through a shuffle of single windows.
TOGETHER = 4096


@dataclass(frozen=True)
class Unit:
    """What a window is made of: `width` tokens, anchored by grams of `gram` tokens."""

    width: int
    gram: int
    words: bool

    def tokens(self, column) -> tuple[Callable[[int, int], np.ndarray], np.ndarray]:
        data, offsets = W.utf8(column)
        if not self.words:
            return lambda a, b: data[a:b], offsets
        _, _, hashes, bounds = W.words(data, offsets)
        return lambda a, b: hashes[a:b], bounds


def long(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select("_id", "_fp", F.col("row.text").cast("string").alias("text"), *more)


def records(docs: DataFrame, unit: Unit) -> DataFrame:
    """The anchor records of every document; docs as from keyed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (p for x in batches for p in W.portions(x)):
            doc, h, c, place, times = W.records(*unit.tokens(b.column("text")), unit.width, unit.gram)
            columns = h, c, long(b, "_id")[doc], long(b, "_fp")[doc], place, times
            for at in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in columns], names=["h", "c", "_id", "_fp", "place", "times"])

    return texts(docs).mapInArrow(run, RECORD)


#: Bits of the set that tells, nearly, which documents are meant; it is as large for any number of them.
BITS = 1 << 23


def parted(docs: DataFrame, keys: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """(docs that may have one of the keys (_id, _fp; or `by`), docs that surely have none), by a set of BITS bits of the keys' hashes, which goes to every task; so of the others no text moves."""
    spot = F.pmod(F.xxhash64(*by or ("_id", "_fp")), F.lit(BITS))
    one = keys.select(spot.alias("s")).select(F.shiftright("s", 6).alias("_w"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(63).cast("int")).alias("_b"))
    words = one.groupBy("_w").agg(F.bit_or("_b").alias("_b"))  # BITS / 64 rows at most
    marked = docs.withColumn("_s", spot).join(F.broadcast(words), F.shiftright("_s", 6) == F.col("_w"), "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col("_b"), F.col("_s").bitwiseAND(63).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return marked.filter(hit).drop("_s", "_w", "_b"), marked.filter(~hit).drop("_s", "_w", "_b")


def fetched(docs: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """wanted: (h, m, _id, _fp, place), distinct runs. Adds the content of each, read again from its document: its bytes, or for words two digests of each window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in (p for x in batches for p in W.portions(x)):
            tokens, bounds = unit.tokens(b.column("text"))
            lists = b.column("runs")
            each = np.diff(lists.offsets.to_numpy())
            doc = np.repeat(np.arange(len(b)), each)
            runs = lists.flatten()
            h, m, place = (runs.field(n).to_numpy(zero_copy_only=False) for n in ("h", "m", "place"))
            start, count = W.unpack(place)
            start = start + bounds[doc]
            order = np.argsort(start, kind="stable")
            at = 0
            while at < len(order):  # runs that lie near each other share one set of prefix sums
                low = int(start[order[at]])
                to = max(at + 1, int(np.searchsorted(start[order], low + W.STRETCH)))
                own = order[at:to]
                t = tokens(low, int((start[own] + count[own]).max()) + unit.width - 1)
                if unit.words:
                    size = count[own]
                    of = _ramp(start[own] - low, size)
                    content = np.stack([W.Digests(t, k).all(unit.width)[of] for k in (2, 3)], axis=1).tobytes()
                    step = 16
                else:
                    size = count[own] + unit.width - 1
                    content = W.utf8(b.column("text"))[0][low:][_ramp(start[own] - low, size)].tobytes()
                    step = 1
                offsets = np.concatenate(([0], np.cumsum(size))) * step
                blobs = pa.Array.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(content)]).cast(pa.binary())
                keys = [pa.array(x[own]) for x in (h, m, long(b, "_id")[doc], long(b, "_fp")[doc], place)]
                for i in range(0, len(own), 5_000):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 5_000) for x in [*keys, blobs]], names=["h", "m", "_id", "_fp", "place", "content"])
                at = to

    lists = wanted.groupBy("_id", "_fp").agg(F.collect_list(F.struct("h", "m", "place")).alias("runs"))
    return texts(parted(docs, wanted)[0]).join(lists, ["_id", "_fp"]).select("_id", "_fp", "text", "runs").mapInArrow(run, "h long, m long, _id long, _fp long, place long, content binary")


def _ramp(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


def group_ids(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows by keys, and the number of each sorted row's group."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)


def radix(group: np.ndarray, digits: Iterator[Callable[[np.ndarray], np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Windows in groups of two or more equal ones, by one pass for each digit, the most significant first; what is alone after a pass is done with. A digit gives its value for the windows that are left. Returns (places of the windows, their group numbers)."""
    left = np.arange(len(group))
    for digit in digits:
        order, number = group_ids([group, digit(left)])
        again = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
        left, group = left[order][again], number[again]
    return left, group


def digits_of(unit: Unit, column, count: np.ndarray) -> Iterator[Callable[[np.ndarray], np.ndarray]]:
    """The digits of every window of every run: eight bytes each, in order; of words the two digests."""
    data, offsets = W.utf8(column)
    if unit.words:
        both = np.frombuffer(data.tobytes(), np.uint64).reshape(-1, 2)
        return (lambda left, k=k: both[left, k] for k in (0, 1))
    number, of = W.loads(data), _ramp(offsets[:-1], count)
    last = unit.width - 8
    return (lambda left, k=k: number[of[left] + min(k, last)].byteswap() for k in range(0, unit.width, 8))


def spans_of(windows: np.ndarray, run: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the maximal stretches of consecutive windows; windows: starts, in order within each run."""
    cut = np.flatnonzero((np.diff(windows) != 1) | (np.diff(run) != 0)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut - 1, [len(windows) - 1]))
    return run[first], windows[first], windows[last] + width


JUDGED = "_id long, _fp long, place long, start long, end long, d long, e long, open boolean"


def resolved(found: DataFrame, unit: Unit, earlier: bool, together: int = TOGETHER, tasks: int | None = None) -> DataFrame:
    """Spans of the windows in `found` that another run shares, each with its run's place; earlier: only with one in a document of smaller id.

    found: (h, m, _id, _fp, place, content), m the number of runs with that anchor. Groups of
    up to `together` runs are compared in one task; larger ones are dealt into blocks. What a
    block settles by itself is done. Of the rest every window, and one of each set of equal
    ones that the block found, is then a row, and rows of two equal digests meet with partial
    counts.
    """

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        g, m, ids, fps, place = (rows.column(n).to_numpy() for n in ("g", "m", "_id", "_fp", "place"))
        start, count = W.unpack(place)
        run, at = np.repeat(np.arange(len(g)), count), _ramp(start, count)
        which, group = radix(g[run], digits_of(unit, rows.column("content"), count))
        done = np.zeros(len(run), bool)
        some = np.zeros(len(run), bool)  # one of each set of equal windows, for the other blocks
        if earlier and len(which):
            least = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, group, ids[run[which]])
            done[which] = least[group] < ids[run[which]]
        elif len(which):
            done[which] = True
            some[which[np.unique(group, return_index=True)[1]]] = True
        if done.any():
            at_done = np.flatnonzero(done)
            r, a, e = spans_of(at[at_done], run[at_done], unit.width)
            yield _judged(ids[r], fps[r], place[r], a, e)
        left = np.flatnonzero((m[run] > together) & (some | ~done))
        if len(left):
            data, offsets = W.utf8(rows.column("content"))
            if unit.words:
                d, e = np.frombuffer(data.tobytes(), np.int64).reshape(-1, 2)[left].T
            else:
                of = _ramp(offsets[:-1], count)[left]
                d, e = (W.Digests(data, k).all(unit.width)[of].view(np.int64) for k in (2, 3))
            r = run[left]
            for i in range(0, len(left), 50_000):
                k = slice(i, i + 50_000)
                yield _judged(ids[r[k]], fps[r[k]], place[r[k]], at[left[k]], at[left[k]] + unit.width, d[k], e[k], ~done[left[k]])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:  # sorted by g; the last group of a batch may go on in the next
            if not len(b):
                continue
            g = long(b, "g")
            cut = int(np.searchsorted(g, g[-1])) if g[0] != g[-1] else 0
            if held and (cut or long(held[-1], "g")[-1] != g[0]):
                yield from judge(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            elif cut:
                yield from judge(pa.Table.from_batches([b.slice(0, cut)]))
            held.append(b.slice(cut))
        if held:
            yield from judge(pa.Table.from_batches(held))

    block = F.pmod(F.xxhash64("_fp", "place"), F.ceil(F.col("m") / together).cast("long"))
    dealt = found.withColumn("g", F.xxhash64("h", block)).repartition("g").sortWithinPartitions("g")
    judged = dealt.select("g", "m", "_id", "_fp", "place", "content").mapInArrow(compare, JUDGED)
    judged = written(judged, "judged", tasks)
    rows = judged.filter("d IS NOT NULL")
    counts = rows.groupBy("d", "e").agg(F.count("*").alias("n"), F.min("_id").alias("least"))
    shared = rows.filter("open").join(counts, ["d", "e"]).filter(F.col("least") < F.col("_id") if earlier else F.col("n") > 1)
    span = ["_id", "_fp", "place", "start", "end"]
    return judged.filter("d IS NULL").select(span).unionByName(shared.select(span))


def _judged(ids, fps, place, start, end, d=None, e=None, left=None) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    more = [none, none, pa.nulls(len(ids), pa.bool_())] if d is None else [pa.array(d), pa.array(e), pa.array(left)]
    return pa.RecordBatch.from_arrays([*[pa.array(x) for x in (ids, fps, place, start, end)], *more], names=["_id", "_fp", "place", "start", "end", "d", "e", "open"])


def carried(spans: DataFrame, places: DataFrame) -> DataFrame:
    """spans: as from resolved(); places: (_id, _fp, place, times, of: struct of _fp and place), places in documents of the same id whose windows equal those of the run `of`. The spans of `of`, at each such place and as often as the run follows upon itself there: spans are longer than a run has windows, so they join."""
    of = places.select("_id", F.col("_fp").alias("to_fp"), F.col("place").alias("to"), "times", F.col("of._fp").alias("_fp"), F.col("of.place").alias("place"))
    moved = F.shiftright("to", 16) - F.shiftright("place", 16)
    on = (F.shiftright("to", 8).bitwiseAND(255) + 1) * (F.col("times") - 1)
    return spans.join(of, ["_id", "_fp", "place"]).select("_id", F.col("to_fp").alias("_fp"), (F.col("start") + moved).alias("start"), (F.col("end") + moved + on).alias("end"))


def run_spans(runs: DataFrame, width: int) -> DataFrame:
    """The token span that all windows of each run cover, as often as it follows upon itself."""
    start = F.shiftright("place", 16)
    return runs.select("_id", "_fp", start.alias("start"), (start + (F.shiftright("place", 8).bitwiseAND(255) + 1) * F.col("times") + (width - 1)).alias("end"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(row, text, spans): every document with its spans, unmerged; none: null.

    The list is of one document's own spans, one for each of its runs at most; text of a
    short period has one run for each STRETCH of it. Only `row` travels, the text in it, and
    only of documents that have spans.
    """
    lists = spans.groupBy("_id", "_fp").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    some, rest = parted(docs.select("_id", "_fp", "row"), spans)
    joined = some.join(lists, ["_id", "_fp"], "left").select("row", "spans")
    joined = joined.unionByName(rest.select("row", F.lit(None).cast(joined.schema["spans"].dataType).alias("spans")))
    return joined.select("row", F.col("row.text").cast("string").alias("text"), "spans")


def covered(batch: pa.RecordBatch, bounds: np.ndarray) -> np.ndarray:
    """For each token of the batch whether a span covers it."""
    lists = batch.column("spans")
    doc = np.repeat(np.arange(len(batch)), np.nan_to_num(np.asarray(lists.value_lengths().fill_null(0))))
    flat = lists.flatten()
    step = np.zeros(int(bounds[-1]) + 1, np.int8)
    if len(flat):
        start, end = (flat.field(n).to_numpy(zero_copy_only=False) + bounds[doc] for n in ("start", "end"))
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        new = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
        step[start[new]] = 1
        step[end[np.concatenate((new[1:], [len(end)])) - 1]] = -1
    return np.cumsum(step[:-1], dtype=np.int8) > 0


def result(docs: DataFrame, **more: str) -> T.StructType:
    """A schema of `row` as it stands in docs, and more columns by type."""
    return T.StructType([docs.schema["row"], *[T.StructField(k, T.DataType.fromDDL(v)) for k, v in more.items()]])
