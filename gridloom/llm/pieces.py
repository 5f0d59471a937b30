"""SentencePiece encoding and decoding; long texts by a max-plus scan over chunks.

The vocabulary file is a BPE model. Its encoding of a text is the one sequence of pieces in
which every two neighbours are the encoding of their own joined text: a merge across some
boundary would happen between those two alone as well. So encoding is a longest-path search
over (position, last piece) in which a step is allowed or not, and a chunk acts on the
pieces that cross its borders as a matrix over (max, +): for each piece that may cross its
left border and each that may cross its right one, how many pieces lie between, or minus
infinity. Matrices of neighbouring chunks multiply; the product along a prefix tells each
chunk the pieces at its borders and how many came before, and every chunk is then traced
back by itself.

What lies inside a chunk need not be searched. The library's encoding of the chunk's own
text is a path of allowed steps, its spine; between two of its pieces no other path leads,
since both would be the encoding of the same text. So a path through the chunk is a way
from the left border to the spine, a stretch of the spine, and a way from it to the right
border, or a way that never meets it; all of these are found by searching forwards from the
left border and backwards from the right one, each only as far as the spine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import CACHES, few, keyed, tasks_for, written

SPACE = "▁"
#: Texts of more characters are giant, and cut in chunks of CHUNK characters.
GIANT, CHUNK = 1 << 14, 1 << 14
#: A state is a piece (start, end) across a border; the start of a text is one of its own.
State = tuple[int, int]
START: State = (-1, 0)
Matrix = dict[State, dict[State, int]]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Spine(NamedTuple):
    """Pieces of a chunk by number: (start, end), the number of each, and all ids with the place of each piece's first and the one past its last."""

    nodes: list[State]
    place: dict[State, int]
    ids: np.ndarray
    at: np.ndarray
    stop: np.ndarray


class Pieces:
    """The model of a vocabulary file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        self.names = [self.model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))]
        self.ids = {self.names[i]: i for i in plain}
        self.scores = {self.names[i]: self.model.get_score(i) for i in plain}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(n) if self.model.is_byte(i)}
        self.surface = [b""] * n
        for name, i in self.ids.items():
            self.surface[i] = name.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.surface[i] = bytes([b])
        self.sizes = np.array([len(x) for x in self.surface])
        self.starts, self.blob = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(self.surface), np.uint8)
        self.longest = max(map(len, self.ids))
        # characters of each id; the bytes that go on with a character have none
        self.width = np.array([len(x) for x in self.names], np.int64)
        self.width[list(self.bytes.values())] = [0 if 0x80 <= b < 0xC0 else 1 for b in self.bytes]
        self.prefixes = {name[:k] for name in self.ids for k in range(2, len(name) + 1)}
        self.joins: dict[tuple[str, str], bool] = {}

    @staticmethod
    @lru_cache(2)
    def at(path: str) -> Pieces:
        return Pieces(path)

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text: the best pair is merged, the leftmost of equals, until none can be."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: str, b: str) -> bool:
        """Whether b may come after a; an empty a is the start of a text."""
        k = (a, b)
        if k not in self.joins:
            if len(self.joins) > 100_000:
                self.joins.clear()
            self.joins[k] = self.merged(a + b) == ([a, b] if a else [b])
        return self.joins[k]

    def starting(self, text: str, at: int) -> Iterator[int]:
        """Ends of the pieces that start at a place; a single character always is one."""
        yield at + 1
        for end in range(at + 2, min(at + self.longest, len(text)) + 1):
            piece = text[at:end]
            if piece not in self.prefixes:
                return
            if piece in self.ids:
                yield end

    def crossing(self, text: str, at: int, offset: int = 0) -> list[State]:
        """Pieces whose text goes on to or over a border: start < at <= end."""
        return [(s + offset, e + offset) for s in range(max(0, at - self.longest), at) for e in self.starting(text, s) if e >= at]

    def ending(self, text: str, at: int, low: int) -> Iterator[int]:
        """Starts, from `low` on, of the pieces that end at a place."""
        for start in range(at - 1, max(low, at - self.longest) - 1, -1):
            if start == at - 1 or text[start:at] in self.ids:
                yield start

    def spine(self, text: str, low: int, high: int) -> Spine:
        """The library's own encoding of the text around a chunk, from the first piece that starts in the chunk to the last."""
        first = max(0, low - self.longest)
        ids = np.array(self.model.encode(text[first : high + self.longest]), np.int64)
        width = self.width[ids]
        start = np.cumsum(width) - width + first - 1  # the library puts a space before the text
        at = np.flatnonzero((width > 0) & (start >= low) & (start < high))
        until = np.flatnonzero(width > 0)
        nodes = list(zip(start[at].tolist(), (start + width)[at].tolist(), strict=True))
        stops = np.append(until, len(ids))[np.searchsorted(until, at, side="right")]
        return Spine(nodes, {n: k for k, n in enumerate(nodes)}, ids, at, stops)

    def onward(self, text: str, high: int, entries: list[State], spine: Spine) -> tuple[dict[State, dict[State, int]], dict[State, list[State]]]:
        """For every piece reached from the left border up to and with the spine's, its count from each entry; and the pieces before it."""
        name = lambda p: "" if p == START else text[p[0] : p[1]]
        counts: dict[State, dict[State, int]] = {e: {e: 0} for e in entries}
        before: dict[State, list[State]] = {}
        waiting: dict[int, list[State]] = {}
        for e in entries:
            waiting.setdefault(e[1], []).append(e)
        places = list(waiting)
        heapify(places)
        while places:
            at = heappop(places)
            if at >= high:
                continue
            last = waiting.pop(at)
            for end in self.starting(text, at):
                node = (at, end)
                allowed = [p for p in last if self.follows(name(p), text[at:end])]
                if not allowed:
                    continue
                reach: dict[State, int] = {}
                for p in allowed:
                    for entry, n in counts[p].items():
                        reach[entry] = max(reach.get(entry, -1), n + 1)
                counts[node], before[node] = reach, allowed
                if node not in spine.place:
                    if end not in waiting:
                        waiting[end] = []
                        heappush(places, end)
                    waiting[end].append(node)
        return counts, before

    def backward(self, text: str, low: int, leaves: list[State], spine: Spine) -> dict[State, dict[State, tuple[int, tuple | None]]]:
        """For each piece at the right border the spine's pieces from which it is reached without another of the spine's: how many pieces come after that one, itself the last, and these as (piece, (piece, ...))."""
        out: dict[State, dict[State, tuple[int, tuple | None]]] = {}
        for leave in leaves:
            found = out[leave] = {}
            todo: list[tuple[State, int, tuple | None]] = [(leave, 0, None)]
            while todo:
                node, n, after = todo.pop()
                if node in spine.place:
                    found[node] = n, after
                    continue
                for start in self.ending(text, node[0], low):
                    if self.follows(text[start : node[0]], text[node[0] : node[1]]):
                        todo.append(((start, node[0]), n + 1, (node, after)))
        return out

    def leaving(self, text: str, low: int, high: int, last: bool) -> list[State]:
        """Pieces that start in a chunk and end on or over its right border; of the last chunk: at the end of the text."""
        if last:
            return [(s, high) for s in self.ending(text, high, low)]
        return [x for x in self.crossing(text, high) if x[0] >= low]

    def matrix(self, text: str, low: int, high: int, last: bool, offset: int) -> Matrix:
        """A chunk's matrix over the pieces at its borders, in places of the whole text; `last`: the text ends at high."""
        entries = [START] if low + offset == 0 else self.crossing(text, low)
        spine = self.spine(text, low, high)
        counts, _ = self.onward(text, high, entries, spine)
        back = self.backward(text, low, self.leaving(text, low, high, last), spine)
        out: Matrix = {}
        shift = lambda p: p if p == START else (p[0] + offset, p[1] + offset)

        def put(entry: State, leave: State, n: int) -> None:
            row = out.setdefault(shift(entry), {})
            row[shift(leave)] = max(row.get(shift(leave), -1), n)

        for node, reach in counts.items():
            k = spine.place.get(node)
            if k is None:
                if node != START and node[0] < high and (node[1] == high if last else node[1] >= high):
                    for entry, n in reach.items():
                        put(entry, node, n)
                continue
            for leave, ways in back.items():
                for v, (m, _) in ways.items():
                    if spine.place[v] >= k:
                        for entry, n in reach.items():
                            put(entry, leave, n + spine.place[v] - k + m)
        return out

    def trace(self, text: str, low: int, high: int, entry: State, leave: State) -> list[int]:
        """Ids of the pieces after `entry` up to `leave`. Places are in `text`."""
        spine = self.spine(text, low, high)
        counts, before = self.onward(text, high, [entry], spine)

        def way(node: State) -> list[int]:
            path = []
            while node != entry:
                path.append(node)
                node = before[node][0]
            return [i for s, e in reversed(path) for i in self.spelled(text[s:e])]

        if leave in counts and leave not in spine.place:
            return way(leave)
        ways = self.backward(text, low, [leave], spine)[leave]
        u, v = next((u, v) for v in ways for u in counts if u in spine.place and spine.place[u] <= spine.place[v])
        first, to = spine.place[u], spine.place[v]
        inside = spine.ids[spine.stop[first] : spine.stop[to]].tolist()
        out, after = [*way(u), *inside], ways[v][1]
        while after:
            (start, end), after = after
            out += self.spelled(text[start:end])
        return out

    def spelled(self, piece: str) -> list[int]:
        """A piece's id, or the ids of its bytes."""
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, without the space that encoding put before each; null: null."""
        size = np.asarray(ids.value_lengths().fill_null(0))
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        n = self.sizes[flat]
        ends = np.cumsum(n)
        data = self.blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[flat] - (ends - n), n)]
        at = np.concatenate((np.zeros(1, np.int64), ends))[np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))]
        first = at[:-1][(at[1:] > at[:-1])]
        first = first[data[first] == 32]
        stay = np.ones(len(data), bool)
        stay[first] = False
        to = np.concatenate((np.zeros(1, np.int64), np.cumsum(stay)))[at]
        data = data[stay].tobytes()
        valid = None if not ids.null_count else pa.array(np.asarray(ids.is_valid())).buffers()[1]
        out = pa.Array.from_buffers(pa.large_string(), len(ids), [valid, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data)])
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:  # ids of bytes that are no text
            out = pa.array([None if not v else data[a:b].decode("utf-8", "replace") for v, a, b in zip(ids.is_valid().to_pylist(), to[:-1], to[1:], strict=True)], pa.large_string())
        return out.cast(pa.string())


def product(a: Matrix, b: Matrix) -> Matrix:
    """The matrix of two neighbouring chunks."""
    out: Matrix = {}
    for entry, mid in a.items():
        row: dict[State, int] = {}
        for m, n in mid.items():
            for leave, k in b.get(m, {}).items():
                row[leave] = max(row.get(leave, -1), n + k)
        if row:
            out[entry] = row
    return out


def solve(matrices: list[Matrix], entry: State = START, leave: State | None = None, before: int = 0) -> list[tuple[State, State, int]]:
    """For each of some neighbouring chunks, or blocks of chunks, the piece at its left and at its right border, and how many pieces come before it. entry, leave: the pieces at the borders of all of them, before: the pieces that come before; no leave: the end of the text."""
    into = [{entry: before}]
    for m in matrices:
        into.append(product({entry: into[-1]}, m).get(entry, {}))
    leave = max(into[-1], key=into[-1].get) if leave is None else leave
    out = []
    for m, at in zip(reversed(matrices), reversed(into[:-1]), strict=True):
        entry = next(e for e in at if leave in m.get(e, {}))
        out.append((entry, leave, at[entry]))
        leave = entry
    return out[::-1]


#: Matrices that are multiplied in one place; of more, the products of so many are multiplied, and so on.
FAN = 32
_STATE = "struct<s:long,e:long>"


def _chunk(pieces: Pieces, c: dict) -> tuple[str, int, int, int]:
    """(text, low, high, offset) of a chunk row."""
    return c["text"], c["low"], c["high"], c["at"] - c["low"]


def encode(docs: DataFrame, path: str | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """(row, ids) for every row: the ids that the library gives for the whole text.

    Texts of up to `giant` characters, a chunk, are encoded at once. Longer ones are cut in
    chunks of `chunk` characters that are spread over the cluster: each gives its matrix (a few
    hundred bytes), matrices are multiplied up a tree, FAN neighbours at a time, borders are
    found down the tree, and each chunk is traced back by itself. No row holds more than FAN
    matrices, however long a text is. Null or
    empty text: no ids. Null ids, repeated rows and further columns pass through in `row`; an
    empty table gives an empty result.
    """
    path = path or default_path()
    tasks = tasks_for(docs)
    docs = keyed(docs).withColumn("text", F.col("row.text").cast("string"))
    row = docs.schema["row"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces.at(path).model
        for b in batches:
            for i in range(0, len(b), 500):
                p = b.slice(i, 500)
                ids = model.encode([t or "" for t in p.column("text").to_pylist()], num_threads=1)
                yield pa.RecordBatch.from_arrays([p.column("row"), pa.array(ids, pa.list_(pa.int32()))], names=["row", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin = Pieces.at(path).longest
        for b in batches:
            for i, f, t in zip(b.column("_id").to_pylist(), b.column("_fp").to_pylist(), b.column("text"), strict=True):
                t = SPACE + t.as_py().replace(" ", SPACE)
                for k, at in enumerate(range(0, len(t), chunk)):
                    low, high = max(0, at - margin), min(at + chunk, len(t))
                    yield pa.RecordBatch.from_pylist([{"_id": i, "_fp": f, "k": k, "at": at, "low": at - low, "high": high - low, "last": high == len(t), "text": t[low : high + margin]}])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(path)
        for b in batches:
            for c in b.to_pylist():
                text, low, high, offset = _chunk(pieces, c)
                m = pieces.matrix(text, low, high, c["last"], offset)
                cells = [{"a": {"s": a[0], "e": a[1]}, "b": {"s": x[0], "e": x[1]}, "n": n} for a, r in m.items() for x, n in r.items()]
                yield pa.RecordBatch.from_arrays([pa.array([c["_id"]]), pa.array([c["_fp"]]), pa.array([c["k"]]), pa.array([cells], cell_type)], names=["_id", "_fp", "k", "cells"])

    state = pa.struct([("s", pa.int64()), ("e", pa.int64())])
    cell_type = pa.list_(pa.struct([("a", state), ("b", state), ("n", pa.int64())]))
    border_type = pa.schema([("_id", pa.int64()), ("_fp", pa.int64()), ("k", pa.int64()), ("a", state), ("b", state), ("n", pa.int64())])

    def read(cells: list[dict]) -> Matrix:
        m: Matrix = {}
        for x in cells:
            m.setdefault((x["a"]["s"], x["a"]["e"]), {})[(x["b"]["s"], x["b"]["e"])] = x["n"]
        return m

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.to_pylist():
                m = reduce(product, [read(x["cells"]) for x in c["chunks"]])
                cells = [{"a": {"s": a[0], "e": a[1]}, "b": {"s": x[0], "e": x[1]}, "n": n} for a, r in m.items() for x, n in r.items()]
                yield pa.RecordBatch.from_arrays([pa.array([c["_id"]]), pa.array([c["_fp"]]), pa.array([c["k"]]), pa.array([cells], cell_type)], names=["_id", "_fp", "k", "cells"])

    def borders_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.to_pylist():
                ends = {} if c.get("a") is None else {"entry": (c["a"]["s"], c["a"]["e"]), "leave": (c["b"]["s"], c["b"]["e"]), "before": c["n"]}
                found = solve([read(x["cells"]) for x in c["chunks"]], **ends)
                got = [{"_id": c["_id"], "_fp": c["_fp"], "k": x["k"], "a": {"s": a[0], "e": a[1]}, "b": {"s": z[0], "e": z[1]}, "n": n} for x, (a, z, n) in zip(c["chunks"], found, strict=True)]
                yield pa.RecordBatch.from_pylist(got, border_type)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(path)
        for b in batches:
            for c in b.to_pylist():
                text, low, high, offset = _chunk(pieces, c)
                place = lambda p, o=offset: START if p["s"] < 0 else (p["s"] - o, p["e"] - o)
                ids = pieces.trace(text, low, high, place(c["a"]), place(c["b"]))
                yield pa.RecordBatch.from_arrays([pa.array([c["_id"]]), pa.array([c["_fp"]]), pa.array([c["k"]]), pa.array([ids], pa.list_(pa.int32()))], names=["_id", "_fp", "k", "ids"])

    fits = F.coalesce(F.length("text"), F.lit(0)) <= giant
    short = docs.filter(fits).select("row", "text").mapInArrow(whole, T.StructType([row, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    long = docs.filter(~fits)
    chunks = long.select("_id", "_fp", "text").mapInArrow(cut, "_id long, _fp long, k long, at long, low long, high long, last boolean, text string")
    # chunks of one text are dealt to many files; those of repeated rows are equal, and sets take them once
    chunks = written(chunks.repartition(tasks, "_id", "_fp", "k"), "chunks")
    cells, border = f"_id long, _fp long, k long, cells array<struct<a:{_STATE},b:{_STATE},n:long>>", f"_id long, _fp long, k long, a {_STATE}, b {_STATE}, n long"
    grouped = lambda level: level.groupBy("_id", "_fp", F.floor(F.col("k") / FAN).cast("long").alias("block")).agg(F.array_sort(F.collect_set(F.struct("k", "cells"))).alias("chunks")).withColumnRenamed("block", "k")
    level = chunks.mapInArrow(matrices, cells)
    most = (chunks.agg(F.max("k")).first()[0] or 0) + 1
    levels = []
    while most > FAN:
        levels.append(written(level, "matrices", tasks))
        level, most = grouped(levels[-1]).mapInArrow(multiply, cells), -(-most // FAN)
    borders = written(grouped(level).mapInArrow(borders_of, border), "borders", tasks)
    for level in reversed(levels):
        borders = written(grouped(level).join(borders, ["_id", "_fp", "k"]).mapInArrow(borders_of, border), "borders", tasks)
    # one plan at every size: a few borders would be broadcast, many not
    traced = chunks.join(borders.hint("merge"), ["_id", "_fp", "k"]).mapInArrow(trace, "_id long, _fp long, k long, ids array<int>")
    ids = traced.groupBy("_id", "_fp").agg(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids"))
    return few(short.unionByName(long.join(ids, ["_id", "_fp"]).select("row", "ids")), tasks)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded with a column `decoded`: the text of `ids`; null ids: null."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.at(path)
        for b in batches:
            for i in range(0, len(b), 500):
                p = b.slice(i, 500)
                yield pa.RecordBatch.from_arrays([*p.columns, pieces.decode(p.column("ids"))], names=[*p.schema.names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


CACHES.append(Pieces.at.cache_clear)
