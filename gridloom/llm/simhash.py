"""SimHash near-duplicates, joined through Golay codewords."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, release, tasks_for, written
from .components import components

U = np.uint64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Generator polynomial of the (23, 12) Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
_GENERATOR = 0b101011100011
#: Fingerprints of one key that one task compares in memory; larger groups are cut in blocks.
TOGETHER = 4096


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Bit k is 1 if it is set in over half the XXH64 hashes (seed 42) of the shingles."""
    import xxhash

    words = _WORD.findall(text.translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        starts, ends = [0], [len(line)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stops = np.cumsum(sizes) - 1
        starts, ends = np.concatenate(([0], stops[: -shingle] + 1)).tolist(), stops[shingle - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], U)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        votes += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(starts)).tobytes(), "big")


def remainder(words: np.ndarray) -> np.ndarray:
    """Of 23-bit words, as polynomials, divided by the generator: 11 bits, zero for codewords."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest ^= (rest >> bit & 1) * (_GENERATOR << (bit - 11))
    return rest


@lru_cache(1)
def golay() -> np.ndarray:
    """The error of each remainder: the code is perfect, so every remainder is that of exactly one error of up to three bits."""
    errors = np.array([0] + [sum(1 << i for i in e) for n in (1, 2, 3) for e in combinations(range(23), n)], np.int64)
    out = np.zeros(1 << 11, np.int64)
    out[remainder(errors)] = errors
    return out


def nearest(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 12 bits of each 23-bit word's nearest codeword, and the weight of the error (0 to 3)."""
    error = golay()[remainder(words)]
    return (words ^ error) >> 11, np.bitwise_count(error)


def codeword_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) for every codeword within four bits of a 23-bit word: one, or six where the nearest is three bits away.

    Two words that differ in at most one bit share a codeword: the nearest one of either is
    within four bits of the other.
    """
    near, weight = nearest(words)
    rows, keys = [np.arange(len(words))], [near]
    far = np.flatnonzero(weight == 3)
    if len(far):
        # a codeword at distance four lies within three bits of the word with one bit flipped
        codes = nearest(words[far][:, None] ^ (1 << np.arange(23))[None, :])[0]
        codes[codes == near[far][:, None]] = -1
        codes.sort(axis=1)
        new = np.ones(codes.shape, bool)
        new[:, 1:] = codes[:, 1:] != codes[:, :-1]
        new &= codes >= 0
        r, _ = np.nonzero(new)
        rows.append(far[r])
        keys.append(codes[new])
    return np.concatenate(rows), np.concatenate(keys)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): fingerprints within three bits share a key.

    A fingerprint has four segments of 16 bits. Three errors leave a segment without any
    whose right neighbour (in a ring) has at most one: with one clean segment the others
    have one each; with more, at most one segment has over one, and it follows only one of
    them. The key is that clean segment and a codeword near its neighbour.
    """
    rows, keys = [], []
    x = fps.view(U)
    parts = [(x >> U(16 * s) & U(0xFFFF)).astype(np.int64) for s in range(4)]
    for s in range(4):
        r, code = codeword_keys(parts[(s + 1) % 4])
        rows.append(r)
        keys.append((s << 28) | (parts[s][r] << 12) | code)
    return np.concatenate(rows), np.concatenate(keys)


def close(a: np.ndarray, b: np.ndarray, bits: int = 3) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= bits


def forest(x: np.ndarray, y: np.ndarray | None = None, bits: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever is within `bits` of each other, fewer than there are members: among x, or where y is given between x and y."""
    label = np.arange(len(x) + (0 if y is None else len(y)))
    a, b = [], []
    for at in range(0, len(x), 256):
        hit = close(x[at : at + 256], x[: at + 256] if y is None else y, bits)
        for i in range(at, min(at + 256, len(x))):
            near = np.flatnonzero(hit[i - at, :i] if y is None else hit[i - at])
            if len(near):
                j = near + (0 if y is None else len(x))
                tags, one = np.unique(label[j], return_index=True)
                new = tags != label[i]
                a += [i] * int(new.sum())
                b += near[one[new]].tolist()
                label[np.isin(label, tags) | (label == label[i])] = min(tags[0], label[i])
    return x[a], (x if y is None else y)[b]


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; null text: as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            text = b.column("text").cast(pa.large_binary())
            fps = np.array([fingerprint(x.as_py() or b"", shingle) for x in text], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, bits: int = 3, together: int = TOGETHER, tasks: int | None = None) -> DataFrame:
    """distinct: (fp). Edges (a, b) that connect all fingerprints within `bits` (at most 3) of each other."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy()
            for at in range(0, len(fps), 4000):
                r, k = keys_of(fps[at : at + 4000])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fps[at : at + 4000][r])], names=["key", "fp"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = [], []
            for x in b.column("fps"):
                p, q = forest(np.sort(x.values.to_numpy().view(U)), bits=bits)
                a.append(p)
                c.append(q)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, U), *x]).view(np.int64)) for x in (a, c)], names=["a", "b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, q in zip(b.column("p"), b.column("q"), strict=True):
                x, y = forest(*(np.sort(v.values.to_numpy().view(U)) for v in (p, q)), bits)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])

    keys = written(distinct.mapInArrow(spread, "key long, fp long"), "golay-keys", tasks)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keys.join(sizes, "key")
    # a group of over `together` is dealt into blocks, which are compared with themselves and with each other
    block = F.when(F.col("n") > together, F.pmod(F.xxhash64("fp"), F.ceil(F.col("n") / (together / 2)).cast("long"))).otherwise(F.lit(0).cast("long"))
    blocks = members.groupBy("key", block.alias("block"), "n").agg(F.collect_list("fp").alias("fps"))
    within = blocks.filter(F.size("fps") > 1).select("fps").mapInArrow(linked, "a long, b long")
    large = blocks.filter(F.col("n") > together)
    p = large.select("key", F.col("block").alias("i"), F.col("fps").alias("p"), F.explode(F.sequence(F.col("block") + 1, F.ceil(F.col("n") / (together / 2)).cast("long"))).alias("j"))
    q = large.select("key", F.col("block").alias("j"), F.col("fps").alias("q"))
    return within.unionByName(p.join(q, ["key", "j"]).select("p", "q").mapInArrow(across, "a long, b long"))


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3, together: int = TOGETHER) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over fingerprints that differ in at most `bits` bits.

    Equal fingerprints are one node, however many documents share it. Nodes meet by Golay
    keys; each group of a key yields a spanning forest of its links, never all pairs, and
    large groups are cut in blocks that are all compared. Components are found on the nodes.
    Fingerprints that over a thousandth of the rows share (under 1000, so small enough to
    broadcast) are joined back without a shuffle; the others meet by hash.

    Null or empty text: fingerprint zero, linked like any other. Null ids never count as
    smallest; where no id is known component_id is null. Repeated rows stay. An empty table
    gives an empty result. A text of any length is hashed whole. Only doc_id and text are
    read, whatever else the table has.
    """
    tasks = tasks_for(docs)
    rows = written(fingerprints(docs, shingle), "simhash", tasks)
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes", tasks)
    roots = written(components(links(nodes.select("fp"), bits, together, tasks), tasks), "simhash-roots", tasks)
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = written(placed.join(ids, "root").select("fp", "n", "component_id"), "simhash-classes", tasks)
    total = rows.count()
    hot = placed.filter(F.col("n") > max(total / 1000, 1)).select("fp", "component_id")
    apart = rows.join(F.broadcast(hot), "fp").select("doc_id", "fp", "component_id")
    rest = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti").join(placed.filter(F.col("n") <= max(total / 1000, 1)).select("fp", "component_id"), "fp")
    return few(apart.unionByName(rest.select("doc_id", "fp", "component_id")), tasks)
