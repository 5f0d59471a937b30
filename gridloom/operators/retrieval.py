"""Vectors: cosine similarity and top-k retrieval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import dropped, stored
from .corpus import ranges_for

#: Queries that are sent to every task at once; more are taken in blocks of this many.
BLOCK = 2_000


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    a, b = doubles(a), doubles(b)
    return dot(a, b) / (norm(a) * norm(b))


def top_k(queries: DataFrame, items: DataFrame, k: int, query_id: str = "query_id", item_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, item_id, score, rank): the k most similar items of each query; ties by item.

    Queries are a stated set, which goes to every task in blocks of BLOCK. A task multiplies
    a block with a batch of items at a time and lets pass what reaches, but for rounding, the
    k-th best score that it has seen so far; only those are scored exactly and shuffled. A
    vector without length is like no other.
    """
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    block = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    q = queries.select(F.col(query_id), doubles(F.col(vector)).alias("_q")).filter(norm(F.col("_q")) > 0)
    i = items.select(F.col(item_id), doubles(F.col(vector)).alias("_v")).filter(norm(F.col("_v")) > 0)
    out = None
    for b in range(blocks):
        own = q.filter(block == b).toPandas()  # about BLOCK rows
        part = i.mapInArrow(_near(own[query_id].to_numpy(), own["_q"].to_list(), k, item_id), T.StructType([q.schema[query_id], T.StructField("_q", q.schema["_q"].dataType), *i.schema.fields]))
        out = part if out is None else out.unionByName(part)
    scored = out.select(query_id, item_id, (dot(F.col("_q"), F.col("_v")) / (norm(F.col("_q")) * norm(F.col("_v")))).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), item_id))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def _near(ids: np.ndarray, vectors: list, k: int, item_id: str):
    """For mapInArrow over (item_id, _v): pairs of a query and an item that can be among the query's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(ids):
            return
        q = np.stack(vectors)
        unit = q / np.sqrt((q * q).sum(axis=1, keepdims=True))
        least = np.full(len(q), -np.inf)
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                v = b.column("_v").flatten().to_numpy().reshape(len(b), -1)
                scores = unit @ (v / np.sqrt((v * v).sum(axis=1, keepdims=True))).T
                if len(b) >= k:
                    np.maximum(least, np.partition(scores, -k, axis=1)[:, -k], out=least)
                one, other = np.nonzero(scores >= least[:, None] - 1e-9)
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[one]), pa.array(q[one].tolist(), pa.list_(pa.float64())), b.column(item_id).take(pa.array(other)), b.column("_v").take(pa.array(other))], names=["q", "_q", item_id, "_v"])

    return run


class CellIndex:
    """An inverted file: unit vectors by the nearest of some centroids, searched exactly.

    Centroids come from at most `sample` vectors, those of the least hashes; every vector is
    then put in the cell of its nearest centroid, with its angle to it, and the table is
    written, cell by cell. Angles obey the triangle inequality: a vector in a cell is no
    nearer to a query than their angles to the centroid differ. A search first scores each
    query's nearest cells, as many as hold k vectors, which bounds the angle of its k-th best;
    then only cells, and in these only vectors, that this bound leaves open. So nothing is
    missed, whatever the vectors are; where they have no clusters, little is left out.

    Vectors stay where they are: a task has the centroids, some thousand, and a block of
    queries; only pairs that can be among a query's best are shuffled.
    """

    def __init__(self, items: DataFrame, item_id: str = "vec_id", vector: str = "embedding", cells: int = 64, sample: int = 20_000, rounds: int = 8):
        self.item_id, self.spark = item_id, items.sparkSession
        rows = items.select(F.col(item_id), doubles(F.col(vector)).alias("_v")).filter(norm(F.col("_v")) > 0)
        mark = F.xxhash64(F.col(item_id).cast("string"))
        drawn = rows.orderBy(mark, item_id).limit(sample).select("_v").toPandas()["_v"]  # each task keeps `sample`
        self.centroids = _centroids(np.stack(drawn.to_list()), cells, rounds) if len(drawn) else np.zeros((0, 0))
        kind = T.StructType([*rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_angle", T.DoubleType())])
        placed = rows.mapInArrow(_placed(self.centroids), kind)
        self.items, self.path = stored(placed.repartitionByRange(ranges_for(rows), "_cell", "_angle").sortWithinPartitions("_cell"), "cells")
        stats = self.items.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_angle").alias("far"), F.min("_angle").alias("close")).collect()  # a row a cell
        self.count, self.far, self.close_ = (np.zeros(max(1, len(self.centroids))) for _ in range(3))
        for r in stats:
            self.count[r["_cell"]], self.far[r["_cell"]], self.close_[r["_cell"]] = r["n"], r["far"], r["close"]

    def drop(self) -> None:
        dropped(self.spark, self.path)

    def top_k(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "embedding", scored=None) -> DataFrame:
        """(query_id, item_id, score, rank) as top_k() gives it. `scored`: an accumulator of the number of pairs that are multiplied."""
        blocks = max(1, -(-queries.count() // BLOCK))
        q = queries.select(F.col(query_id), doubles(F.col(vector)).alias("_q")).filter(norm(F.col("_q")) > 0)
        kind = T.StructType([q.schema[query_id], T.StructField("_q", q.schema["_q"].dataType), self.items.schema[self.item_id], self.items.schema["_v"]])
        out, score = None, dot(F.col("_q"), F.col("_v")) / (norm(F.col("_q")) * norm(F.col("_v")))
        rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), self.item_id))
        best = lambda pairs: pairs.select(query_id, self.item_id, score.alias("score")).withColumn("rank", rank).filter(F.col("rank") <= k)
        for b in range(blocks):
            own = q.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b).toPandas()  # about BLOCK rows
            if not len(own) or not len(self.centroids):
                continue
            vectors = np.stack(own["_q"].to_list())
            angle = _angles(vectors, self.centroids)
            order = np.argsort(angle, axis=1)
            first = np.zeros(angle.shape, bool)
            held = np.cumsum(self.count[order], axis=1)
            np.put_along_axis(first, order, np.roll(held, 1, axis=1) < k, axis=1)
            first[np.arange(len(own)), order[:, 0]] = True
            search = lambda open_, bound, own=own, vectors=vectors, angle=angle: self.items.filter(F.col("_cell").isin([int(c) for c in np.flatnonzero(open_.any(axis=0))])).mapInArrow(_in_cells(own[query_id].to_numpy(), vectors, angle, open_, bound, k, self.item_id, scored), kind)
            near, path = stored(best(search(first, np.full(len(own), np.pi))), "nearest")
            worst = {r[0]: np.arccos(np.clip(r["s"], -1, 1)) for r in near.filter(F.col("rank") == k).select(query_id, F.col("score").alias("s")).collect()}  # a row a query
            bound = np.array([worst.get(i, np.pi) for i in own[query_id].tolist()]) + 1e-7
            rest = ~first & (np.maximum(angle - self.far, self.close_ - angle) <= bound[:, None])
            both = near.drop("rank").unionByName(best(search(rest, bound)).drop("rank")) if rest.any() else near.drop("rank")
            part, _ = stored(both.withColumn("rank", rank).filter(F.col("rank") <= k), "best")
            dropped(self.spark, path)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else best(q.crossJoin(self.items.select(self.item_id, "_v").limit(0)))


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _angles(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(v) @ centroids.T, -1, 1))


def _centroids(v: np.ndarray, cells: int, rounds: int) -> np.ndarray:
    """Unit centroids by rounds of nearest and mean; the first ones each lie far from those before."""
    v = _unit(v)
    picked, near = [0], v @ v[0]
    while len(picked) < min(cells, len(v)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, v @ v[picked[-1]])
    c = v[picked]
    for _ in range(rounds):
        own = (v @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, v)
        length = np.sqrt((sums * sums).sum(axis=1))
        c = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], c)
    return c


def _placed(centroids: np.ndarray):
    """For mapInArrow over (id, _v): with the nearest cell and the angle to its centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                angle = _angles(b.column("_v").flatten().to_numpy().reshape(len(b), -1), centroids)
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(b)), cell])], names=[*b.schema.names, "_cell", "_angle"])

    return run


def _in_cells(ids: np.ndarray, vectors: np.ndarray, angle: np.ndarray, open_: np.ndarray, bound: np.ndarray, k: int, item_id: str, scored):
    """For mapInArrow over an index's rows: pairs that can be among a query's k best, of the cells that are open to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = _unit(vectors)
        least = np.cos(np.minimum(bound, np.pi))
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                cell, own = b.column("_cell").to_numpy(), b.column("_angle").to_numpy()
                v = _unit(b.column("_v").flatten().to_numpy().reshape(len(b), -1))
                for c in np.unique(cell):
                    q, rows = np.flatnonzero(open_[:, c]), np.flatnonzero(cell == c)
                    reach = np.abs(angle[q, c][:, None] - own[rows]) <= bound[q][:, None]
                    q, rows = q[reach.any(axis=1)], rows[reach.any(axis=0)]
                    if not len(q) or not len(rows):
                        continue
                    if scored is not None:
                        scored.add(len(q) * len(rows))
                    scores = unit[q] @ v[rows].T
                    if len(rows) >= k:
                        least[q] = np.maximum(least[q], np.partition(scores, -k, axis=1)[:, -k])
                    one, other = np.nonzero(scores >= least[q][:, None] - 1e-9)
                    if len(one):
                        of, to = q[one], pa.array(rows[other])
                        yield pa.RecordBatch.from_arrays([pa.array(ids[of]), pa.array(vectors[of].tolist(), pa.list_(pa.float64())), b.column(item_id).take(to), b.column("_v").take(to)], names=["q", "_q", item_id, "_v"])

    return run
