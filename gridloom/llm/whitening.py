"""Whitening of embeddings: covariance by generated column aggregates, decomposition by LAPACK."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: An entry c of a vector stands as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Sums in one aggregation: all pairs of 64 dimensions. More dimensions take several aggregations over the same table.
TOGETHER = 2_080
#: Components of a smaller share of the largest eigenvalue are rounding, not directions of the data.
LEAST_SHARE = 1e-11


def usable(rows: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """keep's columns and x: the vector's entries as long, for every row whose vector has a place.

    Rows go whose vector is null or empty, holds a null or non-finite entry or one whose
    64-fold no long can hold, or has another length than most vectors (of two equally
    frequent lengths the larger counts).
    """
    entries = F.col(vector)
    fits = F.forall(entries, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(2.0**62 / SCALE)))  # NaN is above all
    good = rows.filter(entries.isNotNull() & (F.size(entries) > 0) & fits)
    lengths = good.groupBy(F.size(entries).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    x = F.transform(entries, lambda c: F.floor(c.cast("double") * F.lit(float(SCALE))).cast("long") + F.lit(SHIFT).cast("long"))
    return good.filter(F.size(entries) == (lengths["size"] if lengths else 0)).select(*keep, x.alias("x"))


@dataclass
class Whitening:
    """n distinct vectors with sums S; components in columns, by falling eigenvalue; identity_error is measured by fit()."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0


def _sums(table: DataFrame, terms: list[str]) -> list:
    """Of each SQL expression the sum over the table, TOGETHER of them in each aggregation."""
    out: list = []
    for at in range(0, len(terms), TOGETHER):
        out += list(table.selectExpr(*[f"sum({t}) AS s{i}" for i, t in enumerate(terms[at : at + TOGETHER])]).first())
    return out


def _covariance(table: DataFrame, names: list[str], n: int) -> np.ndarray:
    """Of columns that are centred already, divisor n: the upper triangle is summed pair by pair and mirrored."""
    rows, columns = np.triu_indices(len(names))
    out = np.zeros((len(names), len(names)))
    out[rows, columns] = np.array(_sums(table, [f"{names[i]} * {names[j]}" for i, j in zip(rows, columns, strict=True)])) / n
    return np.triu(out) + np.triu(out, 1).T


def fit(usable_rows: DataFrame, most: int = 16) -> Whitening | None:
    """Whitening of the distinct x vectors of usable()'s rows; None where there are none.

    Each distinct vector counts once, so one that a third of all rows hold is reduced where
    they are read. n and the sums are exact, an entry is centred as (n * x - S) / n, exact in
    longs up to the one division, and covariances are sums of products of centred entries.
    At most `most` components; fewer where the vectors span fewer directions.
    """
    fitted = written(usable_rows.select("x").distinct(), "fitted")
    first = fitted.first()
    if first is None:
        return None
    size = len(first["x"])
    n, *sums = fitted.selectExpr("count(*) AS n", *[f"sum(x[{i}]) AS s{i}" for i in range(size)]).first()
    centred = fitted.selectExpr(*[f"CAST({n}L * x[{i}] - {s}L AS DOUBLE) / {n}D AS d{i}" for i, s in enumerate(sums)])
    covariance = _covariance(centred, [f"d{i}" for i in range(size)], n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int((values[:most] > max(values[0], 0) * LEAST_SHARE).sum())
    vectors = vectors[:, :k] * np.where(vectors[np.abs(vectors[:, :k]).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
    model = Whitening(n, np.array(sums, np.int64), values[:k], vectors, float(np.trace(covariance)))
    if k:
        names = [f"w{i}" for i in range(k)]
        made = apply(fitted, model).selectExpr(*[f"whitened[{i}] AS {c}" for i, c in enumerate(names)])
        means = [m / n for m in _sums(made, names)]
        made = made.selectExpr(*[f"{c} - {m!r}D AS {c}" for c, m in zip(names, means, strict=True)])
        model.identity_error = float(np.abs(_covariance(made, names, n) - np.eye(k)).max())
    return model


def apply(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows of usable() with `deviation`, the sum over dimensions of (n * x - S) squared, exact (null where no long holds it), and `whitened`, the coordinates by component. Nothing is shuffled."""
    n, sums = model.n, model.sums
    projection = model.components / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            about = np.abs(x.astype(float) * n - sums.astype(float)).max() + 1
            if about < 2.0**62 and np.abs(x).max() * float(n) < 2.0**62:
                centred = x * n - sums
            else:  # rare: beyond longs
                centred = x.astype(object) * n - sums.astype(object)
            squares = centred if about * about * x.shape[1] < 2.0**62 else centred.astype(object)
            deviation = (squares * squares).sum(axis=1).tolist()
            whitened = (centred.astype(float) / n) @ projection
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1, dtype=np.int32) * whitened.shape[1]), pa.array(whitened.ravel()))
            more = [pa.array([d if d < 1 << 63 else None for d in deviation], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "deviation", "whitened"])

    more = [T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))]
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *more]))


def whiten(table: DataFrame, vector: str = "embedding", keep: list[str] | None = None, most: int = 16) -> DataFrame:
    """A row for each row of the table whose vector is usable() and each component, from 1.

    Returns keep's columns (all but the vector, by default) as a struct `row`, component, n,
    deviation, whitened, explained (the component's share of the variance) and
    identity_error, one value. Null or repeated ids pass through: a repeated row has its own
    results, a repeated vector counts once in the fit. Where all vectors are equal, or the
    table is empty, there is no component and no row. A long vector is a row like any other;
    columns named as the result's stand inside `row`.
    """
    names = keep if keep is not None else [c for c in table.columns if c != vector]
    held = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).cast("string").alias("none"))
    rows = usable(table.select(held.alias("row"), F.col(f"`{vector}`").alias("v")), "v", ["row"])
    model = fit(rows, most)
    if model is None or not len(model.values):
        return rows.selectExpr("row", "1 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").limit(0)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values])
    out = apply(rows, model).select("row", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return out.select("row", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("k")].alias("explained"), F.lit(model.identity_error).alias("identity_error"))
