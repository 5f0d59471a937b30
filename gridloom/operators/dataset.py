"""Row functions over tables in batches, for what no built-in function says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _pieces(batches: Iterator[pd.DataFrame], size: int | None) -> Iterator[pd.DataFrame]:
    for b in batches:
        for at in range(0, len(b), size or max(1, len(b))):
            yield b.iloc[at : at + size] if size else b


def mapped(df: DataFrame, f: Callable, schema: str, batched: bool = False, batch_size: int | None = 1000) -> DataFrame:
    """f of every row (a dict to a dict) or batch (a pandas frame to one), which has the columns of `schema`; other columns go."""
    names = [n for n, _ in df.sparkSession.createDataFrame([], schema).dtypes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, batch_size):
            yield f(b)[names] if batched else pd.DataFrame([f(r) for r in b.to_dict("records")], columns=names)

    return df.mapInPandas(run, schema)


def filtered(df: DataFrame, f: Callable, batched: bool = False, batch_size: int | None = 1000) -> DataFrame:
    """The rows (dicts) for which f is true; batched: f gives a truth for each row of a frame."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in _pieces(batches, batch_size):
            keep = list(f(b)) if batched else [bool(f(r)) for r in b.to_dict("records")]
            yield b[pd.Series(keep, index=b.index, dtype=bool)]

    return df.mapInPandas(run, df.schema)
