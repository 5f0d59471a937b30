"""Token counts with a vocabulary file, where word counts will not do."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(4)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def token_count(path: str) -> Callable[[Column], Column]:
    """A function that counts a text's tokens by the tokenizer file at `path`, special tokens not added; null: 0."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = _tokenizer(path)
        for s in batches:
            yield pd.Series([len(t.encode(x, add_special_tokens=False).ids) if x else 0 for x in s])

    return count
