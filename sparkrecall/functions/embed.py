"""Embedding providers. A provider is a function ``Iterator[pd.Series[str]] ->
Iterator[pd.Series[list[float]]]`` run as an iterator pandas UDF, so a model
is loaded once per Python worker and fed Arrow batches. The built-in
``hashing_provider`` (signed feature hashing of the sparse-index tokens,
L2-normalised) stands in for a sentence encoder in tests; it is expressible in
SQL, so DuckDB can check every dense result."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the hashing provider: dimension; bucket = first 8 hex digits of
# md5(token) mod dim; sign = +1 when the 9th-10th hex digits form an even number.
HASH_DIM = 64
# Tokens whose slot a worker remembers, and texts tokenised at once.
TOKEN_CACHE, SLICE_TEXTS = 1 << 17, 256

Provider = Callable[[Iterator[pd.Series]], Iterator[pd.Series]]


def _token_slot(tok: str, dim: int) -> tuple[int, float]:
    h = hashlib.md5(tok.encode("utf-8")).hexdigest()
    return int(h[:8], 16) % dim, (1.0 if int(h[8:10], 16) % 2 == 0 else -1.0)


class _Slots(dict):
    """2 * bucket + (1 if the sign is -1) of each token; at most ``TOKEN_CACHE`` tokens are held."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, tok: str) -> int:
        if len(self) >= TOKEN_CACHE:
            self.clear()
        bucket, sign = _token_slot(tok, self.dim)
        self[tok] = slot = 2 * bucket + (sign < 0)
        return slot


def hashing_provider(dim: int = HASH_DIM) -> Provider:
    def provider(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = _Slots(dim)   # per worker
        for s in batches:
            texts = s.fillna("").tolist()
            mat = np.zeros((len(texts), dim))
            for at in range(0, len(texts), SLICE_TEXTS):   # tokens of a slice alone are held
                words = [t.lower().split() for t in texts[at:at + SLICE_TEXTS]]
                sizes = [len(w) for w in words]
                slot = np.fromiter(map(slots.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
                place = np.repeat(np.arange(len(words)), sizes) * dim + (slot >> 1)
                mat[at:at + len(words)] = np.bincount(place, 1.0 - 2.0 * (slot & 1), len(words) * dim).reshape(-1, dim)
            n = np.sqrt((mat * mat).sum(1, keepdims=True))
            mat = np.divide(mat, n, out=np.zeros_like(mat), where=n > 0)
            yield pd.Series(list(mat))
    return provider


def embed(df: DataFrame, text_col: str, provider: Provider | None = None, out_col: str = "vec") -> DataFrame:
    """Add ``out_col`` (array<double>) computed by ``provider`` over ``text_col``."""
    fn = F.pandas_udf(provider or hashing_provider(), T.ArrayType(T.DoubleType()))
    return df.withColumn(out_col, fn(F.col(text_col)))
