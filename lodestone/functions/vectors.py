"""Vector expressions and the pluggable embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def usable(v: Column, dims: int) -> Column:
    """Whether a vector has the length, only finite numbers, and not only zeros."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (F.size(v) == dims) & ~F.exists(v, odd) & F.exists(v, lambda x: x != 0)


def unit(v: Column) -> Column:
    d = doubles(v)
    n = F.sqrt(dot(d, d))
    return F.transform(d, lambda x: x / n)


def cosine(a: Column, b: Column) -> Column:
    a, b = doubles(a), doubles(b)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


class Embedder(Protocol):
    """Anything that turns texts into unit vectors of ``dims`` floats."""

    dims: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Word counts in buckets by the words' MD5, scaled to length 1; a text without words counts a single placeholder."""

    def __init__(self, dims: int = 1024):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims), np.float32)
        for i, t in enumerate(texts):
            for w in _WORD.findall((t or "").lower()) or [" "]:
                out[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dims] += 1
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def embed(text: Column, embedder: Embedder, fallback: Embedder | None = None) -> Column:
    """Vectors of a text column, by Arrow batches; the embedder goes to each worker once.

    Once the embedder fails, the task goes on with the fallback, if there is one of the same length.
    """

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use = embedder
        for s in batches:
            texts = s.fillna("").tolist()
            try:
                out = use.encode(texts)
            except Exception:
                if fallback is None or use is fallback:
                    raise
                use = fallback
                out = use.encode(texts)
            yield pd.Series(list(out))

    return run(text)
