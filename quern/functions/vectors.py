"""Vectors as arrays: products, codecs and truncation.  Null vectors give null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, epsilon: float | None = None) -> Column:
    """0 for an all-zero vector; with ``epsilon`` it is added to the product of the lengths instead."""
    size = norm(a) * norm(b)
    return dot(a, b) / (size + epsilon) if epsilon else F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit(a: Column) -> Column:
    """A vector of length one; an all-zero one stays as it is."""
    n = norm(a)
    return F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x / n))


def truncated(a: Column, dim: int) -> Column:
    """The first numbers of a nested vector, brought back to length one."""
    return unit(F.slice(a, 1, dim))


def to_blob(c: Column) -> Column:
    """32-bit numbers, little-endian, as bytes."""

    @F.pandas_udf("binary")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vs in batches:
            yield vs.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return udf(c)


def from_blob(c: Column) -> Column:
    """The vector of such bytes; null if their number isn't a multiple of four."""

    @F.pandas_udf("array<float>")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bs in batches:
            yield bs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, dtype="<f4").tolist())

    return udf(c)
