"""Vector arithmetic on array columns, in double."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(vector: Sequence[float]) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product; null when either is null or the lengths differ."""
    a, b = _col(a), _col(b)
    sums = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), sums)


def scores_against(vector: Sequence[float]):
    """Arrow UDF: dot products with a constant vector, whole batches at a time (an expression over arrays is interpreted value by value).
    Every row must have the vector's length; a null value gives null."""
    q = np.asarray(vector, np.float64)

    def run(rows: pa.Array) -> pa.Array:
        x = rows.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), len(q)) @ q
        return pa.array(x, mask=np.isnan(x))

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")


def norm(a: str | Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine; 0 where either vector has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(_col(a).isNotNull() & _col(b).isNotNull(), F.lit(0.0)))


def normalize(a: str | Column) -> Column:
    """Scaled to length 1; a zero vector stays as it is."""
    a = _col(a)
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def blend(a: str | Column, b: str | Column, weight_a: float | Column, weight_b: float | Column) -> Column:
    """Element-wise weighted sum."""
    wa, wb = (w if isinstance(w, Column) else F.lit(float(w)) for w in (weight_a, weight_b))
    return F.zip_with(_col(a), _col(b), lambda x, y: wa * x + wb * y)


def mean_of(vectors: str | Column, size: int) -> Column:
    """Element-wise mean of an array of vectors."""
    v = _col(vectors)
    zero = F.array_repeat(F.lit(0.0), size)
    total = F.aggregate(v, zero, lambda s, x: F.zip_with(s, x, lambda p, q: p + q.cast("double")))
    return F.transform(total, lambda x: x / F.size(v))


def projection(dim: int, out: int = 1024, seed: int = 7):
    """Gaussian projection of the sparse code; the same for the same arguments."""
    return np.random.default_rng(seed).standard_normal((dim, out))


def sparse_code(dim: int, frac: float = 0.03, out: int = 1024, seed: int = 7):
    """Pandas UDF: sorted positions of the largest projected values, ceil(frac * out) of them at least 1; null for null."""
    keep = max(1, int(np.ceil(frac * out)))

    def code(v: pd.Series) -> pd.Series:
        matrix = projection(dim, out, seed)
        out_rows: list = [None] * len(v)
        ok = [i for i, x in enumerate(v) if x is not None and len(x) == dim]
        if ok:
            p = np.stack([np.asarray(v.iloc[i], np.float64) for i in ok]) @ matrix
            top = np.sort(np.argpartition(-p, keep - 1, axis=1)[:, :keep], axis=1).astype(np.int32)
            for i, t in zip(ok, top, strict=True):
                out_rows[i] = t
        return pd.Series(out_rows, index=v.index, dtype=object)

    return F.pandas_udf(code, "array<int>")
