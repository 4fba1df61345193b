"""What the vector operators share: which vectors take part, and blocks of vectors as rows of bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def usable(df: DataFrame, id_col: str, vector_col: str, *more: str) -> DataFrame:
    """(vec_id, vec, d, more) of the vectors that take part; d is their dimension. Vectors of different dimensions have no
    cosine. Rows with a null id take no part."""
    rows = df.where(takes_part(F.col(vector_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"), *more)
    return rows.withColumn("d", F.size("vec"))


def matrix(raw: bytes, d: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(-1, d)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each row of a with the same row of b, added up from the first component to the last: the same for
    equal rows wherever they stand, and as SQL engines have it."""
    out = np.zeros(len(a))
    for x, y in zip(np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)):
        out += x * y
    return out


def cosines(a: np.ndarray, b: np.ndarray, aa: np.ndarray | None = None, bb: np.ndarray | None = None, chunk: int = 20_000) -> np.ndarray:
    """Cosine of each row of a with the same row of b, in double precision; aa and bb: products of the rows with themselves."""
    out = np.empty(len(a))
    for i in range(0, len(a), chunk):
        j = slice(i, i + chunk)
        x, y = (products(v[j], v[j]) if vv is None else vv[j] for v, vv in ((a, aa), (b, bb)))
        with np.errstate(over="ignore", under="ignore"):
            both = x * y
        fine = np.isfinite(both) & (both > 1e-290)
        out[j] = products(a[j], b[j]) / np.where(fine, np.sqrt(np.where(fine, both, 1.0)), np.sqrt(x) * np.sqrt(y))
    return out
