"""Vectors as integers: the part that all vector operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components from here on have no exact squares and sums in 64 bits.
LIMIT = 1 << 28
#: Whole numbers below this are exact as double.
EXACT = 1 << 53


def usable(vector: str, scale: int) -> Column:
    """Not null, not empty, and no component that is null, not finite or too large to be exact."""
    numbers = F.col(vector).cast("array<double>")
    return F.coalesce(
        (F.size(numbers) > 0)
        & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) * F.lit(float(scale)) < F.lit(float(LIMIT)))),
        F.lit(False),
    )


def scaled(vector: str, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null for those that no usable vector has, as the
    optimizer may ask for this before the filter."""
    number = lambda x: x * F.lit(float(scale))
    return F.transform(
        F.col(vector).cast("array<double>"),
        lambda x: F.when(F.abs(number(x)) < F.lit(float(LIMIT)), F.floor(number(x)).cast("int")),
    )


def one_length(df: DataFrame, id_column: str, vector: str, multiple: int = 1) -> tuple[DataFrame, int]:
    """Vectors as long as that of the smallest id whose length is a multiple of ``multiple``.

    Null ids come last; of rows with one id the smallest vector counts. 0 where there is none.
    """
    fitting = df.where(F.size(vector) % multiple == 0)
    first = fitting.orderBy(F.col(id_column).asc_nulls_last(), vector).select(F.size(vector)).first()
    width = first[0] if first else 0
    return fitting.where(F.size(vector) == width), width


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared Euclidean distances between the rows of two whole-number matrices."""
    own = [np.einsum("ij,ij->i", m.astype(np.int64), m.astype(np.int64)) for m in (a, b)]
    return own[0][:, None] - 2 * products(a, b) + own[1][None, :]
