"""What the two operators on embeddings share: packing vectors, and samples with a bound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


def usable(column: str = "embedding") -> Column:
    """True for vectors that take part: not null, not empty, all components finite, not all zero."""
    finite = F.forall(F.col(column), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & finite & F.exists(F.col(column), lambda x: x != 0), F.lit(False))


def is_single(table: DataFrame) -> bool:
    kind = table.schema["embedding"].dataType
    return isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)


def kind_of(table: DataFrame) -> str:
    """The numpy type in which components travel without loss: singles where the table holds singles, else doubles."""
    return "<f4" if is_single(table) else "<f8"


def rows_of(table: DataFrame) -> DataFrame:
    """(vec_id, v): ids as long and vectors as arrays of float or double; unusable vectors are null."""
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable(), F.col("embedding").cast("array<float>" if is_single(table) else "array<double>")).alias("v"))


def sample(rows: DataFrame, bound: int) -> np.ndarray:
    """The usable vectors with the ``bound`` smallest hashes of their ids, as a matrix; of several lengths the most frequent is taken."""
    good = rows.where("v is not null")
    found = [np.array(r.v, np.float64) for r in good.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(bound).collect()]
    if not found:
        return np.zeros((0, 0))
    lengths = [len(v) for v in found]
    d = max(sorted(set(lengths)), key=lengths.count)
    return np.stack([v for v in found if len(v) == d])


def matrix(column, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow list column as a matrix of doubles, and which rows have ``d`` components (the others are zeros)."""
    offsets = np.asarray(column.offsets)
    flat = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)
    size = np.diff(offsets)
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & (size == d)
    out = np.zeros((len(column), d))
    if valid.any():
        out[valid] = flat[(offsets[:-1][valid][:, None] + np.arange(d)).ravel()].reshape(-1, d)
    return out, valid
