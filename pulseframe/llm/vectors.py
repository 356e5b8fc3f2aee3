"""Vector columns: what takes part in a search, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """True for a vector that is not null and whose components all are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0, dtype=np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    width = int(lengths.max()) if len(lengths) else 0
    if (lengths == width).all():
        return values.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), dtype=dtype)
    out[np.arange(width) < lengths[:, None]] = values
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best rows (query_id, vec_id, score) of each query with their rank; Spark cuts to k per task before it shuffles."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
