"""Vectors that take part, and tiles in which stated queries meet all of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_vector(vector: Column) -> Column:
    """Neither null nor empty, and every component is a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of doubles; shorter ones are filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(lists.offsets.to_numpy()) if len(lists) else np.zeros(0, np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lists) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lists), width))
    row = np.repeat(np.arange(len(lists)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def renewed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a join of two frames that come from one."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def in_tiles(rows: DataFrame, queries: DataFrame, key: str, rows_each: int, queries_each: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``tile``: every query shares exactly one tile with every row.

    Rows are dealt into blocks of about ``rows_each`` by a hash of ``key``, queries into ranges of about ``queries_each``; a tile is a
    block and a range, so it stays bounded however many there are of either.
    """
    blocks = max(1, -(-rows.count() // rows_each))
    ranges = max(1, -(-queries.count() // queries_each))
    mine = F.pmod(F.xxhash64(key, F.lit("block")), F.lit(blocks))
    other = F.pmod(F.xxhash64(key, F.lit("range")), F.lit(ranges))
    left = rows.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(ranges - 1)), lambda r: mine * ranges + r)))
    right = queries.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b * ranges + other)))
    return left, renewed(right)
