"""What both vector searches share: clean vectors, blocks of rows, blocks of queries, final ranks.

A query set meets all rows in blocks: rows are dealt into blocks, queries into
groups, and a task sees one block and one group.  Every size that a task holds
is bounded, and each side is shuffled once per block or group of the other.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8192
GROUP = 32_768
EVERY = 100


def usable(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    return F.coalesce(F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def n_blocks(n: int, size: int) -> int:
    return max(1, -(-n // size))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of doubles; shorter vectors end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    out[rows, np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def best_pairs(
    row: np.ndarray, value: np.ndarray, ids: np.ndarray, k: int
) -> np.ndarray:
    """Positions of each row's k smallest values, ties to the smaller id."""
    order = np.lexsort((ids, value, row))
    sorted_row = row[order]
    starts = np.r_[0, np.flatnonzero(np.diff(sorted_row)) + 1] if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k]


def meet(
    queries: DataFrame,
    rows: DataFrame,
    blocks: int,
    groups: int,
    kernel: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    first_block: int = 0,
) -> DataFrame:
    """Run the kernel for each group of queries (_group) on each block of rows (_block)."""
    every_block = F.sequence(F.lit(first_block), F.lit(blocks - 1))
    every_group = F.sequence(F.lit(0), F.lit(groups - 1))
    left = queries.withColumn("_block", F.explode(every_block)).groupBy("_block", "_group")
    right = rows.withColumn("_group", F.explode(every_group)).groupBy("_block", "_group")
    return left.cogroup(right).applyInArrow(kernel, schema)


def ranked(found: DataFrame, k: int, best_first: Column) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(best_first, "vec_id")
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select("query_id", "rank", "vec_id", "score")
