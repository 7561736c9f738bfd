"""Row order inside a group, without putting a whole group into one task.

``lag`` and ``row_number`` over a plain ``partitionBy(key)`` send every row of a
key to one task, so a key with a third of the data stops the job.  Here the
order column is cut into blocks and the window runs per ``(key, block)``.  Only
one summary row per block is looked at across a whole key.  The order column
must be a non-negative integer, unique inside the key, so a block never holds
more than ``block`` rows.  A null key is a key like any other.

The summary reads its input a second time, but only the columns it needs, and
it shrinks on the map side; the rows themselves are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BLOCK = 1 << 16


def _with_block(df: DataFrame, order: str, block: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))


def _join_blocks(df: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the summary of their block; null keys meet null keys."""
    named = summary.select(
        *[F.col(c).alias(f"_b_{c}" if c in (*keys, "_block") else c) for c in summary.columns]
    )
    same = F.col("_block") == F.col("_b__block")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_b_{key}"))
    return df.join(named, same).drop("_b__block", *[f"_b_{key}" for key in keys])


def with_row_number(
    df: DataFrame,
    keys: list[str],
    order: str,
    name: str,
    total: str | None = None,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Add the 1-based position of each row in its key (and the key's size)."""
    blocked = _with_block(df, order, block)
    sizes = blocked.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_key).alias("_total"),
    )
    local = Window.partitionBy(*keys, "_block").orderBy(order)
    numbered = blocked.withColumn("_local", F.row_number().over(local))
    out = _join_blocks(numbered, offsets, keys).withColumn(
        name, F.col("_before") + F.col("_local")
    )
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_block", "_before", "_total", "_local")


def with_previous(
    df: DataFrame,
    keys: list[str],
    order: str,
    value: Column,
    name: str,
    block: int = DEFAULT_BLOCK,
) -> DataFrame:
    """Add ``value`` of the row before (by ``order``) in the same key.

    ``value`` should be a struct, so that a missing row (null) and a row with
    null fields stay apart.
    """
    blocked = _with_block(df, order, block).withColumn("_value", value)
    ends = blocked.groupBy(*keys, "_block").agg(F.max_by("_value", order).alias("_last"))
    carried = ends.select(
        *keys,
        "_block",
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block")).alias("_carry"),
    )
    local = Window.partitionBy(*keys, "_block").orderBy(order)
    looked_back = blocked.withColumn("_prev", F.lag("_value").over(local))
    return (
        _join_blocks(looked_back, carried, keys)
        .withColumn(name, F.coalesce("_prev", "_carry"))
        .drop("_block", "_value", "_prev", "_carry")
    )


def newest_per_key(df: DataFrame, keys: list[str], order: str, count: int) -> DataFrame:
    """The ``count`` newest rows of each key.

    The rank filter makes Spark keep at most ``count`` rows per key and map
    task before the shuffle, so a hot key stays small.
    """
    by_newest = Window.partitionBy(*keys).orderBy(F.desc(order))
    return (
        df.withColumn("_rank", F.row_number().over(by_newest))
        .where(F.col("_rank") <= count)
        .drop("_rank")
    )
