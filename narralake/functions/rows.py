"""Array elements as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_once(df: DataFrame, array: Column, item: str, pos: str, *keep: str) -> DataFrame:
    """One row per element with its 1-based position; ``array`` runs once.

    For a plain ``explode`` the optimizer adds a filter on the array's size and
    moves it below the projection, where it computes the whole array again.  An
    outer explode has no such filter; its rows for empty arrays are dropped here.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.where(F.col(pos).isNotNull()).withColumn(pos, (F.col(pos) + 1).cast("bigint"))
