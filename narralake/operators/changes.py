"""What differs between two states of a table: added, changed and gone keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADDED, CHANGED, GONE = "added", "changed", "gone"


def content_manifest(rows: DataFrame, key: str, *content: str) -> DataFrame:
    """key and a digest of the content of all its rows, in whatever order they are.

    Each row has 128 bits of hash over its content columns, nulls apart from
    empty values; rows of a key add up, so repeated rows count.  A null key is
    a key.  The sums are a hash aggregation on fixed-size numbers; no text is
    shuffled.
    """
    # A null and an empty value differ in the flag beside them.
    parts = [c for name in content for c in (F.col(name), F.col(name).isNull())]
    wide = "decimal(38,0)"
    sums = [F.sum(F.xxhash64(*parts, F.lit(seed)).cast(wide)).cast("string") for seed in (0, 1)]
    return rows.groupBy(key).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums).alias("digest"))


def differences(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key and change of all keys whose digest is not the same in both manifests."""
    old = before.select(F.col(key).alias("_old_key"), F.col("digest").alias("_old"))
    new = after.select(key, F.col("digest").alias("_new"))
    both = new.join(old, F.col(key).eqNullSafe(F.col("_old_key")), "full_outer")
    change = (
        F.when(F.col("_old").isNull(), F.lit(ADDED))
        .when(F.col("_new").isNull(), F.lit(GONE))
        .when(F.col("_old") != F.col("_new"), F.lit(CHANGED))
    )
    key_of = F.when(F.col("_new").isNull(), F.col("_old_key")).otherwise(F.col(key))
    return both.select(key_of.alias(key), change.alias("change")).where(F.col("change").isNotNull())
