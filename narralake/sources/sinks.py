"""Writing results as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 16


def write_by_bucket(
    df: DataFrame, key: str, folder: str, fmt: str = "parquet", buckets: int = BUCKETS
) -> None:
    """Store a table by bucket of an integer key.

    A bucket is a folder that every task may write a file into, so a hot key
    needs no shuffle, and there is never a file per row.
    """
    bucket = F.pmod(F.col(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").format(fmt).save(
        folder
    )


def bucket_count(df: DataFrame, per_core: int = 2) -> int:
    """A power of two that gives every core of the cluster a few buckets."""
    wanted = max(1, df.sparkSession.sparkContext.defaultParallelism * per_core)
    return 1 << (wanted - 1).bit_length()


def write_colocated(
    df: DataFrame, table: str, key: str, *order: str, buckets: int | None = None, path: str | None = None
) -> int:
    """Store a table in buckets of its key, sorted, so that tables of one layout join without a shuffle.

    ``buckets`` follows the cluster where it is not given; tables that shall
    meet need the same number, which is returned.  Rows are dealt out as the
    buckets are, so there is one file a bucket.  Joins on the key and more
    columns use the layout if spark.sql.requireAllClusterKeysForCoPartition is
    false in the session.  A key with very many rows
    fills its bucket; chunk, context and request tables have no such key, as a
    document was one row before.
    """
    count = buckets or bucket_count(df)
    writer = df.repartition(count, key).write.mode("overwrite").bucketBy(count, key).sortBy(key, *order)
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return count
