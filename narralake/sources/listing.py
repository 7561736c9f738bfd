"""Folders of files as a table: names, sizes and times, without reading a byte of content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.operators.telemetry import is_chunk_file, parse_chunk_path

#: Sound files in any letter case.
WAV = "*.[wW][aA][vV]"


def file_listing(spark: SparkSession, folder: str, pattern: str = WAV) -> DataFrame:
    """path, name, size, modified of all files under a folder whose name fits the glob.

    Spark lists the folder; as the content column is not asked for, no file is
    opened, and conditions on size and modified are applied to the listing.
    Files of no bytes are not in it, as Spark plans no read for them; the views
    of finished chunks take those for missing anyway.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
    )
    return files.select(
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def chunk_listing(spark: SparkSession, folder: str) -> DataFrame:
    """file_listing of numbered chunks, with the intake and chunk that the path names."""
    files = file_listing(spark, folder).where(is_chunk_file(F.col("name")))
    intake, index = parse_chunk_path(F.col("path"))
    return files.withColumns({"intake_id": intake, "chunk_idx": index})
