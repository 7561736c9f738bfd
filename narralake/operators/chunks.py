"""Chunk tables: building, preview and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralake.functions import chunking as ck
from narralake.functions.rows import explode_once
from narralake.functions.text import snippet


def explode_chunks(docs: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per element, numbered from 1 within its document."""
    return explode_once(docs, chunks, "text", "chunk_idx", *keep)


def chunk_documents(
    docs: DataFrame, *keep: str, soft_max: int | None = None, cap: int | None = None
) -> DataFrame:
    """``doc_id, text`` to the chunk table; map-only."""
    chunks = ck.chunk_text(F.col("text"), soft_max, cap)
    return explode_chunks(docs, chunks, "doc_id", *keep).withColumn(
        "char_count", F.length("text").cast("bigint")
    )


def chunk_warning(count: Column, cap: int = ck.DEFAULT_CAP) -> Column:
    return F.when(count < ck.SMALL_CHUNK, F.lit("Too small")).when(
        count > cap, F.lit("Too large")
    )


def chunk_preview(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "doc_id",
        F.col("chunk_idx").alias("index"),
        "char_count",
        snippet(F.col("text"), ck.PREVIEW_CHARS).alias("preview"),
        F.col("text").alias("full_text"),
        chunk_warning(F.col("char_count")).alias("warning"),
    )


def _stats(cap: int) -> list[Column]:
    n = F.col("char_count")

    def count(test: Column) -> Column:
        return F.count(F.when(test, 1))

    return [
        F.count(n).alias("total_chunks"),
        F.coalesce(F.round(F.try_divide(F.sum(n), F.count(n)), 1), F.lit(0.0)).alias(
            "avg_chunk_length"
        ),
        F.coalesce(F.min(n), F.lit(0)).cast("bigint").alias("min_chunk_length"),
        F.coalesce(F.max(n), F.lit(0)).cast("bigint").alias("max_chunk_length"),
        count(n < ck.SOFT_MIN).alias("count_below_soft_min"),
        count(n > ck.WARN_ABOVE).alias("count_above_2500"),
        count(n < ck.SMALL_CHUNK).alias("count_small_chunks"),
        count(n > cap).alias("count_large_chunks"),
    ]


def chunk_stats(chunks: DataFrame, *by: str, cap: int = ck.DEFAULT_CAP) -> DataFrame:
    """Statistics of a chunk table by any columns; averages come from sums."""
    return chunks.groupBy(*by).agg(*_stats(cap))


def stats_rollup(chunks: DataFrame, cap: int = ck.DEFAULT_CAP) -> DataFrame:
    """Corpus, language and source levels at once."""
    return chunks.rollup("lang", "source").agg(*_stats(cap))


def document_stats(docs: DataFrame, cap: int | None = None) -> DataFrame:
    """Statistics per document, without a shuffle.

    The chunk lengths of a document are an array of its own row, so empty
    documents need no outer join either.
    """
    limit = ck.resolve_cap(cap)
    n = F.transform(ck.chunk_text(F.col("text"), cap=cap), lambda c: F.length(c))
    sized = docs.select("doc_id", n.alias("n"))

    def count(test) -> Column:
        return F.size(F.filter("n", test)).cast("bigint")

    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return sized.select(
        "doc_id",
        F.size("n").cast("bigint").alias("total_chunks"),
        F.coalesce(F.round(F.try_divide(total, F.size("n")), 1), F.lit(0.0)).alias(
            "avg_chunk_length"
        ),
        F.coalesce(F.array_min("n"), F.lit(0)).cast("bigint").alias("min_chunk_length"),
        F.coalesce(F.array_max("n"), F.lit(0)).cast("bigint").alias("max_chunk_length"),
        count(lambda x: x < ck.SOFT_MIN).alias("count_below_soft_min"),
        count(lambda x: x > ck.WARN_ABOVE).alias("count_above_2500"),
        count(lambda x: x < ck.SMALL_CHUNK).alias("count_small_chunks"),
        count(lambda x: x > limit).alias("count_large_chunks"),
    )
