"""Loudness, silence and discontinuities of sampled signals.

Input rows: ``series_id, chunk_idx, sample_idx (from 0), s, n_samples, rate`` where
``n_samples`` and ``rate`` are the length and the samples a second of the chunk,
as a file header states them.
Everything about a chunk comes from two partial aggregations (by window, then
by chunk); no chunk is ever held in one task.  ``boundaries`` reads its chunk
rows twice, so give it stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralake.operators.ordered import with_previous

# --- fixed values: thresholds -------------------------------------------------
SILENCE_RMS = 500
DISCONTINUITY_DELTA = 2500
FULL_SCALE = 32768.0
FLOOR_DBFS = -90.0
WINDOW_MS = 10
BOUNDARY_MS = 100
MAX_SILENCE, MAX_VARIANCE, MAX_VARIATION = 0.25, 12, 35
# -----------------------------------------------------------------------------

CHUNK = ["series_id", "chunk_idx"]


def first_channel(samples: DataFrame, channels: int) -> DataFrame:
    """Keep channel 0 of interleaved samples and renumber the rest."""
    return (
        samples.where(F.col("sample_idx") % channels == 0)
        .withColumn("sample_idx", (F.col("sample_idx") / channels).cast("bigint"))
        .withColumn("n_samples", F.ceil(F.col("n_samples") / channels).cast("bigint"))
    )


def window_samples(rate: Column, ms: int) -> Column:
    """Samples in so many milliseconds; at least one."""
    return F.greatest(F.lit(1), F.floor(rate * ms / 1000)).cast("bigint")


def rms(sum_of_squares: Column, count: Column) -> Column:
    """Root mean square; 0 for nothing."""
    return F.when(count > 0, F.sqrt(sum_of_squares / count)).otherwise(F.lit(0.0))


def loudness_dbfs(level: Column) -> Column:
    return F.when(level <= 0, F.lit(FLOOR_DBFS)).otherwise(
        F.lit(20.0) * F.log10(level / FULL_SCALE)
    )


def duration_ms(count: Column, rate: Column | int) -> Column:
    r = rate if isinstance(rate, Column) else F.lit(rate)
    return F.when(r > 0, F.floor(count * 1000 / r)).otherwise(F.lit(0)).cast("bigint")


def chunk_signal(samples: DataFrame, window: int | Column, boundary: int | Column) -> DataFrame:
    """One row per chunk: level, loudness, silence share and boundary levels.

    ``window`` and ``boundary`` are sample counts, the same for all rows of a chunk.
    """
    square = F.col("s").cast("bigint") * F.col("s")
    head = F.col("sample_idx") < boundary
    tail = F.col("sample_idx") >= F.col("n_samples") - boundary
    windows = (
        samples.withColumn("_w", F.floor(F.col("sample_idx") / window).cast("bigint"))
        .groupBy(*CHUNK, "_w")
        .agg(
            F.sum(square).alias("sq"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.when(head, square)).alias("head_sq"),
            F.count(F.when(head, 1)).alias("head_n"),
            F.sum(F.when(tail, square)).alias("tail_sq"),
            F.count(F.when(tail, 1)).alias("tail_n"),
        )
    )
    quiet = F.when(rms(F.col("sq"), F.col("n")) <= SILENCE_RMS, 1.0).otherwise(0.0)
    sums = windows.groupBy(*CHUNK).agg(
        F.sum("n").alias("n_samples"),
        F.sum("sq").alias("sq"),
        F.avg(quiet).alias("silence_ratio"),
        F.sum("head_sq").alias("head_sq"),
        F.sum("head_n").alias("head_n"),
        F.sum("tail_sq").alias("tail_sq"),
        F.sum("tail_n").alias("tail_n"),
    )
    return sums.select(
        *CHUNK,
        "n_samples",
        rms(F.col("sq"), F.col("n_samples")).alias("rms"),
        "silence_ratio",
        rms(F.col("head_sq"), F.col("head_n")).alias("head_rms"),
        rms(F.col("tail_sq"), F.col("tail_n")).alias("tail_rms"),
    ).withColumn("loudness_dbfs", loudness_dbfs(F.col("rms")))


def with_empty_chunks(chunks: DataFrame, headers: DataFrame) -> DataFrame:
    """chunk_signal rows and one for each header of a chunk that has no samples.

    ``headers``: series_id and chunk_idx of every chunk file that could be
    read.  A chunk of no samples is silent throughout (ratio 1.0), of level 0
    at its middle and ends, and at the floor of loudness.
    """
    silent = headers.select(*CHUNK).distinct().join(chunks.select(*CHUNK), CHUNK, "left_anti")
    zero = F.lit(0.0)
    return chunks.unionByName(
        silent.select(
            *CHUNK,
            F.lit(0).cast("bigint").alias("n_samples"),
            zero.alias("rms"),
            F.lit(1.0).alias("silence_ratio"),
            zero.alias("head_rms"),
            zero.alias("tail_rms"),
            loudness_dbfs(zero).alias("loudness_dbfs"),
        )
    )


def is_discontinuity(tail: Column, head: Column) -> Column:
    """A jump in level, or silence on one side only."""
    return (F.abs(tail - head) >= DISCONTINUITY_DELTA) | (
        (tail <= SILENCE_RMS) != (head <= SILENCE_RMS)
    )


def boundaries(chunks: DataFrame) -> DataFrame:
    """Chunk rows with the surviving chunk before them and the jump between."""
    before = F.struct("chunk_idx", "tail_rms", "loudness_dbfs")
    return (
        with_previous(chunks, ["series_id"], "chunk_idx", before, "prev")
        .withColumn(
            "discontinuity",
            F.coalesce(is_discontinuity(F.col("prev.tail_rms"), F.col("head_rms")), F.lit(False)),
        )
        .withColumn(
            "loudness_step", F.abs(F.col("loudness_dbfs") - F.col("prev.loudness_dbfs"))
        )
    )


def variation_score(mean_step: Column) -> Column:
    return F.least(F.lit(100.0), F.coalesce(mean_step, F.lit(0.0)) * 4.0)


def signal_label(silence: Column, jumps: Column, variance: Column, score: Column) -> Column:
    issues = (
        (silence > MAX_SILENCE).cast("int")
        + (jumps > 0).cast("int")
        + (variance > MAX_VARIANCE).cast("int")
        + (score > MAX_VARIATION).cast("int")
    )
    return (
        F.when(issues == 0, F.lit("good"))
        .when(issues <= 2, F.lit("fair"))
        .otherwise(F.lit("needs_review"))
    )


def chunk_levels(samples: DataFrame) -> DataFrame:
    """Chunk rows with the fixed windows, by the ``rate`` of each chunk."""
    rate = F.col("rate")
    return chunk_signal(samples, window_samples(rate, WINDOW_MS), window_samples(rate, BOUNDARY_MS))


def loudness_variance(chunks: DataFrame) -> DataFrame:
    """Variance of the chunk levels per series; needs no look-back."""
    return chunks.groupBy("series_id").agg(
        F.coalesce(F.var_pop("loudness_dbfs"), F.lit(0.0)).alias("variance")
    )


def series_metrics(chunks: DataFrame) -> DataFrame:
    """Unrounded metrics per series."""
    return (
        boundaries(chunks)
        .groupBy("series_id")
        .agg(
            F.count(F.lit(1)).alias("chunk_count"),
            F.avg("silence_ratio").alias("silence"),
            F.count_if("discontinuity").alias("jumps"),
            F.coalesce(F.var_pop("loudness_dbfs"), F.lit(0.0)).alias("variance"),
            variation_score(F.avg("loudness_step")).alias("score"),
        )
    )


def signal_report(series: DataFrame, chunks: DataFrame) -> DataFrame:
    """One report row per series; a series without chunks is ``unknown``.

    The per-chunk lists of the report are the rows of ``chunks`` themselves, so
    that no series has to fit into one array.
    """
    m = series.join(series_metrics(chunks), "series_id", "left")
    label = signal_label(F.col("silence"), F.col("jumps"), F.col("variance"), F.col("score"))
    zero = F.lit(0.0)
    return m.select(
        "series_id",
        F.coalesce("chunk_count", F.lit(0)).cast("bigint").alias("chunk_count"),
        F.coalesce(F.round("silence", 4), zero).alias("avg_chunk_silence_ratio"),
        F.coalesce("jumps", F.lit(0)).cast("bigint").alias("discontinuities_count"),
        F.coalesce(F.round("variance", 2), zero).alias("loudness_variance"),
        F.coalesce(F.round("score", 1), zero).alias("chunk_variation_score"),
        F.when(F.col("chunk_count").isNull(), F.lit("unknown")).otherwise(label).alias(
            "quality_label"
        ),
    )
