"""Queries of the signal-quality operators, with their checks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from narralake.operators import signal as sg
from narralake.plans.views_sql import SAMPLES, with_
from narralake.sources import tables as tb

CHUNK = sg.CHUNK


def _chunks(spark, sf_dir):
    return sg.chunk_levels(tb.samples(spark, sf_dir))


def _stored_chunks(spark, sf_dir):
    """Chunk rows written once, for what reads them more than once."""
    folder = os.path.join(tb.scratch_dir(spark, "signal"), "chunks")
    _chunks(spark, sf_dir).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def scan_samples(spark, sf_dir):
    """Stereo reading of the samples: the first channel, renumbered."""
    return sg.first_channel(tb.samples(spark, sf_dir), 2).drop("rate")


def rms(spark, sf_dir):
    return _chunks(spark, sf_dir).select(*CHUNK, F.round("rms", 6).alias("rms"))


def loudness_dbfs(spark, sf_dir):
    return _chunks(spark, sf_dir).select(*CHUNK, F.round("loudness_dbfs", 6).alias("loudness_dbfs"))


def silence_ratio(spark, sf_dir):
    return _chunks(spark, sf_dir).select(*CHUNK, F.round("silence_ratio", 6).alias("silence_ratio"))


def boundary_rms(spark, sf_dir):
    return _chunks(spark, sf_dir).select(
        *CHUNK, F.round("head_rms", 6).alias("head_rms"), F.round("tail_rms", 6).alias("tail_rms")
    )


def discontinuities(spark, sf_dir):
    return sg.boundaries(_stored_chunks(spark, sf_dir)).select(
        *CHUNK, F.col("prev.chunk_idx").alias("previous_chunk"), "discontinuity"
    )


def loudness_variance(spark, sf_dir):
    variance = F.round("variance", 6).alias("loudness_variance")
    return sg.loudness_variance(_chunks(spark, sf_dir)).select("series_id", variance)


def variation_score(spark, sf_dir):
    metrics = sg.series_metrics(_stored_chunks(spark, sf_dir))
    return metrics.select("series_id", F.round("score", 6).alias("variation_score"))


def signal_label(spark, sf_dir):
    m = sg.series_metrics(_stored_chunks(spark, sf_dir))
    label = sg.signal_label(F.col("silence"), F.col("jumps"), F.col("variance"), F.col("score"))
    return m.select("series_id", label.alias("quality_label"))


def signal_report(spark, sf_dir):
    """Reports for all users' series and for as many that have no samples."""
    users = tb.read_table(spark, sf_dir, "events").select("user_id").distinct()
    series = users.select((F.col("user_id") % 40).alias("series_id")).distinct()
    return sg.signal_report(series, _stored_chunks(spark, sf_dir))


def chunk_duration_ms(spark, sf_dir):
    sizes = tb.samples(spark, sf_dir).groupBy(*CHUNK).agg(
        F.count(F.lit(1)).alias("n"), F.max("rate").alias("rate")
    )
    return sizes.select(*CHUNK, sg.duration_ms(F.col("n"), F.col("rate")).alias("duration_ms"))


def chunk_headers(spark, sf_dir):
    """Header table of the chunk files: those with samples, and some that hold none."""
    raw = tb.raw_samples(spark, sf_dir).select(*CHUNK, "event_id")
    empty = raw.where(F.col("event_id") % 9 == 0).withColumn("chunk_idx", F.col("chunk_idx") + 40)
    return raw.unionByName(empty).select(*CHUNK).distinct()


def empty_chunk_report(spark, sf_dir):
    """The report over all readable chunks, those without samples included."""
    folder = os.path.join(tb.scratch_dir(spark, "signal"), "chunks")
    whole = sg.with_empty_chunks(_stored_chunks(spark, sf_dir), chunk_headers(spark, sf_dir))
    whole.write.mode("overwrite").parquet(folder)
    series = tb.read_table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("series_id")).distinct()
    return sg.signal_report(series, spark.read.parquet(folder))


QUERIES = {
    "scan_samples": scan_samples,
    "rms": rms,
    "loudness_dbfs": loudness_dbfs,
    "silence_ratio": silence_ratio,
    "boundary_rms": boundary_rms,
    "discontinuities": discontinuities,
    "loudness_variance": loudness_variance,
    "variation_score": variation_score,
    "signal_label": signal_label,
    "signal_report": signal_report,
    "empty_chunk_report": empty_chunk_report,
    "chunk_duration_ms": chunk_duration_ms,
}

# ----------------------------------------------------------------- SQL side --
_CHUNKS = with_(
    SAMPLES,
    """ch AS (SELECT series_id, chunk_idx, count(*) AS n, max(rate) AS rate, sqrt(avg(CAST(s AS BIGINT) * s)) AS rms,
  sqrt(avg(CAST(s AS BIGINT) * s) FILTER (sample_idx < rate * 100 // 1000)) AS head_rms,
  sqrt(avg(CAST(s AS BIGINT) * s) FILTER (sample_idx >= n_samples - rate * 100 // 1000)) AS tail_rms
  FROM samples GROUP BY series_id, chunk_idx)""",
    """win AS (SELECT series_id, chunk_idx, avg(CASE WHEN r <= 500 THEN 1.0 ELSE 0.0 END) AS silence FROM (
    SELECT series_id, chunk_idx, sqrt(avg(CAST(s AS BIGINT) * s)) AS r
    FROM samples GROUP BY series_id, chunk_idx, sample_idx // (rate * 10 // 1000))
  GROUP BY series_id, chunk_idx)""",
    """lv AS (SELECT ch.*, silence,
  CASE WHEN rms <= 0 THEN -90.0 ELSE 20 * log10(rms / 32768) END AS loud
  FROM ch JOIN win USING (series_id, chunk_idx))""",
    """bd AS (SELECT *, lag(chunk_idx) OVER w AS previous_chunk, abs(loud - lag(loud) OVER w) AS step,
  coalesce(abs(lag(tail_rms) OVER w - head_rms) >= 2500
           OR (lag(tail_rms) OVER w <= 500) <> (head_rms <= 500), false) AS discontinuity
  FROM lv WINDOW w AS (PARTITION BY series_id ORDER BY chunk_idx))""",
    """se AS (SELECT series_id, count(*) AS n, avg(silence) AS silence,
  count(*) FILTER (discontinuity) AS jumps, var_pop(loud) AS variance,
  least(100.0, coalesce(avg(step), 0) * 4) AS score FROM bd GROUP BY series_id)""",
    """lb AS (SELECT *, CASE CAST(silence > 0.25 AS INT) + CAST(jumps > 0 AS INT) + CAST(variance > 12 AS INT)
    + CAST(score > 35 AS INT) WHEN 0 THEN 'good' WHEN 1 THEN 'fair' WHEN 2 THEN 'fair'
    ELSE 'needs_review' END AS label FROM se)""",
)

_EMPTY = """lv AS (SELECT * FROM full_lv UNION ALL
  SELECT series_id, chunk_idx, 0, 0, 0.0, 0.0, 0.0, 1.0, -90.0 FROM (
    SELECT DISTINCT user_id % 20 AS series_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 40 AS chunk_idx
    FROM events WHERE event_id % 9 = 0) h
  WHERE NOT EXISTS (SELECT 1 FROM full_lv f WHERE f.series_id = h.series_id AND f.chunk_idx = h.chunk_idx)),
bd AS ("""

ORACLES = {
    "scan_samples": with_(SAMPLES) + """SELECT series_id, chunk_idx, sample_idx // 2 AS sample_idx, s,
  (n_samples + 1) // 2 AS n_samples FROM samples WHERE sample_idx % 2 = 0""",
    "rms": _CHUNKS + "SELECT series_id, chunk_idx, round(rms, 6) AS rms FROM lv",
    "loudness_dbfs": _CHUNKS
    + "SELECT series_id, chunk_idx, round(loud, 6) AS loudness_dbfs FROM lv",
    "silence_ratio": _CHUNKS
    + "SELECT series_id, chunk_idx, round(silence, 6) AS silence_ratio FROM lv",
    "boundary_rms": _CHUNKS + """SELECT series_id, chunk_idx, round(head_rms, 6) AS head_rms,
  round(tail_rms, 6) AS tail_rms FROM lv""",
    "discontinuities": _CHUNKS
    + "SELECT series_id, chunk_idx, previous_chunk, discontinuity FROM bd",
    "loudness_variance": _CHUNKS
    + "SELECT series_id, round(variance, 6) AS loudness_variance FROM se",
    "variation_score": _CHUNKS + "SELECT series_id, round(score, 6) AS variation_score FROM se",
    "signal_label": _CHUNKS + "SELECT series_id, label AS quality_label FROM lb",
    "signal_report": _CHUNKS + """SELECT x.series_id, coalesce(n, 0) AS chunk_count,
  coalesce(round(silence, 4), 0.0) AS avg_chunk_silence_ratio,
  coalesce(jumps, 0) AS discontinuities_count,
  coalesce(round(variance, 2), 0.0) AS loudness_variance,
  coalesce(round(score, 1), 0.0) AS chunk_variation_score, coalesce(label, 'unknown') AS quality_label
FROM (SELECT DISTINCT user_id % 40 AS series_id FROM events) x LEFT JOIN lb ON x.series_id = lb.series_id""",
    "chunk_duration_ms": _CHUNKS
    + "SELECT series_id, chunk_idx, CAST(n * 1000 // rate AS BIGINT) AS duration_ms FROM ch",
}
ORACLES["empty_chunk_report"] = (
    ORACLES["signal_report"].replace("lv AS (", "full_lv AS (", 1).replace("bd AS (", _EMPTY, 1)
)
