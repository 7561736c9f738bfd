"""Queries of the streaming jobs; each runs to the end of its input."""

from __future__ import annotations

from pyspark.sql import functions as F

from narralake.operators import telemetry as tm
from narralake.operators.changes import content_manifest, differences
from narralake.operators.ordered import newest_per_key
from narralake.plans import chunks, runs
from narralake.plans.views_sql import ATTEMPTS, with_
from narralake.sources import tables as tb
from narralake.streaming import jobs
from narralake.streaming.corpus import ChunkedCorpus

def _attempt_stream(spark, sf_dir, *keep):
    return tb.attempts_from(jobs.stream_table(spark, sf_dir, "events"), *keep)


#: Folders of finished pool jobs by application and input; all views read one job's state.
_POOLS: dict[tuple[str, str], str] = {}


def _pool_root(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _POOLS:
        root = tb.scratch_dir(spark, "pool")
        log = _attempt_stream(spark, sf_dir, F.col("ts").cast("timestamp").alias("ts"))
        jobs.pool_state_job(log, root, tb.TOKEN_NAMES).awaitTermination()
        _POOLS[key] = root
    return _POOLS[key]


def stream_pool_state(spark, sf_dir):
    """Token board out of the streamed marks."""
    return tm.board_from_marks(jobs.pool_part(spark, _pool_root(spark, sf_dir), "marks"), tb.TOKEN_NAMES)


def stream_usage_history(spark, sf_dir):
    kept = jobs.pool_part(spark, _pool_root(spark, sf_dir), "usage")
    return newest_per_key(kept, ["run_id"], "seq", tm.SHOWN_USAGE)


def stream_switch_history(spark, sf_dir):
    return jobs.pool_part(spark, _pool_root(spark, sf_dir), "switches")


def stream_pool_snapshot(spark, sf_dir):
    """The whole snapshot of each run, out of the streamed state."""
    root = _pool_root(spark, sf_dir)
    return runs.flat_snapshot(jobs.pool_snapshot(spark, root, tb.TOKEN_NAMES, runs.CHUNKS_PER_RUN))


def stream_latest_status(spark, sf_dir):
    root = tb.scratch_dir(spark, "status")
    log = tb.status_log_from(jobs.stream_table(spark, sf_dir, "events"))
    jobs.latest_status_job(log, root).awaitTermination()
    return jobs.latest_status_view(log, root)


def stream_progress(spark, sf_dir):
    root = tb.scratch_dir(spark, "progress")
    log = _attempt_stream(spark, sf_dir, F.col("ts").cast("timestamp").alias("ts"))
    jobs.progress_job(log, root, "1 day").awaitTermination()
    return jobs.progress_view(spark, root, runs.CHUNKS_PER_RUN)


def incremental_chunks(spark, sf_dir):
    """Chunks of the documents, streamed in; a second start finds nothing new."""
    root = tb.scratch_dir(spark, "incremental")
    for _ in range(2):
        docs = jobs.stream_table(spark, sf_dir, "documents").select(
            "doc_id", tb.paragraphed(F.col("text")).alias("text")
        )
        jobs.chunk_job(docs, root).awaitTermination()
    return jobs.chunk_view(spark, root).select("doc_id", "chunk_idx", "text")


def _edited(docs):
    """The documents some time later: some are gone, some have one more sentence."""
    more = F.concat(F.col("text"), F.lit("\n\nOne more sentence."))
    text = F.when(F.col("doc_id") % 7 == 0, more).otherwise(F.col("text"))
    return docs.where(F.col("doc_id") % 11 != 0).withColumn("text", text)


def _before_and_after(spark, sf_dir):
    docs = tb.documents(spark, sf_dir).select("doc_id", "text")
    shaped = lambda df: df.withColumn("text", tb.paragraphed(F.col("text")))
    return shaped(docs), shaped(_edited(docs))


def corpus_changes(spark, sf_dir):
    """Which documents differ after the edits, and how."""
    before, after = (content_manifest(df, "doc_id", "text") for df in _before_and_after(spark, sf_dir))
    return differences(before, after, "doc_id")


def refreshed_chunks(spark, sf_dir):
    """Chunks of all documents, brought up to the edits by chunking only what differs."""
    corpus = ChunkedCorpus(tb.scratch_dir(spark, "corpus"))
    for docs in _before_and_after(spark, sf_dir):
        corpus.refresh(docs)
    return corpus.read(spark).select("doc_id", "chunk_idx", "text")


_EDITED = """(SELECT doc_id, lang, source,
  CASE WHEN doc_id % 7 = 0 THEN text || chr(10) || chr(10) || 'One more sentence.' ELSE text END AS text
  FROM documents WHERE doc_id % 11 <> 0) AS documents"""

QUERIES = {
    "stream_pool_state": stream_pool_state,
    "stream_usage_history": stream_usage_history,
    "stream_switch_history": stream_switch_history,
    "stream_pool_snapshot": stream_pool_snapshot,
    "stream_latest_status": stream_latest_status,
    "stream_progress": stream_progress,
    "incremental_chunks": incremental_chunks,
    "corpus_changes": corpus_changes,
    "refreshed_chunks": refreshed_chunks,
}

ORACLES = {
    "stream_pool_state": runs.ORACLES["token_board"],
    "stream_usage_history": runs.ORACLES["usage_history"],
    "stream_switch_history": runs.ORACLES["switch_history"],
    "stream_pool_snapshot": runs.ORACLES["pool_snapshot"],
    "stream_latest_status": runs.ORACLES["latest_status"],
    "stream_progress": with_(ATTEMPTS) + f"""
SELECT run_id, count(DISTINCT chunk_id) AS done, CAST({runs.CHUNKS_PER_RUN} AS BIGINT) AS total,
  round(count(DISTINCT chunk_id) / {runs.CHUNKS_PER_RUN} * 100, 1) AS progress_percent
FROM attempts WHERE status = 'success' GROUP BY run_id""",
    "incremental_chunks": chunks.ORACLES["chunk_corpus"],
    "corpus_changes": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' ELSE 'changed' END AS change
FROM documents WHERE doc_id % 11 = 0 OR (doc_id % 7 = 0 AND text IS NOT NULL)""",
    "refreshed_chunks": chunks.ORACLES["chunk_corpus"].replace("FROM documents", f"FROM {_EDITED}"),
}
