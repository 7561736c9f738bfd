"""The run telemetry and chunking as Structured Streaming jobs.

Every job ends in a stored table that an ordinary batch query reads, so a view
of the live state is the same code as the batch operators.  All jobs restart
from their checkpoint; outputs are written under the micro-batch number or by
the file sink, so a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import _parse_datatype_string

from narralake.operators import telemetry as tm
from narralake.operators.chunks import chunk_documents
from narralake.operators.ordered import newest_per_key
from narralake.session import ship
from narralake.streaming import pool_machine as machine
from narralake.streaming.store import NewestRows


def stream_table(
    spark: SparkSession, folder: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """One table in a folder as a stream: parquet files, or folders of them, whose names begin with its name."""
    paths = f"{folder.rstrip('/')}/{name}*.parquet"
    reader = spark.readStream.schema(spark.read.parquet(paths).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(paths)


def _run(writer, root: str, on_batch: Callable | None = None) -> StreamingQuery:
    writer = writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if on_batch:
        return writer.foreachBatch(on_batch).start()
    return writer.format("parquet").option("path", f"{root}/table").start()


# -------------------------------------------------------------- pool state ---
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _start_with_keyed_state(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query whose state has several variables, which only this store keeps."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def pool_store(root: str) -> NewestRows:
    return NewestRows(f"{root}/state", _parse_datatype_string(machine.STATE), ("run_id", "token"))


def pool_state_job(
    attempts: DataFrame,
    root: str,
    token_names: Sequence[str],
    delay: str = "1 day",
    retention_seconds: int = 86_400,
) -> StreamingQuery:
    """One job for all views of the pool: the state of each run and token, kept in a stored table.

    ``attempts`` is an attempt log with its time ``ts``.  Events later than
    ``delay`` are dropped, and a run's streaming state goes ``retention_seconds``
    after its end; its last row stays in the stored table.
    """
    spark = attempts.sparkSession
    ship(spark)
    store = pool_store(root)
    states = machine.token_states(attempts, token_names, delay, retention_seconds)
    return _start_with_keyed_state(
        spark, lambda: _run(states.writeStream.outputMode("update"), root, store.write)
    )


def pool_part(spark: SparkSession, root: str, part: str) -> DataFrame:
    """marks, or the usage or switches of all runs since their last begin, in the newest version."""
    states = pool_store(root).read(spark)
    marks = states.drop("usage", "switches")
    if part == "marks":
        return marks
    rows = states.select("run_id", "token", F.explode(part).alias("e"))
    if part == "usage":
        entries, size = rows.select("run_id", "token", "e.*"), tm.KEPT_USAGE
    else:
        entries, size = rows.select("run_id", "e.*"), tm.KEPT_SWITCHES
    return newest_per_key(tm.since_begin(entries, tm.run_begins(marks)), ["run_id"], "seq", size)


def pool_snapshot(spark: SparkSession, root: str, token_names: Sequence[str], total_chunks: int) -> DataFrame:
    parts = (pool_part(spark, root, part) for part in ("marks", "usage", "switches"))
    return tm.pool_snapshot(*parts, token_names, total_chunks)


# ------------------------------------------------------------ latest status --
def status_store(log: DataFrame, root: str, **sizes: int) -> NewestRows:
    return NewestRows(f"{root}/status", log.schema, ("intake_id",), "seq", **sizes)


def latest_status_job(log: DataFrame, root: str, **sizes: int) -> StreamingQuery:
    """Newest record per intake, in a stored table that is folded now and then.

    A batch needs no memory of earlier ones, because the record with the
    greatest ``seq`` is the newest whichever batch brought it.
    """
    return _run(log.writeStream, root, status_store(log, root, **sizes).write)


def latest_status_view(log: DataFrame, root: str) -> DataFrame:
    return status_store(log, root).read(log.sparkSession).select(*log.columns)


# ----------------------------------------------------------------- progress --
def progress_job(attempts: DataFrame, root: str, watermark: str | None = None) -> StreamingQuery:
    """Store each finished chunk of a run once.

    State is keyed by run and chunk, so it spreads however large a run is.  With
    a watermark on ``ts`` the state of old chunks expires.
    """
    done = attempts.where(F.col("status") == "success")
    keys = ["run_id", "chunk_id"]
    if watermark:
        once = done.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)
    else:
        once = done.dropDuplicates(keys)
    return _run(once.select(*keys).writeStream.outputMode("append"), root)


def progress_view(spark: SparkSession, root: str, total: int) -> DataFrame:
    stored = spark.read.schema("run_id bigint, chunk_id bigint").parquet(f"{root}/table")
    done = stored.distinct().groupBy("run_id").agg(F.count(F.lit(1)).alias("done"))
    return done.select(
        "run_id",
        "done",
        F.lit(total).cast("bigint").alias("total"),
        tm.progress_percent(F.col("done"), F.lit(total)).alias("progress_percent"),
    )


# ------------------------------------------------------- incremental chunks --
def chunk_job(docs: DataFrame, root: str) -> StreamingQuery:
    """Chunk documents as they arrive; finished ones are not done again."""
    return _run(chunk_documents(docs).writeStream.outputMode("append"), root)


def chunk_view(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/table")
