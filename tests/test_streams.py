"""Streaming jobs over several micro-batches and restarts equal the batch view."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from narralake.operators import telemetry as tm
from narralake.operators.chunks import chunk_documents
from narralake.sources import tables as tb
from narralake.streaming import jobs
from narralake.streaming import pool_machine as machine
from narralake.streaming.store import Files, NewestRows


@pytest.fixture(scope="module")
def parts(spark, small, tmp_path_factory):
    """The event table as six files in event order."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = tb.read_table(spark, small, "events")
    for i in range(6):
        part = events.where(F.floor(F.col("event_id") * 6 / 1000) == i).coalesce(1)
        part.write.parquet(f"{folder}/tmp{i}")
        source = [f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet")][0]
        os.link(f"{folder}/tmp{i}/{source}", f"{folder}/events{i}.parquet")
    return folder


def _same(a, b):
    cols = sorted(a.columns)
    assert sorted(map(repr, a.select(*cols).collect())) == sorted(map(repr, b.select(*cols).collect()))


def _stream(spark, parts, per_batch=2):
    return jobs.stream_table(spark, parts, "events", per_batch)


@pytest.fixture(scope="module")
def shuffled(spark, small, tmp_path_factory):
    """The event table as four files that mix early and late events."""
    folder = str(tmp_path_factory.mktemp("shuffled"))
    events = tb.read_table(spark, small, "events")
    for i in range(4):
        part = events.where(F.pmod(F.hash("event_id"), F.lit(4)) == i).orderBy(F.desc("event_id")).coalesce(1)
        part.write.parquet(f"{folder}/tmp{i}")
        source = [f for f in os.listdir(f"{folder}/tmp{i}") if f.endswith(".parquet")][0]
        os.link(f"{folder}/tmp{i}/{source}", f"{folder}/events{i}.parquet")
    return folder


def _timed(events):
    return tb.attempts_from(events, F.col("ts").cast("timestamp").alias("ts"))


@pytest.mark.parametrize("order", ["parts", "shuffled"])
def test_pool_state(spark, small, tmp_path, request, order):
    root, folder = str(tmp_path), request.getfixturevalue(order)
    batch = tb.attempts(spark, small)
    for _ in range(2):  # the second start finds nothing new
        log = _timed(_stream(spark, folder, 1))
        jobs.pool_state_job(log, root, tb.TOKEN_NAMES, "60 days", 86_400 * 90).awaitTermination()
        assert len(jobs.pool_store(root).versions(spark)) == 3
    marks = jobs.pool_part(spark, root, "marks")
    _same(tm.board_from_marks(marks, tb.TOKEN_NAMES), tm.token_board(batch, tb.TOKEN_NAMES))
    _same(jobs.pool_part(spark, root, "switches"), tm.switch_history(batch))
    usage = jobs.pool_part(spark, root, "usage")
    _same(usage, tm.usage_history(batch, tm.KEPT_USAGE).select(*usage.columns))
    want = tm.pool_snapshot(
        tm.snapshot_marks(batch), tm.usage_history(batch, tm.KEPT_USAGE), tm.switch_history(batch), tb.TOKEN_NAMES, 100
    )
    _same(jobs.pool_snapshot(spark, root, tb.TOKEN_NAMES, 100), want)


ATTEMPT = (
    "run_id long, seq long, token string, chunk_id long, status string, epoch long, "
    "from_token string, to_token string, reason string, ts timestamp"
)


def _events(*rows):
    """(run, seq, token, status, day) as attempt rows."""
    start = datetime(2024, 1, 1)
    return [
        (run, seq, token, seq, status, seq, *(("a", token, "429") if status == "switched" else (None,) * 3), start + timedelta(days=day))
        for run, seq, token, status, day in rows
    ]


def test_state_of_a_run_goes_after_its_end(spark, tmp_path):
    """Two runs of two tokens; the first ends, and its four states of two tokens fall to two."""
    batches = [
        _events((1, 1, "a", "begin", 0), (1, 2, "a", "calling", 0), (1, 3, "b", "switched", 0), (1, 4, "b", "ended", 1)),
        _events((2, 5, "a", "begin", 1), (2, 6, "a", "quota_failed", 1)),
        _events((2, 7, "b", "calling", 9)),
        _events((2, 8, "b", "success", 9)),
        _events((2, 9, "b", "calling", 9)),
    ]
    folder, root = f"{tmp_path}/in", f"{tmp_path}/out"
    os.mkdir(folder)
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, ATTEMPT).coalesce(1)
        frame.write.parquet(f"{tmp_path}/tmp{i}")
        source = [f for f in os.listdir(f"{tmp_path}/tmp{i}") if f.endswith(".parquet")][0]
        os.link(f"{tmp_path}/tmp{i}/{source}", f"{folder}/events{i}.parquet")
        log = jobs.stream_table(spark, folder, "events")
        jobs.pool_state_job(log, root, ("a", "b"), "1 hour", 86_400).awaitTermination()
    states = jobs.pool_store(root).read(spark)
    assert {(r.run_id, r.token) for r in states.collect()} == {(1, "a"), (1, "b"), (2, "a"), (2, "b")}
    shown = {r.run_id: r for r in jobs.pool_snapshot(spark, root, ("a", "b"), 7).collect()}
    assert not shown[1].generation_active and shown[1].quota_failovers == 1
    assert shown[2].failed_tokens == ["a"] and shown[2].active_token_name == "b" and shown[2].current_chunk == 9
    assert [t.status for t in shown[2].tokens] == ["failed", "active"]
    # The state of the ended run is gone, that of the other run is there.
    live = spark.read.format("statestore").option("stateVarName", "marks").load(f"{root}/checkpoint")
    assert {(r.key.run_id, r.key.token) for r in live.select("key").collect()} == {(2, "a"), (2, "b")}


def test_token_states_merge_in_any_order():
    r = random.Random(1)
    statuses = ["begin", "ended", "synced", *tm.USAGE_STATES * 4]
    events = [
        {"seq": i, "status": r.choice(statuses), "chunk_id": i % 7, "epoch": i, "from_token": "x", "to_token": "y",
         "reason": "z", "ts": datetime(2024, 1, 1) + timedelta(minutes=i)}
        for i in range(300)
    ]
    whole = machine.TokenState()
    for e in events:
        whole.add(e)
    for _ in range(20):
        r.shuffle(events)
        parts = [machine.TokenState() for _ in range(5)]
        for i, e in enumerate(events):
            parts[i % 5].add(e)
        merged = machine.TokenState()
        for p in parts:
            merged.merge(p)
        assert merged.row(1, "t") == whole.row(1, "t")


# The stored table of newest rows


def _store(tmp_path, order=None, **sizes):
    schema = StructType.fromDDL("k string, seq bigint, v string")
    return NewestRows(f"{tmp_path}/store", schema, ("k",), order, **sizes)


def test_store_equals_the_newest_rows_and_stays_small(spark, tmp_path):
    store = _store(tmp_path, every=5, kept=3)
    want, r, files = {}, random.Random(4), Files(spark, store.root)
    for version in range(50):
        rows = {k: (k, version, f"v{version}") for k in r.sample(["a", "b", "c", "d", None], r.randrange(1, 4))}
        want |= rows
        batch = spark.createDataFrame(list(rows.values()), store.schema).coalesce(1)
        store.write(batch, version)
        if version % 7 == 0:  # repeated after its commit
            store.write(batch, version)
        assert len(files.names("commits")) <= 3 and len(files.names("base")) <= 3 and len(files.names("delta")) <= 13
        if version % 9 == 0 or version == 49:
            assert {tuple(x) for x in store.read(spark).collect()} == {*want.values()}


def test_store_readers_keep_their_version_during_compaction(spark, tmp_path):
    store = _store(tmp_path, every=2, kept=4)
    one = lambda k, n: spark.createDataFrame([(k, n, f"{k}{n}")], store.schema).coalesce(1)
    for version in range(6):
        store.write(one("ab"[version % 2], version), version)
        if version == 2:
            reader, seen = store.read(spark), {("a", 2, "a2"), ("b", 1, "b1")}
    # Three versions and two bases later the reader still finds its own.
    assert {tuple(r) for r in reader.collect()} == seen
    assert {tuple(r) for r in store.read(spark).collect()} == {("a", 4, "a4"), ("b", 5, "b5")}


def test_store_shows_no_unfinished_version(spark, tmp_path):
    store = _store(tmp_path)
    assert store.read(spark).count() == 0
    store.write(spark.createDataFrame([("a", 1, "x")], store.schema), 0)
    spark.createDataFrame([("a", 2, "lost")], store.schema).write.parquet(f"{store.root}/delta/{1:012d}")
    assert [r.v for r in store.read(spark).collect()] == ["x"]
    store.write(spark.createDataFrame([("a", 3, "y")], store.schema), 1)
    assert [r.v for r in store.read(spark).collect()] == ["y"]


def test_store_with_an_order_ignores_late_rows(spark, tmp_path):
    store = _store(tmp_path, "seq", every=2)
    for version, rows in enumerate(([("a", 5, "new"), ("a", 4, "x")], [("a", 3, "late"), ("b", 1, "b")], [("a", 5, "new")])):
        store.write(spark.createDataFrame(rows, store.schema), version)
        assert ("a", 5, "new") in {tuple(r) for r in store.read(spark).collect()}
    assert store.read(spark).count() == 2


def test_latest_status(spark, parts, small, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        log = tb.status_log_from(_stream(spark, parts, 1))
        jobs.latest_status_job(log, root, every=2).awaitTermination()
        _same(jobs.latest_status_view(log, root), tm.latest_status(tb.status_log(spark, small)))
    assert len(jobs.status_store(log, root).versions(spark)) == 3


def test_progress_restarts(spark, parts, small, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        jobs.progress_job(tb.attempts_from(_stream(spark, parts)), root).awaitTermination()
    want = (
        tb.attempts(spark, small).where("status = 'success'").select("run_id", "chunk_id").distinct()
        .groupBy("run_id").count().withColumnRenamed("count", "done")
    )
    _same(jobs.progress_view(spark, root, 100).select("run_id", "done"), want)


def test_progress_with_watermark(spark, parts, small, tmp_path):
    events = _stream(spark, parts)
    attempts = tb.attempts_from(events, "ts")
    attempts = attempts.withColumn("ts", F.col("ts").cast("timestamp"))
    root = str(tmp_path)
    jobs.progress_job(attempts, root, "60 days").awaitTermination()
    want = tb.attempts(spark, small).where("status = 'success'").select("run_id", "chunk_id").distinct()
    assert spark.read.parquet(f"{root}/table").count() == want.count()


def test_chunks_once(spark, small, tmp_path):
    root = str(tmp_path)
    for _ in range(2):
        docs = jobs.stream_table(spark, small, "documents").select("doc_id", "text")
        jobs.chunk_job(docs, root).awaitTermination()
    stored = jobs.chunk_view(spark, root)
    assert stored.count() == stored.select("doc_id", "chunk_idx").distinct().count() > 0


def test_stream_of_a_table_stored_as_a_folder(spark, small, tmp_path):
    docs = tb.read_table(spark, small, "documents").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/in/documents.parquet")
    docs.limit(1).write.parquet(f"{tmp_path}/in/pages.parquet")
    for _ in range(2):  # the second start finds nothing new
        found = jobs.stream_table(spark, f"{tmp_path}/in", "documents")
        jobs.chunk_job(found, f"{tmp_path}/out").awaitTermination()
    _same(jobs.chunk_view(spark, f"{tmp_path}/out"), chunk_documents(docs))


def test_a_fold_drops_old_entries_now_and_then_and_before_it_hands_on():
    state, n = machine.TokenState(), tm.KEPT_USAGE + 20
    for seq in random.Random(3).sample(range(n), n):
        state.add({"seq": seq, "chunk_id": 1, "status": "success", "epoch": seq})
    assert len(state.usage) == n
    assert [u["seq"] for u in state.row(1, "t")["usage"]] == list(range(20, n))
