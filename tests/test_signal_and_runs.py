"""Literal cases of signals, telemetry, tokens and ordered helpers."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from narralake.operators import ordered as od
from narralake.operators import signal as sg
from narralake.operators import telemetry as tm
from narralake.operators import tokens as tk
from narralake.plans.registry import queries

QUERIES = queries()


def _samples(spark, chunks):
    rows = [
        (series, chunk, i, s, len(values))
        for (series, chunk), values in chunks.items()
        for i, s in enumerate(values)
    ]
    return spark.createDataFrame(
        rows, "series_id bigint, chunk_idx bigint, sample_idx bigint, s int, n_samples bigint"
    )


def test_signal_report(spark):
    loud, quiet = [8000] * 8, [0] * 8
    samples = _samples(spark, {(1, 1): loud, (1, 3): quiet, (1, 4): loud, (2, 1): loud})
    chunks = sg.chunk_signal(samples, 4, 2)
    got = {(r["series_id"], r["chunk_idx"]): r for r in chunks.collect()}
    assert got[1, 3]["loudness_dbfs"] == -90.0 and got[1, 3]["silence_ratio"] == 1.0
    assert got[1, 1]["rms"] == got[1, 1]["tail_rms"] == 8000.0
    series = spark.createDataFrame([(1,), (2,), (3,)], "series_id bigint")
    report = {r["series_id"]: r for r in sg.signal_report(series, chunks).collect()}
    assert report[1]["discontinuities_count"] == 2 and report[1]["quality_label"] == "needs_review"
    assert report[1]["avg_chunk_silence_ratio"] == 0.3333
    assert report[2]["quality_label"] == "good" and report[2]["loudness_variance"] == 0.0
    assert report[3]["quality_label"] == "unknown" and report[3]["chunk_count"] == 0


def test_boundary_window_longer_than_chunk(spark):
    chunks = sg.chunk_signal(_samples(spark, {(1, 1): [3, 4]}), 10, 100).first()
    assert round(chunks["head_rms"], 6) == round(chunks["tail_rms"], 6) == round(12.5**0.5, 6)


def test_scores_and_labels(spark):
    def label(*args):
        return spark.range(1).select(sg.signal_label(*[F.lit(a) for a in args]).alias("l")).first()["l"]

    assert label(0.05, 0, 4.0, 10.0) == "good"
    assert label(0.4, 5, 4.0, 10.0) == "fair"
    assert label(0.4, 5, 20.0, 50.0) == "needs_review"
    score = spark.range(1).select(
        sg.variation_score(F.lit(2.5)).alias("a"), sg.variation_score(F.lit(90.0)).alias("b"),
        sg.variation_score(F.lit(None).cast("double")).alias("c"), sg.duration_ms(F.lit(2401), 24000).alias("d"),
        sg.duration_ms(F.lit(5), 0).alias("e"),
    ).first()
    assert tuple(score) == (10.0, 100.0, 0.0, 100, 0)


def test_first_channel(spark):
    out = sg.first_channel(_samples(spark, {(1, 1): [1, 9, 2, 9, 3]}), 2).orderBy("sample_idx").collect()
    assert [(r["sample_idx"], r["s"], r["n_samples"]) for r in out] == [(0, 1, 3), (1, 2, 3), (2, 3, 3)]


def test_ordered_helpers_equal_plain_windows(spark):
    rng = random.Random(5)
    rows = [(0 if rng.random() < 0.5 else rng.randint(1, 4), o, rng.choice([None, "a", "b"]))
            for o in rng.sample(range(2000), 700)]
    df = spark.createDataFrame(rows, "k bigint, o bigint, v string")
    w = Window.partitionBy("k").orderBy("o")
    want = df.withColumn("p", F.lag(F.struct("v", "o")).over(w)).withColumn("n", F.row_number().over(w)).withColumn(
        "t", F.count(F.lit(1)).over(Window.partitionBy("k"))
    )
    for block in (7, 64, 100000):
        got = od.with_row_number(
            od.with_previous(df, ["k"], "o", F.struct("v", "o"), "p", block), ["k"], "o", "n", "t", block
        )
        cols = ["k", "o", "v", "p.v", "p.o", "n", "t"]
        assert sorted(map(repr, got.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))


def test_newest_per_key_cuts_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    top = od.newest_per_key(df, ["k"], "o", 5)
    assert top.count() == 15 and top.agg(F.min("o")).first()[0] == 985
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


EVENTS = [
    (1, "alpha", 3, "calling"),
    (2, "alpha", 3, "quota_failed"),
    (3, "beta", 3, "switched"),
    (4, "beta", 3, "success"),
]
SCHEMA = "seq bigint, token string, chunk_id bigint, status string"


def _run(spark, events, run=1):
    switched = F.col("status") == "switched"
    return spark.createDataFrame(events, SCHEMA).select(
        F.lit(run).cast("bigint").alias("run_id"),
        "*",
        F.col("seq").alias("epoch"),
        F.when(switched, F.lit("alpha")).alias("from_token"),
        F.when(switched, F.col("token")).alias("to_token"),
        F.when(switched, F.lit("429_quota")).alias("reason"),
    )


def _board(spark, events):
    rows = tm.token_board(_run(spark, events), ["alpha", "beta", "gamma"]).orderBy("priority").collect()
    return [r["status"] for r in rows]


def test_token_board(spark):
    assert _board(spark, EVENTS) == ["failed", "active", "idle"]
    assert _board(spark, EVENTS + [(5, "alpha", 4, "success")]) == ["idle", "active", "idle"]
    assert _board(spark, EVENTS + [(5, "beta", 4, "waiting")]) == ["waiting"] * 3
    # A plain call does not end a wait, a switch does.
    assert _board(spark, EVENTS + [(5, "beta", 4, "waiting"), (6, "beta", 4, "calling")]) == ["waiting"] * 3
    assert _board(spark, EVENTS + [(5, "beta", 4, "waiting"), (6, "gamma", 4, "switched")]) == [
        "failed", "idle", "active"]
    assert _board(spark, EVENTS + [(5, "beta", 4, "ended")]) == ["failed", "idle", "idle"]


def test_first_switch_counts(spark):
    run = _run(spark, EVENTS)
    [switch] = tm.switch_history(run).collect()
    assert (switch["from_token"], switch["to_token"], switch["reason"]) == ("alpha", "beta", "429_quota")
    assert tm.failover_counts(run).first()["quota_failovers"] == 1
    assert tm.failover_counts(_run(spark, EVENTS[:2])).first()["quota_failovers"] == 0


def test_begin_sync_and_end(spark):
    synced = EVENTS + [(5, "gamma", 3, "synced")]
    assert _board(spark, synced) == ["failed", "idle", "active"]
    assert [r["status"] for r in tm.usage_history(_run(spark, synced)).orderBy("seq").collect()] == [
        e[3] for e in EVENTS]
    # A second begin clears failures, histories and the active token.
    again = synced + [(6, "gamma", 3, "ended"), (7, "alpha", 0, "begin")]
    assert _board(spark, again) == ["active", "idle", "idle"]
    assert tm.usage_history(_run(spark, again)).count() == 0
    assert tm.failed_tokens(tm.token_marks(_run(spark, again))).count() == 0
    assert _board(spark, again + [(8, "beta", 1, "calling"), (9, "beta", 1, "ended")]) == ["idle"] * 3


def test_histories_are_capped(spark):
    events = [(i, "alpha" if i % 2 else "beta", i, "switched") for i in range(60)]
    run = _run(spark, events)
    assert tm.usage_history(run).count() == 20
    kept = tm.switch_history(run).orderBy("seq").collect()
    assert len(kept) == 10 and kept[-1]["seq"] == 59 and kept[-1]["from_token"] == "alpha"
    assert tm.failover_counts(run).first()[1:] == (60, 10)


def test_resume_points(spark):
    totals = spark.createDataFrame([(1, 5), (2, 3), (3, 5), (4, 0)], "intake_id bigint, total bigint")
    files = spark.createDataFrame(
        [(1, 1, 9), (1, 2, 9), (1, 4, 9), (2, 1, 1), (2, 2, 1), (2, 3, 1), (3, 1, 0)],
        "intake_id bigint, chunk_idx bigint, size bigint",
    )
    got = {r["intake_id"]: (r["start_index"], r["completed"]) for r in tm.resume_points(totals, files).collect()}
    assert got == {1: (3, 2), 2: (4, 3), 3: (1, 0), 4: (1, 0)}


def test_paths(value):
    got = value(
        lambda p: F.struct(*tm.parse_chunk_path(p)),
        "/a/audio/job-abc/0003.wav", r"C:\storage\audio\job-abc\0003.wav", "/a/x/12.wav", "/a/x/00012.wav",
    )
    assert [tuple(r) for r in got] == [("job-abc", 3), ("job-abc", 3), ("x", None), ("x", None)]
    assert value(tm.is_chunk_file, "0001.wav", "0001.WAV", "1.wav", "00001.wav", "0001.wav2") == [
        True, True, False, False, False]
    assert value(tm.manifest_line, "/a/it's.wav") == ["file '/a/it'\\''s.wav'"]


def test_progress_and_eta(spark, value):
    assert value(tm.preview_snippet, "a" * 200, " short ") == ["a" * 120 + "…", "short"]
    row = spark.range(1).select(
        tm.progress_percent(F.lit(1), F.lit(3)).alias("a"), tm.progress_percent(F.lit(1), F.lit(0)).alias("b"),
        tm.eta_text(F.lit(0), F.lit(5), F.lit(9.0)).alias("c"), tm.eta_text(F.lit(2), F.lit(4), F.lit(30.9)).alias("d"),
        tm.eta_text(F.lit(1), F.lit(4), F.lit(45.0)).alias("e"),
    ).first()
    assert tuple(row) == (33.3, 0.0, "estimating...", "~30s", "~2m 15s")


def test_status(spark):
    log = spark.createDataFrame(
        [(1, 1, "generating"), (1, 5, "completed"), (2, 2, "generating"), (2, 3, "generating"), (2, 4, "merging")],
        "intake_id bigint, seq bigint, status string",
    )
    assert {(r["intake_id"], r["status"]) for r in tm.latest_status(log).collect()} == {(1, "completed"), (2, "merging")}
    assert tm.find_active(log).first()["intake_id"] == 2
    moves = {(r["from_status"], r["to_status"]): r["transitions"] for r in tm.status_transitions(log).collect()}
    assert moves == {("generating", "completed"): 1, ("generating", "merging"): 1}


def test_errors(value):
    got = value(
        lambda m: F.struct(*tm.error_class(m), tm.is_rate_limit(m)),
        "HTTP 429", "Resource_Exhausted", "Quota gone", "api_key_invalid", "", "x" * 300,
    )
    assert [(r[0], r[2]) for r in got] == [
        ("quota", True), ("quota", True), ("quota", False), ("invalid", False), ("invalid", False), ("invalid", False)]
    assert got[4][1] == tm.NO_MESSAGE and got[5][1] == "x" * 200


def test_newest_record_by_hash_aggregation(spark):
    log = spark.createDataFrame(
        [(1, "a", "x"), (5, "a", "y"), (2, None, "z"), (4, None, None), (3, "b", "w")],
        "seq bigint, intake_id string, status string",
    )
    newest = tm.latest_status(log)
    assert newest.columns == ["intake_id", "seq", "status"]
    got = {r["intake_id"]: (r["seq"], r["status"]) for r in newest.collect()}
    assert got == {"a": (5, "y"), None: (4, None), "b": (3, "w")}
    assert tm.latest_status(log.limit(0)).collect() == []


@pytest.mark.parametrize("name", ["latest_status", "find_active", "attempt_manifest"])
def test_newest_records_need_no_sorted_aggregate(spark, small, name):
    plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_null_key_is_a_key_in_ordered_helpers(spark):
    rows = spark.createDataFrame([(None, 1), (None, 9), (None, 30), (1, 2)], "k bigint, o bigint")
    numbered = od.with_row_number(rows, ["k"], "o", "n", "total", block=8).collect()
    assert {(r["k"], r["o"]): (r["n"], r["total"]) for r in numbered} == {
        (None, 1): (1, 3), (None, 9): (2, 3), (None, 30): (3, 3), (1, 2): (1, 1)
    }
    back = od.with_previous(rows, ["k"], "o", F.struct("o"), "prev", block=8).collect()
    assert {(r["k"], r["o"]): r["prev"] and r["prev"]["o"] for r in back} == {
        (None, 1): None, (None, 9): 1, (None, 30): 9, (1, 2): None
    }


def test_windows_follow_the_rate_of_the_chunk(spark):
    level = [0] * 5 + [8000] * 5 + [0] * 40
    fast = _samples(spark, {(1, 1): level}).withColumn("rate", F.lit(500))
    slow = _samples(spark, {(1, 1): level}).withColumn("rate", F.lit(100))
    fast, slow = sg.chunk_levels(fast).first(), sg.chunk_levels(slow).first()
    assert fast["silence_ratio"] == 0.9 and slow["silence_ratio"] == 0.9
    assert round(fast["head_rms"], 6) == round(fast["tail_rms"], 6) == round(8000 * 0.1**0.5, 6)
    assert slow["tail_rms"] == 0.0 and round(slow["head_rms"], 6) == round(8000 * 0.5**0.5, 6)


@pytest.mark.parametrize("name", ["signal_report", "signal_label", "variation_score", "discontinuities"])
def test_signal_metrics_start_at_stored_chunks(spark, small, name):
    """The samples are numbered and summed once; the look-back reads chunk rows."""
    plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "sample_idx" not in plan


def test_narration_pipeline_is_map_only(spark, small):
    plan = QUERIES["narration_pipeline"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Join" not in plan


def test_manifest_keeps_last_record(spark):
    rows = spark.createDataFrame(
        [(1, "j", 1, "a"), (2, "j", 1, "b"), (3, None, 1, "c"), (4, "j", None, "d")],
        "seq bigint, intake_id string, chunk_index bigint, token string",
    )
    assert [r["token"] for r in tm.attempt_manifest(rows).collect()] == ["b"]


def test_tokens(spark, value):
    assert value(tk.mask_secret, "AIzaSyABCDEF1234567890", "short", "", None) == [
        "AIza" + "•" * 8 + "7890", "sho" + "•" * 6, "", ""]
    assert value(tk.is_masked, "AIza••••••••1234", "AIzaSyRealKey", "ab****") == [True, False, True]
    schema = "position bigint, name string, id string, api_key string, key string, enabled string"
    raw = spark.createDataFrame(
        [(1, " a ", None, "k1", None, None), (2, None, "b", "", "k2", "No"), (3, None, None, None, "k3", "YES"),
         (4, "x", None, " ", None, "true")], schema)
    tokens = tk.read_tokens(raw)
    assert [tuple(r) for r in tokens.orderBy("position").collect()] == [
        (1, "a", "k1", True), (2, "b", "k2", False), (3, "token", "k3", True)]
    incoming = spark.createDataFrame(
        [(1, "a", "k1••••••", True), (2, "new", "x••••••", True), (3, "b", " fresh ", False)],
        "position bigint, name string, api_key string, enabled boolean")
    merged = {r["name"]: r["api_key"] for r in tk.upsert_keep_secret(incoming, tokens).collect()}
    assert merged == {"a": "k1", "new": "x••••••", "b": "fresh"}
    off = tokens.withColumn("enabled", F.lit(False))
    assert tk.enabled_tokens(off).count() == 0
    assert tk.enabled_tokens(off, "spare").first()["name"] == "env"
    assert [r["priority"] for r in tk.public_tokens(tokens).orderBy("priority").collect()] == [1, 2, 3]
    names = spark.createDataFrame([("a",), (" a",), ("",), ("b",)], "name string")
    assert {(r["name"], r["reason"]) for r in tk.name_rejects(names).collect()} == {("a", "duplicate"), ("", "blank")}


def test_empty_chunks_are_silent_throughout(spark):
    columns = "series_id bigint, chunk_idx bigint, n_samples bigint, rms double, silence_ratio double, head_rms double, tail_rms double, loudness_dbfs double"
    chunks = spark.createDataFrame([(1, 1, 10, 3000.0, 0.0, 3000.0, 3000.0, -20.0)], columns)
    headers = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1)], "series_id bigint, chunk_idx bigint")
    whole = sg.with_empty_chunks(chunks, headers)
    assert sorted(map(tuple, whole.collect()))[1:] == [
        (1, 2, 0, 0.0, 1.0, 0.0, 0.0, -90.0), (2, 1, 0, 0.0, 1.0, 0.0, 0.0, -90.0),
    ]
    report = {r.series_id: r for r in sg.signal_report(headers.select("series_id").distinct(), whole).collect()}
    assert report[1].chunk_count == 2 and report[1].discontinuities_count == 1 and report[1].avg_chunk_silence_ratio == 0.5
    assert report[2].quality_label == "fair" and report[2].avg_chunk_silence_ratio == 1.0
