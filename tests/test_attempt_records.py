"""Attempt records of any shape: typed fields, unknown keys, wrong types, broken text."""

import json

from narralake.operators import attempts as at
from narralake.operators import telemetry as tm

WHOLE = {
    "chunk_index": 1,
    "intake_id": "job-1",
    "request": {
        "chunk_index": 1, "prompt": "full prompt", "prompt_char_count": 11,
        "config": {
            "model": "m", "temperature": 1, "voice_name": "v", "response_modalities": ["audio", "text"],
            "speech_mode": "single_speaker",
        },
        "continuity_note": "note", "scene_context": "", "transcript": "transcript", "transcript_char_count": 10,
        "token_name": "token-a", "attempt": 1,
    },
    "response": {
        "success": True, "error": None, "wav_path": "/x/0001.wav", "wav_size_bytes": 1000, "mime_type": None,
        "audio_bytes": None, "timestamp": 1700000000.25,
    },
}


def parsed(spark, *texts):
    log = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "seq long, record string, prompt string")
    return [r.asDict() for r in at.parse_records(log).orderBy("seq").collect()]


def test_all_leaves_of_a_whole_record(spark):
    (row,) = parsed(spark, json.dumps(WHOLE))
    request, response = WHOLE["request"], WHOLE["response"]
    want = {k: v for k, v in WHOLE.items() if k not in ("request", "response")}
    want |= {"request_chunk_index": 1, **{k: v for k, v in request.items() if k not in ("config", "chunk_index")}}
    want |= {**request["config"], **response}
    assert {k: row[k] for k in want} == want and set(want) == set(at.LEAVES)
    assert row["unknown"] == {} and row["mistyped"] == [] and row["corrupt"] is None


def test_unknown_keys_and_wrong_types_are_kept(spark):
    odd = json.loads(json.dumps(WHOLE))
    odd["request"]["attempt"] = "first"
    odd["request"]["config"]["top_k"] = [1, {"a": None}]
    odd["response"]["timestamp"] = "12.5"
    odd["trace.id"] = "é"
    (row,) = parsed(spark, json.dumps(odd))
    assert row["unknown"] == {"$.request.config.top_k": '[1,{"a":null}]', "$.trace.id": '"é"'}
    assert row["mistyped"] == ["attempt"] and row["attempt"] is None and row["timestamp"] == 12.5


def test_broken_and_foreign_texts(spark):
    texts = ['{"intake_id": "a"', "[1]", "null", "", '"text"', None, "{}", '{"request": 5, "response": null}']
    rows = parsed(spark, *texts)
    assert [r["corrupt"] for r in rows] == [*texts[:5], None, None, None]
    assert rows[7]["unknown"] == {} and rows[7]["prompt"] is None
    log = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, json.dumps(WHOLE)])], "seq long, record string")
    health = at.record_health(at.parse_records(log)).first()
    assert (health.records, health.broken, health.without_key, health.with_unknown, health.with_mistyped) == (9, 5, 3, 0, 0)
    assert at.record_health(at.parse_records(log.limit(0))).first().records == 0


def test_manifest_holds_the_newest_whole_record(spark):
    other = json.loads(json.dumps(WHOLE))
    other["response"]["success"] = False
    log = spark.createDataFrame(
        [(1, json.dumps(WHOLE)), (2, json.dumps(other)), (3, json.dumps(WHOLE | {"chunk_index": None})), (4, "{"),
         (5, json.dumps(WHOLE | {"intake_id": ""})), (6, json.dumps(WHOLE | {"chunk_index": 2}))],
        "seq long, record string",
    )
    rows = tm.attempt_manifest(at.parse_records(log)).collect()
    assert sorted((r.intake_id, r.chunk_index, r.seq, r.success) for r in rows) == [("job-1", 1, 2, False), ("job-1", 2, 6, True)]
    assert "api_key" not in str(rows)


def test_a_record_is_parsed_once_below_a_filter(spark):
    log = spark.createDataFrame([(1, json.dumps(WHOLE))], "seq long, record string")
    plan = at.keyed(at.parse_records(log))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
