"""Queries of the run-telemetry, file and token operators, with their checks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from narralake.operators import attempts as at
from narralake.operators import sequence as sq
from narralake.operators import telemetry as tm
from narralake.operators import tokens as tk
from narralake.plans.views_sql import (
    ATTEMPTS,
    CHUNK_FILES,
    EDITED,
    ERROR_LOG,
    LIVE,
    OUTPUT_FILES,
    RAW_TOKENS,
    STATUS_LOG,
    TOKENS,
    lit,
    mask,
    with_,
)
from narralake.sources import tables as tb

def _log(spark, sf_dir):
    return tb.status_log(spark, sf_dir)


def _attempts(spark, sf_dir):
    return tb.attempts(spark, sf_dir)


# ----------------------------------------------------------- status queries --
def latest_status(spark, sf_dir):
    return tm.latest_status(_log(spark, sf_dir))


def find_active(spark, sf_dir):
    return tm.find_active(_log(spark, sf_dir))


def progress(spark, sf_dir):
    """Percent and snippet of each conversation turn, taken as a chunk."""
    turns = tb.read_table(spark, sf_dir, "conversations")
    return turns.select(
        "conv_id",
        "turn",
        tm.progress_percent(F.col("turn"), F.col("conv_id") % 11).alias("progress_percent"),
        F.length("text").cast("bigint").alias("current_chunk_size"),
        tm.preview_snippet(F.col("text")).alias("current_chunk_preview"),
    )


def eta(spark, sf_dir):
    """Time left of each intake at its newest status."""
    per_intake = _log(spark, sf_dir).groupBy("intake_id").agg(
        F.max_by("current", "seq").alias("done"),
        F.max_by("total", "seq").alias("total"),
        (F.max("epoch") - F.min("epoch")).alias("elapsed"),
    )
    return per_intake.select(
        "intake_id",
        tm.eta_text(F.col("done"), F.col("total"), F.col("elapsed").cast("double") / 1000).alias("eta"),
    )


def status_transitions(spark, sf_dir):
    return tm.status_transitions(_log(spark, sf_dir))


def status_sequence_check(spark, sf_dir):
    """Whether the statuses of each intake follow one another as they may."""
    return sq.sequence_check(_log(spark, sf_dir))


# ------------------------------------------------------------- file queries --
def path_context(spark, sf_dir):
    files = tb.chunk_files(spark, sf_dir)
    intake, index = tm.parse_chunk_path(F.col("path"))
    return files.select("path", intake.alias("intake_name"), index.alias("chunk_index"))


def _named(spark, sf_dir):
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return tb.chunk_files(spark, sf_dir).withColumn("name", name)


def chunk_listing(spark, sf_dir):
    """Chunk files by intake in name order (the order is the ``name`` column)."""
    return _named(spark, sf_dir).where(tm.is_chunk_file(F.col("name"))).select(
        "intake_id", "name", "path", "size"
    )


def concat_manifest(spark, sf_dir):
    """Lines of the concat list, with their place; quotes are escaped."""
    return tm.concat_manifest(_named(spark, sf_dir))


def resume_point(spark, sf_dir):
    """Totals from the log; an intake's chunk files decide where to resume."""
    attempts = _attempts(spark, sf_dir)
    totals = attempts.groupBy(F.col("run_id").alias("intake_id")).agg(
        (F.max("chunk_id") + 1).alias("total")
    )
    _, index = tm.parse_chunk_path(F.col("path"))
    lower = F.endswith(F.col("path"), F.lit(".wav"))
    files = tb.chunk_files(spark, sf_dir).where(lower).select(
        "intake_id", (index + 1).alias("chunk_idx"), "size"
    ).where(F.col("chunk_idx").isNotNull())
    return tm.resume_points(totals, files)


def output_lookup(spark, sf_dir):
    latest = tm.latest_status(_log(spark, sf_dir)).withColumn(
        "output_path",
        F.when(
            F.col("intake_id") % 8 == 0,
            F.concat(F.lit("/outputs/custom-"), F.col("intake_id").cast("string"), F.lit(".wav")),
        ),
    )
    return tm.output_lookup(latest, tb.output_files(spark, sf_dir), "/outputs")


# ------------------------------------------------------------ token queries --
def usage_history(spark, sf_dir):
    return tm.usage_history(_attempts(spark, sf_dir)).select(
        "run_id", "seq", "token", "chunk_id", "status", "epoch"
    )


def switch_history(spark, sf_dir):
    return tm.switch_history(_attempts(spark, sf_dir))


def quota_failovers(spark, sf_dir):
    return tm.failover_counts(_attempts(spark, sf_dir))


def failed_tokens(spark, sf_dir):
    return tm.failed_tokens(tm.token_marks(_attempts(spark, sf_dir)))


def _state(*columns):
    def query(spark, sf_dir):
        marks = tm.token_marks(_attempts(spark, sf_dir))
        return tm.run_state(marks, tb.TOKEN_NAMES[0]).select("run_id", *columns)

    return query


def token_board(spark, sf_dir):
    return tm.token_board(_attempts(spark, sf_dir), tb.TOKEN_NAMES)


CHUNKS_PER_RUN = 100


def flat_snapshot(snapshot):
    """The arrays of a snapshot as text, so that two engines compare alike."""
    listed = lambda name, *fields: F.array_join(
        F.transform(name, lambda e: F.concat_ws(":", *(e[f].cast("string") for f in fields))), ","
    )
    return snapshot.withColumns(
        {
            "failed_tokens": F.array_join("failed_tokens", ","),
            "tokens": listed("tokens", "name", "priority", "status"),
            "usage_history": F.coalesce(listed("usage_history", "token", "chunk_id", "status", "epoch"), F.lit("")),
            "switch_history": F.coalesce(
                listed("switch_history", "from_token", "to_token", "reason", "chunk_id"), F.lit("")
            ),
        }
    )


def pool_snapshot(spark, sf_dir):
    """The whole snapshot of each run, from the log at once."""
    a = _attempts(spark, sf_dir)
    usage = tm.usage_history(a, tm.KEPT_USAGE)
    shot = tm.pool_snapshot(tm.snapshot_marks(a), usage, tm.switch_history(a), tb.TOKEN_NAMES, CHUNKS_PER_RUN)
    return flat_snapshot(shot)


# ---------------------------------------------------------- attempt queries --
def _record_json(spark, sf_dir):
    """Attempt records as JSON text; some lack a key, are cut off, or hold what nobody expects."""
    a = _attempts(spark, sf_dir)
    seq, every = F.col("seq"), lambda n: F.col("seq") % n == 0
    prompt = F.concat(F.lit("Read aloud: \u201c"), F.col("token"), F.lit("\u201d "), seq.cast("string"))
    transcript = F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))
    record = F.struct(
        F.when(~every(23), F.col("chunk_id")).alias("chunk_index"),
        F.when(~every(29), F.concat(F.lit("job-"), F.col("run_id").cast("string"))).alias("intake_id"),
        F.struct(
            F.col("chunk_id").alias("chunk_index"),
            prompt.alias("prompt"),
            F.length(prompt).alias("prompt_char_count"),
            F.struct(
                F.lit("tts-1").alias("model"),
                F.lit(1.0).alias("temperature"),
                F.when(~every(7), F.lit("voice-a")).alias("voice_name"),
                F.array(F.lit("audio")).alias("response_modalities"),
                F.lit("single_speaker").alias("speech_mode"),
                F.when(every(13), F.lit(5)).alias("top_k"),
            ).alias("config"),
            F.when(every(2), F.lit("note")).otherwise(F.lit("")).alias("continuity_note"),
            F.lit("").alias("scene_context"),
            transcript.alias("transcript"),
            F.length(transcript).alias("transcript_char_count"),
            F.col("token").alias("token_name"),
            F.when(every(37), F.lit("first")).otherwise((seq % 5 + 1).cast("string")).alias("attempt"),
        ).alias("request"),
        F.struct(
            (F.col("status") == "success").alias("success"),
            F.when(F.col("status") == "quota_failed", F.lit("429")).alias("error"),
            F.when(F.col("status") == "success", F.concat(F.lit("/audio/"), F.col("run_id").cast("string"))).alias("wav_path"),
            F.when(F.col("status") == "success", seq * 10).alias("wav_size_bytes"),
            F.when(F.col("status") == "success", F.lit("audio/wav")).alias("mime_type"),
            F.when(F.col("status") == "success", seq * 10 - 44).alias("audio_bytes"),
            F.col("epoch").alias("timestamp"),
        ).alias("response"),
        F.when(every(3), F.struct(seq.alias("id"))).alias("trace"),
    )
    text = F.to_json(record)
    return a.select("seq", F.when(every(31), F.substring(text, 1, 40)).otherwise(text).alias("record"))


def _parsed(spark, sf_dir):
    """All fields of the records, arrays and unknown keys as text."""
    return at.parse_records(_record_json(spark, sf_dir)).withColumns(
        {
            "response_modalities": F.array_join("response_modalities", ","),
            "mistyped": F.array_join("mistyped", ","),
            "unknown": F.array_join(
                F.transform(F.array_sort(F.map_entries("unknown")), lambda e: F.concat_ws("=", e["key"], e["value"])), ","
            ),
        }
    )


def attempt_log(spark, sf_dir):
    """Nested records as rows; records without (or with an empty) intake or chunk are skipped."""
    return at.keyed(_parsed(spark, sf_dir)).drop("corrupt")


def attempt_health(spark, sf_dir):
    """Records, and those that are broken, lack a key or hold what is unknown or mistyped."""
    return at.record_health(at.parse_records(_record_json(spark, sf_dir)))


def attempt_manifest(spark, sf_dir):
    return tm.attempt_manifest(_parsed(spark, sf_dir).drop("corrupt"))


def error_class(spark, sf_dir):
    result, shown = tm.error_class(F.col("message"))
    classed = tb.error_log(spark, sf_dir).select(
        tm.is_rate_limit(F.col("message")).alias("rate_limited"),
        result.alias("result"),
        shown.alias("shown"),
    )
    return classed.groupBy("rate_limited", "result", "shown").agg(F.count(F.lit(1)).alias("errors"))


def attempt_summary(spark, sf_dir):
    return tm.attempt_summary(_attempts(spark, sf_dir), "run_id")


# ------------------------------------------------------- token list queries --
def _tokens(spark, sf_dir):
    return tk.read_tokens(tb.raw_tokens(spark, sf_dir))


def token_config(spark, sf_dir):
    """Token list written as JSON rows and read back leniently."""
    folder = os.path.join(tb.scratch_dir(spark, "tokens"), "config")
    tb.raw_tokens(spark, sf_dir).write.mode("overwrite").json(folder)
    schema = "position long, name string, id string, api_key string, key string, enabled string"
    return tk.read_tokens(spark.read.schema(schema).json(folder))


def mask_secret(spark, sf_dir):
    return _tokens(spark, sf_dir).select(
        "position", tk.mask_secret(F.col("api_key")).alias("api_key_masked")
    )


def _edited(spark, sf_dir):
    return tb.edited_tokens(_tokens(spark, sf_dir), tk.mask_secret)


def is_masked(spark, sf_dir):
    return _edited(spark, sf_dir).select("position", tk.is_masked(F.col("api_key")).alias("masked"))


def upsert_keep_secret(spark, sf_dir):
    return tk.upsert_keep_secret(_edited(spark, sf_dir), _tokens(spark, sf_dir))


def unique_names(spark, sf_dir):
    """Names of the raw list that are blank or used twice."""
    return tk.name_rejects(tb.raw_tokens(spark, sf_dir))


def enabled_tokens(spark, sf_dir):
    """Enabled tokens, and the fallback for the list with all of them off."""
    tokens = _tokens(spark, sf_dir)
    live = tk.enabled_tokens(tokens, "fallback-key").withColumn("list", F.lit("live"))
    off = tokens.withColumn("enabled", F.lit(False))
    spare = tk.enabled_tokens(off, " fallback-key ").withColumn("list", F.lit("off"))
    bare = tk.enabled_tokens(off).withColumn("list", F.lit("bare"))
    return live.unionByName(spare).unionByName(bare)


def public_token_list(spark, sf_dir):
    return tk.public_tokens(_tokens(spark, sf_dir))


def idle_board(spark, sf_dir):
    return tk.idle_board(_tokens(spark, sf_dir))


def recent_jobs(spark, sf_dir):
    """Orders taken as jobs: the newest twenty."""
    orders = tb.read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        tb.epoch_seconds(F.col("o_orderdate")).alias("created_at"),
    )
    return tk.recent_jobs(orders)


QUERIES = {
    "latest_status": latest_status,
    "find_active": find_active,
    "progress": progress,
    "eta": eta,
    "resume_point": resume_point,
    "usage_history": usage_history,
    "switch_history": switch_history,
    "quota_failovers": quota_failovers,
    "failed_tokens": failed_tokens,
    "active_token": _state("active_token"),
    "pool_waiting": _state("pool_waiting"),
    "token_board": token_board,
    "pool_snapshot": pool_snapshot,
    "attempt_manifest": attempt_manifest,
    "error_class": error_class,
    "attempt_summary": attempt_summary,
    "status_transitions": status_transitions,
    "status_sequence_check": status_sequence_check,
    "output_lookup": output_lookup,
    "attempt_log": attempt_log,
    "attempt_health": attempt_health,
    "path_context": path_context,
    "chunk_listing": chunk_listing,
    "concat_manifest": concat_manifest,
    "token_config": token_config,
    "mask_secret": mask_secret,
    "is_masked": is_masked,
    "upsert_keep_secret": upsert_keep_secret,
    "unique_names": unique_names,
    "enabled_tokens": enabled_tokens,
    "public_token_list": public_token_list,
    "idle_board": idle_board,
    "recent_jobs": recent_jobs,
}

# ----------------------------------------------------------------- SQL side --
_LATEST = with_(
    STATUS_LOG,
    """latest AS (SELECT * FROM status_log
  QUALIFY row_number() OVER (PARTITION BY intake_id ORDER BY seq DESC) = 1)""",
)
_SWITCH = with_(
    ATTEMPTS,
    LIVE,
    """switches AS (SELECT run_id, seq, chunk_id, from_token, to_token, reason
  FROM live WHERE status = 'switched')""",
)
_STATE = with_(
    ATTEMPTS,
    LIVE,
    """failed AS (SELECT run_id, token FROM (
    SELECT run_id, token, arg_max(status, seq) AS s FROM live
    WHERE status IN ('quota_failed', 'success') GROUP BY run_id, token) WHERE s = 'quota_failed')""",
    """runs AS (SELECT run_id, arg_max(status, seq) FILTER (status IN ('begin', 'ended')) AS phase
    FROM attempts GROUP BY run_id)""",
    """state AS (SELECT r.run_id,
    coalesce(arg_max(token, seq) FILTER (status IN ('calling', 'switched', 'synced')), 'tok1') AS active_token,
    coalesce(arg_max(status, seq) FILTER (status IN ('waiting', 'switched', 'synced', 'ended')) = 'waiting',
             false) AS pool_waiting, any_value(coalesce(phase, 'begin')) = 'begin' AS generation_active
    FROM runs r LEFT JOIN live l ON l.run_id = r.run_id GROUP BY r.run_id)""",
)
_NAMED = with_(
    ATTEMPTS, CHUNK_FILES, "named AS (SELECT *, regexp_extract(path, '[^/]+$') AS name FROM chunk_files)"
)
_INTAKE_OF = "nullif(regexp_extract(path, '([^/]+)/[^/]*$', 1), '')"
_INDEX_OF = r"CAST(nullif(regexp_extract(path, '/(\d\d\d\d)(?:\.[^./]*)?$', 1), '') AS BIGINT)"
_RECORDS = with_(
    ATTEMPTS,
    """all_records AS (SELECT seq, seq % 31 = 0 AS broken, CASE WHEN seq % 29 <> 0 THEN 'job-' || run_id END AS intake_id,
    CASE WHEN seq % 23 <> 0 THEN chunk_id END AS chunk_index, chunk_id AS request_chunk_index,
    'Read aloud: “' || token || '” ' || seq AS prompt, length('Read aloud: “' || token || '” ' || seq) AS prompt_char_count,
    'tts-1' AS model, CAST(1 AS DOUBLE) AS temperature, CASE WHEN seq % 7 <> 0 THEN 'voice-a' END AS voice_name,
    'audio' AS response_modalities, 'single_speaker' AS speech_mode,
    CASE WHEN seq % 2 = 0 THEN 'note' ELSE '' END AS continuity_note, '' AS scene_context,
    'chunk ' || chunk_id AS transcript, length('chunk ' || chunk_id) AS transcript_char_count, token AS token_name,
    CASE WHEN seq % 37 <> 0 THEN seq % 5 + 1 END AS attempt, status = 'success' AS success,
    CASE WHEN status = 'quota_failed' THEN '429' END AS error,
    CASE WHEN status = 'success' THEN '/audio/' || run_id END AS wav_path,
    CASE WHEN status = 'success' THEN seq * 10 END AS wav_size_bytes,
    CASE WHEN status = 'success' THEN 'audio/wav' END AS mime_type,
    CASE WHEN status = 'success' THEN seq * 10 - 44 END AS audio_bytes, CAST(epoch AS DOUBLE) AS timestamp,
    concat_ws(',', CASE WHEN seq % 13 = 0 THEN '$.request.config.top_k=5' END,
                   CASE WHEN seq % 3 = 0 THEN '$.trace={"id":' || seq || '}' END) AS unknown,
    CASE WHEN seq % 37 = 0 THEN 'attempt' ELSE '' END AS mistyped FROM attempts)""",
    """records AS (SELECT * EXCLUDE (broken) FROM all_records WHERE NOT broken)""",
)
_TOK = with_(RAW_TOKENS, TOKENS)
_EDIT = with_(RAW_TOKENS, TOKENS, EDITED)

ORACLES = {
    "latest_status": _LATEST + "SELECT * FROM latest",
    "find_active": _LATEST + """SELECT * FROM latest
WHERE status IN ('generating', 'waiting_quota', 'merging', 'cancelling') ORDER BY seq DESC LIMIT 1""",
    "progress": """SELECT conv_id, turn,
  CASE WHEN conv_id % 11 > 0 THEN round(turn / (conv_id % 11) * 100, 1) ELSE 0.0 END AS progress_percent,
  length(text) AS current_chunk_size,
  CASE WHEN length(trim(text)) <= 120 THEN trim(text) ELSE left(trim(text), 120) || '…' END AS current_chunk_preview
FROM conversations""",
    "eta": with_(STATUS_LOG) + """
SELECT intake_id, CASE WHEN done <= 0 THEN 'estimating...' WHEN sec < 60 THEN '~' || sec || 's'
  ELSE '~' || (sec // 60) || 'm ' || (sec % 60) || 's' END AS eta FROM (
  SELECT *, CAST(trunc((total - done) * (CAST(elapsed AS DOUBLE) / 1000 / nullif(done, 0))) AS BIGINT) AS sec FROM (
    SELECT intake_id, arg_max(current, seq) AS done, arg_max(total, seq) AS total,
           max(epoch) - min(epoch) AS elapsed FROM status_log GROUP BY intake_id))""",
    "resume_point": with_(ATTEMPTS, CHUNK_FILES) + f"""
SELECT t.intake_id, coalesce(min(want.i), any_value(t.total) + 1) AS start_index,
       coalesce(min(want.i), any_value(t.total) + 1) - 1 AS completed
FROM (SELECT run_id AS intake_id, max(chunk_id) + 1 AS total FROM attempts GROUP BY run_id) t
LEFT JOIN (
  SELECT intake_id, i FROM (SELECT run_id AS intake_id, unnest(range(1, max(chunk_id) + 2)) AS i
                            FROM attempts GROUP BY run_id)
  EXCEPT SELECT intake_id, {_INDEX_OF} + 1 FROM chunk_files WHERE size > 0 AND path LIKE '%.wav') want
  ON want.intake_id = t.intake_id
GROUP BY t.intake_id""",
    "usage_history": with_(ATTEMPTS, LIVE) + """SELECT run_id, seq, token, chunk_id, status, epoch FROM live
WHERE status NOT IN ('begin', 'synced', 'ended')
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 20""",
    "switch_history": _SWITCH + """SELECT * FROM switches
QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) <= 10""",
    "quota_failovers": _SWITCH
    + """SELECT run_id, count(*) FILTER (status = 'switched') AS quota_failovers,
  least(count(*) FILTER (status = 'switched'), 10) AS shown_failovers FROM live GROUP BY run_id""",
    "failed_tokens": _STATE + "SELECT run_id, token FROM failed",
    "active_token": _STATE + "SELECT run_id, active_token FROM state",
    "pool_waiting": _STATE + "SELECT run_id, pool_waiting FROM state",
    "token_board": _STATE + """
SELECT s.run_id, t.token, t.priority, CASE WHEN pool_waiting THEN 'waiting' WHEN t.token = active_token AND generation_active THEN 'active'
  WHEN f.token IS NOT NULL THEN 'failed' ELSE 'idle' END AS status
FROM state s, (VALUES ('tok1', CAST(1 AS BIGINT)), ('tok2', 2), ('tok3', 3), ('tok4', 4)) t(token, priority)
LEFT JOIN failed f ON f.run_id = s.run_id AND f.token = t.token""",
    "pool_snapshot": _STATE + f"""
, board AS (SELECT s.run_id, t.token, t.priority,
    CASE WHEN pool_waiting THEN 'waiting' WHEN t.token = active_token AND generation_active THEN 'active'
         WHEN f.token IS NOT NULL THEN 'failed' ELSE 'idle' END AS status
  FROM state s, (VALUES ('tok1', 1), ('tok2', 2), ('tok3', 3), ('tok4', 4)) t(token, priority)
  LEFT JOIN failed f ON f.run_id = s.run_id AND f.token = t.token),
uses AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS back FROM live
         WHERE status IN ('calling', 'quota_failed', 'switched', 'waiting', 'success')),
moves AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS back FROM live
          WHERE status = 'switched')
SELECT s.run_id, s.generation_active, CAST(4 AS BIGINT) AS total_tokens,
  CAST(coalesce((SELECT arg_max(substr(token, 4), seq) FROM live l
     WHERE l.run_id = s.run_id AND status IN ('switched', 'synced')), '1') AS BIGINT) AS active_token_index,
  s.active_token AS active_token_name,
  coalesce((SELECT string_agg(token, ',' ORDER BY token) FROM failed f WHERE f.run_id = s.run_id), '') AS failed_tokens,
  s.pool_waiting,
  coalesce((SELECT arg_max(chunk_id, seq) FROM live l WHERE l.run_id = s.run_id AND status = 'calling'), 0) AS current_chunk,
  CAST({CHUNKS_PER_RUN} AS BIGINT) AS total_chunks,
  (SELECT count(*) FROM moves m WHERE m.run_id = s.run_id AND back <= 10) AS quota_failovers,
  (SELECT string_agg(token || ':' || priority || ':' || status, ',' ORDER BY priority) FROM board b
    WHERE b.run_id = s.run_id) AS tokens,
  coalesce((SELECT string_agg(token || ':' || chunk_id || ':' || status || ':' || epoch, ',' ORDER BY seq) FROM uses u
    WHERE u.run_id = s.run_id AND back <= 20), '') AS usage_history,
  coalesce((SELECT string_agg(from_token || ':' || to_token || ':' || reason || ':' || chunk_id, ',' ORDER BY seq)
    FROM moves m WHERE m.run_id = s.run_id AND back <= 10), '') AS switch_history
FROM state s""",
    "attempt_manifest": _RECORDS + """SELECT * FROM records
WHERE intake_id IS NOT NULL AND chunk_index IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY intake_id, chunk_index ORDER BY seq DESC) = 1""",
    "error_class": with_(ATTEMPTS, ERROR_LOG) + f"""
SELECT u LIKE '%429%' OR u LIKE '%RESOURCE\\_EXHAUSTED%' ESCAPE '\\' AS rate_limited,
  CASE WHEN q THEN 'quota' ELSE 'invalid' END AS result,
  CASE WHEN q THEN {lit(tm.QUOTA_MESSAGE)}
       WHEN regexp_matches(u, 'API_KEY_INVALID|INVALID API KEY|UNAUTHENTICATED|401|403') THEN {lit(tm.INVALID_MESSAGE)}
       WHEN message = '' THEN {lit(tm.NO_MESSAGE)} ELSE left(message, 200) END AS shown, count(*) AS errors
FROM (SELECT message, upper(message) AS u, regexp_matches(upper(message), '429|RESOURCE_EXHAUSTED|QUOTA') AS q
      FROM error_log) GROUP BY ALL""",
    "attempt_summary": with_(ATTEMPTS) + """SELECT run_id, count(*) FILTER (status = 'success') AS successful,
  count(*) FILTER (status = 'quota_failed') AS failed, round((max(epoch) - min(epoch)) / 60, 2) AS total_minutes
FROM attempts GROUP BY run_id""",
    "status_transitions": with_(STATUS_LOG) + """
SELECT p AS from_status, status AS to_status, count(*) AS transitions FROM (
  SELECT status, lag(status) OVER (PARTITION BY intake_id ORDER BY seq) AS p FROM status_log)
WHERE p <> status GROUP BY p, status""",
    "status_sequence_check": with_(STATUS_LOG) + f"""
SELECT intake_id, count(*) AS records, count(*) FILTER (p <> status) AS changes, count(*) FILTER (bad) AS illegal,
  min(seq) FILTER (bad) AS first_illegal_seq, arg_max(status, seq) AS final_status FROM (
  SELECT *, CASE WHEN p IS NULL THEN status <> 'generating' ELSE p <> status AND (p || '>' || status) NOT IN (
    {', '.join(lit(f"{a}>{b}") for a, follow in sq.MAY_FOLLOW.items() for b in follow)}) END AS bad FROM (
    SELECT *, lag(status) OVER (PARTITION BY intake_id ORDER BY seq) AS p FROM status_log)) GROUP BY intake_id""",
    "output_lookup": _LATEST.rstrip() + f""",
{OUTPUT_FILES},
cand AS (SELECT intake_id, 0 AS c, '/outputs/custom-' || intake_id || '.wav' AS path FROM latest
    WHERE status = 'completed' AND intake_id % 8 = 0
  UNION ALL SELECT intake_id, 1, '/outputs/' || intake_id || '/final_audiobook.wav' FROM latest WHERE status = 'completed'
  UNION ALL SELECT intake_id, 2, '/outputs/' || intake_id || '_final_audiobook.wav' FROM latest WHERE status = 'completed')
SELECT intake_id, arg_min(path, c) AS path FROM cand SEMI JOIN output_files USING (path) GROUP BY intake_id""",
    "attempt_health": _RECORDS + """SELECT count(*) AS records, count(*) FILTER (broken) AS broken,
  count(*) FILTER (NOT broken AND (intake_id IS NULL OR chunk_index IS NULL)) AS without_key,
  count(*) FILTER (NOT broken AND unknown <> '') AS with_unknown,
  count(*) FILTER (NOT broken AND mistyped <> '') AS with_mistyped FROM all_records""",
    "attempt_log": _RECORDS
    + "SELECT * FROM records WHERE intake_id IS NOT NULL AND chunk_index IS NOT NULL",
    "path_context": with_(ATTEMPTS, CHUNK_FILES)
    + f"SELECT path, {_INTAKE_OF} AS intake_name, {_INDEX_OF} AS chunk_index FROM chunk_files",
    "chunk_listing": _NAMED + r"""SELECT intake_id, name, path, size FROM named
WHERE regexp_full_match(lower(name), '\d\d\d\d\.wav')""",
    "concat_manifest": _NAMED + r"""
SELECT intake_id, row_number() OVER (PARTITION BY intake_id ORDER BY name) AS line_no,
  'file ''' || replace(path, '''', '''\''''') || '''' AS line
FROM named WHERE regexp_full_match(lower(name), '\d\d\d\d\.wav')""",
    "token_config": _TOK + "SELECT * FROM tokens",
    "mask_secret": _TOK + f"SELECT position, {mask('api_key')} AS api_key_masked FROM tokens",
    "is_masked": _EDIT
    + "SELECT position, contains(api_key, '•') OR api_key LIKE '%****' AS masked FROM edited",
    "upsert_keep_secret": _EDIT + """
SELECT e.position, e.name, CASE WHEN contains(e.api_key, '•') THEN coalesce(t.k, e.api_key) ELSE e.api_key END AS api_key,
  e.enabled FROM edited e LEFT JOIN (SELECT name, arg_max(api_key, position) AS k FROM tokens GROUP BY name) t
  ON t.name = e.name""",
    "unique_names": with_(RAW_TOKENS) + """
SELECT n AS name, count(*) AS rows, CASE WHEN n = '' THEN 'blank' ELSE 'duplicate' END AS reason
FROM (SELECT trim(coalesce(name, '')) AS n FROM raw_tokens) GROUP BY n HAVING n = '' OR count(*) > 1""",
    "enabled_tokens": _TOK + """
SELECT position, name, api_key, 'live' AS list FROM tokens WHERE enabled
UNION ALL SELECT 1, 'env', 'fallback-key', 'live' WHERE NOT EXISTS (SELECT 1 FROM tokens WHERE enabled)
UNION ALL SELECT 1, 'env', 'fallback-key', 'off'""",
    "public_token_list": _TOK + f"""SELECT row_number() OVER (ORDER BY position) AS priority, name,
  {mask('api_key')} AS api_key_masked, enabled FROM tokens""",
    "idle_board": _TOK + """SELECT row_number() OVER (ORDER BY position) AS priority, name, 'idle' AS status
FROM tokens WHERE enabled""",
    "recent_jobs": """SELECT o_orderkey AS id, o_orderstatus AS status,
  CAST(floor(epoch(o_orderdate)) AS BIGINT) AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20""",
}
