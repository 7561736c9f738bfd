"""Run, token and progress state rebuilt from append-only event logs.

State questions are "what came last" questions, so they are maxima of positions
that combine on the map side: a run holding a third of all events costs no more
than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.functions.text import snippet
from narralake.operators.ordered import newest_per_key, with_previous

# --- fixed values: history sizes, states and messages ------------------------
KEPT_USAGE = 50
SHOWN_USAGE = 20
KEPT_SWITCHES = 10
SNIPPET_CHARS = 120
ACTIVE_STATES = ("generating", "waiting_quota", "merging", "cancelling")
USAGE_STATES = ("calling", "quota_failed", "switched", "waiting", "success")
USES_TOKEN = ("calling", "switched", "synced")
PLACES_TOKEN = ("switched", "synced")
CALLING = "calling"
BEGIN, SWITCHED, WAITING, ENDED = "begin", "switched", "waiting", "ended"
ENDS_WAIT = ("begin", "switched", "synced", "ended")
FAILED, SUCCEEDED = "quota_failed", "success"
ESTIMATING = "estimating..."
RATE_LIMIT_MARKS = ("429", "RESOURCE_EXHAUSTED")
QUOTA_MARKS = ("429", "RESOURCE_EXHAUSTED", "QUOTA")
INVALID_MARKS = ("API_KEY_INVALID", "INVALID API KEY", "UNAUTHENTICATED", "401", "403")
QUOTA_MESSAGE = "Quota exhausted or rate limited — key works but cannot call API now."
INVALID_MESSAGE = "Invalid API key."
NO_MESSAGE = "Could not validate token."
MAX_MESSAGE = 200
CHUNK_FILE = r"^[0-9]{4}\.wav$"
FINAL_NAME = "final_audiobook.wav"
# -----------------------------------------------------------------------------


# ------------------------------------------------------------------ status ---
def newest_record(log: DataFrame, *keys: str) -> DataFrame:
    """The record with the greatest ``seq`` of each key; ``seq`` is unique in a key.

    The greatest number alone is a hash aggregation that shrinks the log on the
    map side.  Whole records are picked by (key, seq), which spreads a hot key
    evenly.  A null key is a key; rows without ``seq`` are never the newest.
    """
    newest = log.groupBy(*keys).agg(F.max("seq").alias("seq"))
    same = F.col("l.seq") == F.col("n.seq")
    for key in keys:
        same = same & F.col(f"l.{key}").eqNullSafe(F.col(f"n.{key}"))
    return log.alias("l").join(newest.alias("n"), same, "left_semi")


def latest_status(log: DataFrame) -> DataFrame:
    """Newest whole record per intake."""
    return newest_record(log, "intake_id").select(
        "intake_id", *[c for c in log.columns if c != "intake_id"]
    )


def find_active(log: DataFrame) -> DataFrame:
    """The most recently written record that is still in progress (one row)."""
    return (
        latest_status(log)
        .where(F.col("status").isin(*ACTIVE_STATES))
        .orderBy(F.desc("seq"))
        .limit(1)
    )


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(done / total * 100, 1)).otherwise(F.lit(0.0))


def preview_snippet(c: Column) -> Column:
    return snippet(c, SNIPPET_CHARS)


def eta_text(done: Column, total: Column, elapsed: Column) -> Column:
    """Time left as ``~Ns`` or ``~Mm Ss``, truncated towards zero."""
    seconds = F.when(done > 0, (total - done) * (elapsed / F.nullif(done, F.lit(0)))).cast("bigint")
    minutes = F.floor(seconds / 60).cast("string")
    return (
        F.when(done <= 0, F.lit(ESTIMATING))
        .when(seconds < 60, F.concat(F.lit("~"), seconds.cast("string"), F.lit("s")))
        .otherwise(
            F.concat(
                F.lit("~"), minutes, F.lit("m "), F.pmod(seconds, F.lit(60)).cast("string"), F.lit("s")
            )
        )
    )


def status_transitions(log: DataFrame) -> DataFrame:
    """How often one status followed a different one."""
    seen = with_previous(log, ["intake_id"], "seq", F.struct("status"), "prev")
    return (
        seen.where(F.col("prev.status") != F.col("status"))
        .groupBy(F.col("prev.status").alias("from_status"), F.col("status").alias("to_status"))
        .agg(F.count(F.lit(1)).alias("transitions"))
    )


# ------------------------------------------------------------------- files ---
def parse_chunk_path(path: Column) -> tuple[Column, Column]:
    """``.../{intake}/{dddd}.ext`` to intake and chunk index (or null)."""
    unix = F.replace(path, F.lit("\\"), F.lit("/"))
    intake = F.nullif(F.regexp_extract(unix, r"([^/]+)/[^/]*$", 1), F.lit(""))
    stem = F.nullif(F.regexp_extract(unix, r"/([0-9]{4})(?:\.[^./]*)?$", 1), F.lit(""))
    return intake, stem.cast("bigint")


def is_chunk_file(name: Column) -> Column:
    return F.rlike(F.lower(name), F.lit(CHUNK_FILE))


def manifest_line(path: Column) -> Column:
    """Concat-list line of a file; a quote closes, escapes and reopens."""
    quoted = F.replace(path, F.lit("'"), F.lit("'\\''"))
    return F.concat(F.lit("file '"), quoted, F.lit("'"))


def concat_manifest(files: DataFrame) -> DataFrame:
    """Numbered concat-list lines per intake, in name order.

    ``files``: intake_id, name, path.  A chunk file has a four-digit name, so an
    intake has at most ten thousand of them (times letter case) and its window
    is bounded by that rule.
    """
    in_order = Window.partitionBy("intake_id").orderBy("name")
    return files.where(is_chunk_file(F.col("name"))).select(
        "intake_id",
        F.row_number().over(in_order).cast("bigint").alias("line_no"),
        manifest_line(F.col("path")).alias("line"),
    )


def resume_points(totals: DataFrame, files: DataFrame) -> DataFrame:
    """First chunk without a non-empty file, per intake.

    ``totals``: intake_id, total; ``files``: intake_id, chunk_idx, size.
    Expected minus present is an anti-join on (intake, chunk), which spreads
    over all tasks however long one intake is.
    """
    expected = totals.where(F.col("total") > 0).select(
        "intake_id",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total").cast("bigint"))).alias(
            "chunk_idx"
        ),
    )
    present = (
        files.where(F.col("size") > 0)
        .select("intake_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"))
        .distinct()
    )
    gaps = (
        expected.join(present, ["intake_id", "chunk_idx"], "left_anti")
        .groupBy("intake_id")
        .agg(F.min("chunk_idx").alias("_gap"))
    )
    start = F.coalesce("_gap", F.greatest(F.col("total"), F.lit(0)) + 1).cast("bigint")
    return totals.join(gaps, "intake_id", "left").select(
        "intake_id",
        start.alias("start_index"),
        (start - 1).alias("completed"),
    )


def output_lookup(latest: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """First existing output file of each completed intake."""
    own = F.col("intake_id").cast("string")
    candidates = F.array(
        F.col("output_path"),
        F.concat(F.lit(f"{root}/"), own, F.lit(f"/{FINAL_NAME}")),
        F.concat(F.lit(f"{root}/"), own, F.lit(f"_{FINAL_NAME}")),
    )
    wanted = latest.where(F.col("status") == "completed").select(
        "intake_id", F.posexplode(candidates).alias("choice", "path")
    )
    return (
        wanted.join(listing.select("path").distinct(), "path")
        .groupBy("intake_id")
        .agg(F.min_by("path", "choice").alias("path"))
    )


# -------------------------------------------------------------- token pool ---
def since_begin(log: DataFrame, begins: DataFrame | None = None) -> DataFrame:
    """Rows after the last begin of their run; a log that starts later has them all.

    ``begins``: run_id and begin_seq, if they are known already.
    """
    if begins is None:
        begins = log.groupBy("run_id").agg(F.max(_seq_if((BEGIN,))).alias("begin_seq"))
    kept = log.join(begins, "run_id", "left")
    return kept.where(
        F.col("begin_seq").isNull() | (F.col("seq") > F.col("begin_seq"))
    ).drop("begin_seq")


def usage(attempts: DataFrame) -> DataFrame:
    return attempts.where(F.col("status").isin(*USAGE_STATES))


def usage_history(attempts: DataFrame, shown: int = SHOWN_USAGE) -> DataFrame:
    """The newest uses of a token in each run; begin, sync and end are none."""
    return newest_per_key(usage(since_begin(attempts)), ["run_id"], "seq", shown)


def switches(attempts: DataFrame) -> DataFrame:
    """Switch events as logged: from which token to which, and why."""
    return attempts.where(F.col("status") == SWITCHED).select(
        "run_id", "seq", "chunk_id", "from_token", "to_token", "reason"
    )


def switch_history(attempts: DataFrame, kept: int = KEPT_SWITCHES) -> DataFrame:
    return newest_per_key(switches(since_begin(attempts)), ["run_id"], "seq", kept)


def failover_counts(attempts: DataFrame, kept: int = KEPT_SWITCHES) -> DataFrame:
    """All switches of each run since it began, and the number that a board shows."""
    count = F.count_if(F.col("status") == SWITCHED)
    return since_begin(attempts).groupBy("run_id").agg(
        count.alias("quota_failovers"),
        F.least(count, F.lit(kept)).cast("bigint").alias("shown_failovers"),
    )


def _seq_if(states: Sequence[str]) -> Column:
    return F.when(F.col("status").isin(*states), F.col("seq"))


def _mark_columns() -> list[Column]:
    return [
        F.max(_seq_if((FAILED,))).alias("failed_seq"),
        F.max(_seq_if((SUCCEEDED,))).alias("success_seq"),
        F.max(_seq_if(USES_TOKEN)).alias("used_seq"),
        F.max(_seq_if((WAITING,))).alias("waiting_seq"),
        F.max(_seq_if(ENDS_WAIT)).alias("settled_seq"),
        F.max(_seq_if((ENDED,))).alias("ended_seq"),
        F.max(_seq_if((BEGIN,))).alias("begin_seq"),
    ]


def token_marks(attempts: DataFrame) -> DataFrame:
    """Last positions that matter, per run and token.

    Positions are plain maxima, so this is a hash aggregation that shrinks the
    log on the map side.
    """
    return attempts.groupBy("run_id", "token").agg(*_mark_columns())


def _after(late: Column, early: Column) -> Column:
    return F.coalesce(late, F.lit(-1)) > F.coalesce(early, F.lit(-1))


def run_begins(marks: DataFrame) -> DataFrame:
    return marks.groupBy("run_id").agg(F.max("begin_seq").alias("begin_seq"))


def failed_tokens(marks: DataFrame) -> DataFrame:
    """Tokens whose last outcome since the run began is a quota failure."""
    known = marks.drop("begin_seq").join(run_begins(marks), "run_id")
    failed = _after(F.col("failed_seq"), F.greatest("success_seq", "begin_seq"))
    return known.where(failed).select("run_id", "token")


def run_state(marks: DataFrame, first_token: str) -> DataFrame:
    """Active token, waiting and activity per run.

    A begin makes the first token active and clears the rest; a sync names the
    active token.  A plain call does not end a wait; a begin, a switch, a sync
    or the end of the run does.  After its end a run is inactive until it
    begins again.
    """
    used = _after(F.max("used_seq"), F.max("begin_seq"))
    return marks.groupBy("run_id").agg(
        F.when(used, F.max_by("token", "used_seq")).otherwise(F.lit(first_token)).alias("active_token"),
        _after(F.max("waiting_seq"), F.max("settled_seq")).alias("pool_waiting"),
        (F.max("ended_seq").isNull() | _after(F.max("begin_seq"), F.max("ended_seq"))).alias(
            "generation_active"
        ),
    )


def token_board(attempts: DataFrame, token_names: Sequence[str]) -> DataFrame:
    """One row per run and configured token with its priority and status.

    The token list belongs to the run's configuration; it is exploded from a
    literal, so there is no join of runs with tokens.
    """
    return board_from_marks(token_marks(attempts), token_names)


def board_from_marks(marks: DataFrame, token_names: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(n) for n in token_names])
    slots = run_state(marks, token_names[0]).select(
        "*", F.posexplode(names).alias("_pos", "token")
    )
    failed = failed_tokens(marks).withColumn("_failed", F.lit(True))
    return slots.join(failed, ["run_id", "token"], "left").select(
        "run_id",
        "token",
        (F.col("_pos") + 1).cast("bigint").alias("priority"),
        F.when(F.col("pool_waiting"), F.lit("waiting"))
        .when((F.col("token") == F.col("active_token")) & F.col("generation_active"), F.lit("active"))
        .when(F.col("_failed"), F.lit("failed"))
        .otherwise(F.lit("idle"))
        .alias("status"),
    )


def snapshot_marks(attempts: DataFrame) -> DataFrame:
    """token_marks with what a snapshot needs besides: last placement and last call of each token."""
    return attempts.groupBy("run_id", "token").agg(
        *_mark_columns(),
        F.max(_seq_if(PLACES_TOKEN)).alias("placed_seq"),
        F.max(_seq_if((CALLING,))).alias("calling_seq"),
        F.max_by("chunk_id", _seq_if((CALLING,))).alias("calling_chunk"),
    )


def pool_snapshot(
    marks: DataFrame, usage: DataFrame, switches: DataFrame, token_names: Sequence[str], total_chunks: int
) -> DataFrame:
    """Everything that a board shows of a run, one row per run.

    ``marks`` as by snapshot_marks; ``usage`` and ``switches`` are the kept
    histories.  All arrays are bounded: a status per configured token, the
    newest SHOWN_USAGE uses and KEPT_SWITCHES switches, oldest first.  Failed
    tokens are in order of priority, those not configured after them by name.
    The index is that of the token last placed by a begin, switch or sync; a
    mere call does not move it.
    """
    names = F.array(*[F.lit(n) for n in token_names])
    begin = F.max("begin_seq")
    placed, called = _after(F.max("placed_seq"), begin), _after(F.max("calling_seq"), begin)
    position = F.array_position(names, F.max_by("token", "placed_seq")).cast("bigint")
    more = marks.groupBy("run_id").agg(
        F.when(placed, position).otherwise(F.lit(1).cast("bigint")).alias("active_token_index"),
        F.when(called, F.max_by("calling_chunk", "calling_seq")).otherwise(F.lit(0).cast("bigint")).alias("current_chunk"),
    )
    failed = failed_tokens(marks).groupBy("run_id").agg(F.array_sort(F.collect_set("token")).alias("_failed"))
    shown = newest_per_key(usage, ["run_id"], "seq", SHOWN_USAGE)
    uses = shown.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "token", "chunk_id", "status", "epoch"))).alias("_usage")
    )
    moves = switches.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "from_token", "to_token", "reason", "chunk_id"))).alias("_switches")
    )
    none = F.array().cast("array<string>")
    board = run_state(marks, token_names[0]).join(more, "run_id")
    for part in (failed, uses, moves):
        board = board.join(part, "run_id", "left")
    lost = F.coalesce("_failed", none)
    status = (
        lambda name: F.when(F.col("pool_waiting"), F.lit("waiting"))
        .when((name == F.col("active_token")) & F.col("generation_active"), F.lit("active"))
        .when(F.array_contains(lost, name), F.lit("failed"))
        .otherwise(F.lit("idle"))
    )
    return board.select(
        "run_id",
        "generation_active",
        F.lit(len(token_names)).cast("bigint").alias("total_tokens"),
        "active_token_index",
        F.col("active_token").alias("active_token_name"),
        F.concat(F.filter(names, lambda n: F.array_contains(lost, n)), F.array_except(lost, names)).alias("failed_tokens"),
        "pool_waiting",
        "current_chunk",
        F.lit(total_chunks).cast("bigint").alias("total_chunks"),
        F.greatest(F.size("_switches"), F.lit(0)).cast("bigint").alias("quota_failovers"),
        F.transform(
            names, lambda n, i: F.struct(n.alias("name"), (i + 1).alias("priority"), status(n).alias("status"))
        ).alias("tokens"),
        F.col("_usage").alias("usage_history"),
        F.col("_switches").alias("switch_history"),
    )


# ---------------------------------------------------------------- attempts ---
def attempt_manifest(records: DataFrame) -> DataFrame:
    """Last record per intake and chunk; rows without either key are skipped."""
    rest = [c for c in records.columns if c not in ("intake_id", "chunk_index")]
    keyed = records.where((F.col("intake_id") != "") & F.col("chunk_index").isNotNull())
    return newest_record(keyed, "intake_id", "chunk_index").select("intake_id", "chunk_index", *rest)


def _mentions(text: Column, marks: Sequence[str]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def is_rate_limit(message: Column) -> Column:
    return _mentions(F.upper(message), RATE_LIMIT_MARKS)


def error_class(message: Column) -> tuple[Column, Column]:
    """Result class and the message shown for it."""
    upper = F.upper(message)
    quota, invalid = _mentions(upper, QUOTA_MARKS), _mentions(upper, INVALID_MARKS)
    result = F.when(quota, F.lit("quota")).otherwise(F.lit("invalid"))
    shown = (
        F.when(quota, F.lit(QUOTA_MESSAGE))
        .when(invalid, F.lit(INVALID_MESSAGE))
        .when(message == "", F.lit(NO_MESSAGE))
        .otherwise(F.substring(message, 1, MAX_MESSAGE))
    )
    return result, shown


def attempt_summary(attempts: DataFrame, *by: str) -> DataFrame:
    """Successes, failures and minutes between the first and last event."""
    span = F.max("epoch") - F.min("epoch")
    return attempts.groupBy(*by).agg(
        F.count_if(F.col("status") == SUCCEEDED).alias("successful"),
        F.count_if(F.col("status") == FAILED).alias("failed"),
        F.round(span / 60, 2).alias("total_minutes"),
    )
