"""Whether each intake's statuses follow one another as they may.

The statuses are an automaton.  What a stretch of a log does to it is a small
record: the status it starts and ends with, and what happened inside.  Such
records join end to end, so an intake may be cut anywhere.  The log is cut by
ranges of (intake, seq), which Spark finds by sampling: however many records an
intake has and however far apart their numbers are, stretches are even, and
their records are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The statuses, and which may follow which; a log starts with the first.
STATES = ("generating", "waiting_quota", "merging", "completed", "failed", "cancelling", "cancelled")
MAY_FOLLOW = {
    "generating": ("waiting_quota", "merging", "cancelling", "cancelled", "failed"),
    "waiting_quota": ("generating", "cancelling", "cancelled", "failed"),
    "merging": ("completed", "cancelling", "cancelled", "failed"),
    "cancelling": ("cancelled", "failed"),
    "completed": ("generating",),
    "failed": ("generating",),
    "cancelled": ("generating",),
}
#: A status is 1 to 7 in the last three bits of a packed number, 0 if it is none of them.
BITS = 3
START = "generating"


def _code(status: str) -> int:
    return STATES.index(status) + 1


def _status(packed: Column) -> Column:
    return packed.bitwiseAND((1 << BITS) - 1)


def _differs(before: Column, after: Column) -> Column:
    return _status(before) != _status(after)


def _illegal(before: Column, after: Column) -> Column:
    legal = [_code(a) << BITS | _code(b) for a, follow in MAY_FOLLOW.items() for b in follow]
    step = F.shiftleft(_status(before).cast("int"), BITS).bitwiseOR(_status(after).cast("int"))
    return _differs(before, after) & ~step.isin(legal)


def stretches(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per intake and range of the log: first, last (packed), records, changes, illegal, bad.

    ``bad`` is the first packed record that may not follow the one before.  A
    record without ``seq`` has no place and is left out; other statuses than
    STATES, and null, follow nothing and are followed by nothing.
    """
    code = F.coalesce(F.array_position(F.array(*(F.lit(s) for s in STATES)), F.col("status")), F.lit(0))
    packed = F.shiftleft(F.col("seq").cast("bigint"), BITS).bitwiseOR(code.cast("bigint"))
    rows = log.where(F.col("seq").isNotNull()).select("intake_id", packed.alias("_p"))
    ranged = (
        rows.repartitionByRange(partitions, "intake_id", "_p") if partitions else rows.repartitionByRange("intake_id", "_p")
    )
    # The array is collected before the shuffle, so it never holds more than one range.
    held = ranged.groupBy("intake_id", F.spark_partition_id().alias("_part")).agg(
        F.array_sort(F.collect_list("_p")).alias("p")
    )
    n = F.size("p")
    early, late = F.slice("p", F.lit(1), n - 1), F.slice("p", F.lit(2), n - 1)
    bad = F.array_compact(F.zip_with(early, late, lambda a, b: F.when(_illegal(a, b), b)))
    moved = F.array_compact(F.zip_with(early, late, lambda a, b: F.when(_differs(a, b), b)))
    return held.select("intake_id", "p", n.alias("records"), bad.alias("bad"), F.size(moved).alias("changes")).select(
        "intake_id",
        F.get("p", F.lit(0)).alias("first"),
        F.get("p", F.col("records") - 1).alias("last"),
        "records",
        "changes",
        F.size("bad").alias("illegal"),
        F.get("bad", F.lit(0)).alias("bad"),
    )


def sequence_check(log: DataFrame, partitions: int | None = None) -> DataFrame:
    """intake_id, records, changes, illegal, first_illegal_seq, final_status of each intake.

    ``changes`` counts records whose status is not that of the one before,
    ``illegal`` those among them, and first records, that MAY_FOLLOW does not
    allow.  Equal records count once each but change nothing.  final_status is
    null if it is none of STATES.
    """
    in_order = Window.partitionBy("intake_id").orderBy("first")
    joined = stretches(log, partitions).withColumn("before", F.lag("last").over(in_order))
    opening = F.col("before").isNull() & (_status(F.col("first")) != _code(START))
    seam = F.coalesce(_illegal(F.col("before"), F.col("first")), F.lit(False)) | opening
    change = F.coalesce(_differs(F.col("before"), F.col("first")), F.lit(False))
    number = lambda test: test.cast("bigint")
    checked = joined.groupBy("intake_id").agg(
        F.sum("records").cast("bigint").alias("records"),
        F.sum(F.col("changes") + number(change)).cast("bigint").alias("changes"),
        F.sum(F.col("illegal") + number(seam)).cast("bigint").alias("illegal"),
        F.shiftright(F.min(F.when(seam, F.col("first")).otherwise(F.col("bad"))), BITS).alias("first_illegal_seq"),
        _status(F.max("last")).cast("int").alias("_final"),
    )
    states = F.array(*(F.lit(s) for s in STATES))
    return checked.withColumn("final_status", F.get(states, F.col("_final") - 1)).drop("_final")
