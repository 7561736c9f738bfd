"""The token pool as a keyed state machine: one stream, all views.

State is kept per run and token: the last positions that matter, the newest
uses and switches since the run began.  All of it is a maximum or a newest-k of
positions, so the result does not depend on the order in which events arrive.
Before the shuffle each task folds its rows of a run and token into one, so a
run with a third of all events reaches its state in a few rows a task.  The
begin and the end of a run go to every token of its configuration; a timer in
event time drops the state of a run some time after its end.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from narralake.operators import telemetry as tm

USE = ("seq", "chunk_id", "status", "epoch")
SWITCH = ("seq", "chunk_id", "from_token", "to_token", "reason")
USE_TYPE = "seq bigint, chunk_id bigint, status string, epoch bigint"
SWITCH_TYPE = "seq bigint, chunk_id bigint, from_token string, to_token string, reason string"
MARKS_TYPE = (
    "failed_seq bigint, success_seq bigint, used_seq bigint, waiting_seq bigint, settled_seq bigint, "
    "ended_seq bigint, begin_seq bigint, placed_seq bigint, calling_seq bigint, calling_chunk bigint, ended_ms bigint"
)
STATE = (
    f"run_id bigint, token string, {MARKS_TYPE}, "
    f"usage array<struct<{USE_TYPE}>>, switches array<struct<{SWITCH_TYPE}>>"
)
PARTIAL = f"{STATE}, ts timestamp"

#: Which statuses move which mark.
MARKED = {
    "failed_seq": (tm.FAILED,),
    "success_seq": (tm.SUCCEEDED,),
    "used_seq": tm.USES_TOKEN,
    "waiting_seq": (tm.WAITING,),
    "settled_seq": tm.ENDS_WAIT,
    "ended_seq": (tm.ENDED,),
    "begin_seq": (tm.BEGIN,),
    "placed_seq": (tm.SWITCHED, "synced"),
    "calling_seq": ("calling",),
}
MARKS = (*MARKED, "calling_chunk", "ended_ms")
#: The marks that an event of a status moves.
MOVES = {s: [m for m, states in MARKED.items() if s in states] for s in {s for states in MARKED.values() for s in states}}
#: Entries of a history that wait, beyond those kept, until `add` drops the old ones.
SPARE = 200


class TokenState:
    """What is known of a token in a run; `add` and `merge` may come in any order."""

    def __init__(self, marks: Sequence | None = None, usage: Sequence = (), switches: Sequence = ()):
        self.marks = dict(zip(MARKS, marks or (None,) * len(MARKS)))
        self.usage = {u[0]: tuple(u) for u in usage}
        self.switches = {s[0]: tuple(s) for s in switches}

    def add(self, event: dict) -> None:
        seq, status, marks = event["seq"], event["status"], self.marks
        for m in MOVES.get(status, ()):
            if marks[m] is None or seq > marks[m]:
                marks[m] = seq
                if m == "calling_seq":
                    marks["calling_chunk"] = event["chunk_id"]
                elif m == "ended_seq":
                    marks["ended_ms"] = int(event["ts"].timestamp() * 1000)
        if status in tm.USAGE_STATES:
            self.usage[seq] = tuple(event[c] for c in USE)
        if status == tm.SWITCHED:
            self.switches[seq] = tuple(event[c] for c in SWITCH)
        if len(self.usage) > tm.KEPT_USAGE + SPARE or len(self.switches) > tm.KEPT_SWITCHES + SPARE:
            self._prune()

    def merge(self, other: TokenState) -> None:
        mine, new = self.marks, other.marks
        for late, beside in (("calling_seq", "calling_chunk"), ("ended_seq", "ended_ms")):
            if new[late] is not None and (mine[late] is None or new[late] > mine[late]):
                mine[beside] = new[beside]
        for m in MARKED:
            if new[m] is not None and (mine[m] is None or new[m] > mine[m]):
                mine[m] = new[m]
        self.usage |= other.usage
        self.switches |= other.switches
        self._prune()

    def _prune(self) -> None:
        """Histories start at the last begin and hold the newest entries."""
        begin = self.marks["begin_seq"]
        for held, size in ((self.usage, tm.KEPT_USAGE), (self.switches, tm.KEPT_SWITCHES)):
            if begin is not None:
                for seq in [s for s in held if s <= begin]:
                    del held[seq]
            for seq in sorted(held)[: max(0, len(held) - size)]:
                del held[seq]

    def ended(self) -> bool:
        end, begin = self.marks["ended_seq"], self.marks["begin_seq"]
        return end is not None and (begin is None or end > begin)

    def row(self, run_id: int, token: str) -> dict:
        self._prune()
        in_order = lambda held, names: [dict(zip(names, held[s])) for s in sorted(held)]
        return {
            "run_id": run_id,
            "token": token,
            **self.marks,
            "usage": in_order(self.usage, USE),
            "switches": in_order(self.switches, SWITCH),
        }


#: Keys that a task folds before it hands them on.
HELD = 5_000


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple, list] = {}
    schema = None

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(
            [{**state.row(*key), "ts": ts} for key, (state, ts) in held.items()], schema
        )

    for batch in batches:
        if schema is None:
            use = pa.struct([(n, pa.string() if n == "status" else pa.int64()) for n in USE])
            switch = pa.struct([(n, pa.int64() if n in ("seq", "chunk_id") else pa.string()) for n in SWITCH])
            schema = pa.schema(
                [("run_id", pa.int64()), ("token", pa.string()), *((m, pa.int64()) for m in MARKS),
                 ("usage", pa.list_(use)), ("switches", pa.list_(switch)), ("ts", batch.schema.field("ts").type)]
            )
        for event in batch.to_pylist():
            entry = held.setdefault((event["run_id"], event["token"]), [TokenState(), event["ts"]])
            entry[0].add(event)
            entry[1] = max(entry[1], event["ts"])
        if len(held) >= HELD:
            yield rows()
            held.clear()
    if held:
        yield rows()


class PoolProcessor(StatefulProcessor):
    """Merges folded rows into the state of (run, token) and emits it whole when it changes."""

    def __init__(self, retention_ms: int):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.marks = handle.getValueState("marks", MARKS_TYPE)
        self.usage = handle.getMapState("usage", "seq bigint", USE_TYPE.replace("seq bigint", "used bigint"))
        self.switches = handle.getMapState("switches", "seq bigint", SWITCH_TYPE.replace("seq bigint", "switched bigint"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state = TokenState(
            self.marks.get() if self.marks.exists() else None,
            [v for _, v in self.usage.iterator()],
            [v for _, v in self.switches.iterator()],
        )
        before = {*state.usage}, {*state.switches}
        entries = lambda r, part, names: [[e[n] for n in names] for e in r[part]]
        for r in rows:
            marks = [r[m] for m in MARKS]
            state.merge(TokenState(marks, entries(r, "usage", USE), entries(r, "switches", SWITCH)))
        self.marks.update(tuple(state.marks.values()))
        for stored, held, old in zip((self.usage, self.switches), (state.usage, state.switches), before):
            for seq in old - held.keys():
                stored.removeKey((seq,))
            for seq in held.keys() - old:
                stored.updateValue((seq,), held[seq])
        if state.ended():
            at = max(state.marks["ended_ms"] + self.retention_ms, timerValues.getCurrentWatermarkInMs() + 1)
            self.handle.registerTimer(at)
        yield Row(**state.row(*key))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Forget a run that is still over; what was emitted last stays in the stored table."""
        if self.marks.exists():
            state = TokenState(self.marks.get())
            past = timerValues.getCurrentWatermarkInMs()
            if state.ended() and state.marks["ended_ms"] + self.retention_ms <= past:
                self.marks.clear()
                self.usage.clear()
                self.switches.clear()
        return iter(())

    def close(self) -> None:
        pass


def token_states(
    attempts: DataFrame, token_names: Sequence[str], delay: str, retention_seconds: int
) -> DataFrame:
    """The changing state of each run and token as a stream of whole rows.

    ``attempts`` has the columns of an attempt log and its time ``ts``.  Events
    that come later than ``delay`` are dropped; ``retention_seconds`` after its
    end, in event time, a run's state is dropped, too.
    """
    whole_run = F.col("status").isin(tm.BEGIN, tm.ENDED)
    names = F.array(*(F.lit(n) for n in token_names))
    own = F.array("token")
    spread = F.explode(F.when(whole_run, F.array_union(names, own)).otherwise(own))
    columns = ["run_id", "seq", "status", "chunk_id", "epoch", "from_token", "to_token", "reason", "ts"]
    folded = attempts.select(*columns, spread.alias("token")).mapInArrow(_fold, PARTIAL)
    return (
        folded.withWatermark("ts", delay)
        .groupBy("run_id", "token")
        .transformWithState(PoolProcessor(retention_seconds * 1000), STATE, "Update", "eventTime")
    )
