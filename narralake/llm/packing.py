"""Operator 7, best-fit packing: a configuration linear program over the length histogram.

A configuration says how many pieces of each length fill one sequence.  The
program "fewest configurations that hold the whole histogram" is solved by
multiplicative weights: every length has a price, a knapsack table prices the
best completion of a sequence for each length, each length spreads its demand
over the best configuration that has it, and lengths that got too little
become dearer.  Whole multiples are kept, and what rounding leaves is packed by
best fit, again in whole multiples.  All of this sees only the histogram, which
has one number per possible length, so it costs the same for any corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narralake.llm.common import keep, rows_of, table, text_batches
from narralake.llm.tokens import VOCABULARY, byte_pairs

CAPACITY = 1024
END = 2
ROUNDS = 60

Config = tuple[tuple[int, int], ...]  # (length, how many), longest first


# --------------------------------------------------------------- the program
def knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best total price within each room, and the length to take first there (0: none)."""
    best = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        fits = lengths[: np.searchsorted(lengths, room, "right")]
        best[room] = best[room - 1]
        take[room] = -1 if len(fits) else 0
        if len(fits):
            value = best[room - fits] + price[fits]
            i = int(value.argmax())
            if value[i] > best[room] + 1e-12:
                best[room], take[room] = value[i], fits[i]
    return best, take


def completion(length: int, take: np.ndarray, capacity: int) -> dict[int, int]:
    """The best configuration that has a piece of this length."""
    out, room = {length: 1}, capacity - length
    while room > 0:
        got = int(take[room])
        if got < 0:
            room -= 1
        elif got == 0:
            break
        else:
            out[got] = out.get(got, 0) + 1
            room -= got
    return out


def fractional(demand: dict[int, int], capacity: int, rounds: int = ROUNDS) -> dict[Config, float]:
    """Multiplicative weights: configurations with fractional amounts, averaged over the rounds."""
    lengths = np.array(sorted(demand), np.int64)
    need = np.zeros(capacity + 1)
    need[lengths] = [demand[int(s)] for s in lengths]
    price = np.arange(capacity + 1) / capacity
    amount: dict[Config, float] = {}
    got = np.zeros(capacity + 1)
    for turn in range(1, rounds + 1):
        _, take = knapsack(price, lengths, capacity)
        left = need * turn - got  # what this and all rounds before should have held by now
        for s in lengths[::-1]:
            if left[s] <= 0:
                continue
            config = completion(int(s), take, capacity)
            size = min(max(left[k], 0.05 * need[k]) / n for k, n in config.items())
            size = min(size, left[s] / config[int(s)])
            key = tuple(sorted(config.items(), reverse=True))
            amount[key] = amount.get(key, 0.0) + size / rounds
            for k, n in config.items():
                got[k] += size * n
                left[k] -= size * n
        short = np.clip(left[lengths] / need[lengths], -1, 1)
        price[lengths] *= np.exp(0.2 / np.sqrt(turn) * short)
        price[lengths] /= max(1e-12, float((price[lengths] * need[lengths]).sum())) / float(
            (lengths * need[lengths]).sum() / capacity
        )
    return amount


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[int, Config]]:
    """Best fit of decreasing lengths, whole sequences at a time, as often as they repeat."""
    out = []
    left = {s: n for s, n in left.items() if n > 0}
    have = sorted(left)
    while have:
        room, config = capacity, {}
        while True:
            at = int(np.searchsorted(have, room, "right")) - 1
            while at >= 0 and left[have[at]] - config.get(have[at], 0) <= 0:
                at -= 1
            if at < 0:
                break
            s = have[at]
            n = min(room // s, left[s] - config.get(s, 0))
            config[s] = config.get(s, 0) + n
            room -= n * s
        times = min(left[s] // n for s, n in config.items())
        out.append((times, tuple(sorted(config.items(), reverse=True))))
        for s, n in config.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
        have = sorted(left)
    return out


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, Config]]:
    """(times, configuration) that hold the histogram exactly."""
    left = {s: n for s, n in histogram.items() if n > 0}
    out: list[tuple[int, Config]] = []
    if left.get(capacity):
        out.append((left.pop(capacity), ((capacity, 1),)))
    if not left:
        return out
    amount = fractional(left, capacity)

    def waste(config: Config) -> int:
        return capacity - sum(s * n for s, n in config)

    for config, x in sorted(amount.items(), key=lambda c: (waste(c[0]), -c[1], c[0])):
        times = min([int(x), *(left[s] // n for s, n in config)])
        if times:
            out.append((times, config))
            for s, n in config:
                left[s] -= times * n
    return out + best_fit(left, capacity)


def slots(packed: list[tuple[int, Config]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: sorted runs of (length, first rank)."""
    runs, used, sequence = [], {}, 0
    for times, config in packed:
        offset = 0
        for s, n in config:
            runs.append((s, used.get(s, 0), n, sequence, offset))
            used[s] = used.get(s, 0) + times * n
            offset += s * n
        sequence += times
    runs.sort()
    cols = np.array(runs, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "sequence", "offset"), cols, strict=True))


# ------------------------------------------------------------------ the pieces
def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces: only the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


_PIECES = "piece int, start long, length long, ids_crc32 long"


def piece_rows(docs: DataFrame, text: str, key: str, vocabulary: str, capacity: int, end: int) -> DataFrame:
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {_PIECES}"
    tail = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, seen = byte_pairs(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in rows_of(batches):
            own, piece, start, length, crc, nth = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = coder.ids(value) + tail
                for i, (at, n) in enumerate(cut(len(ids) // 4, capacity)):
                    own.append(row)
                    piece.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(memoryview(ids)[4 * at : 4 * (at + n)]))
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(own, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                    pa.array(np.full(len(own), task, np.int32)),
                    pa.array(nth, pa.int64()),
                ],
                names=[key, "piece", "start", "length", "ids_crc32", "_task", "_nth"],
            )

    text_batches(docs)
    return docs.select(key, text).mapInArrow(run, f"{schema}, _task int, _nth long")


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    vocabulary: str = VOCABULARY,
    capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """Pieces of all documents with their sequence_id and offset.

    A null or empty text is the end id alone.  Rows with a null or repeated key
    are packed like any other; only the key column is carried, so clashing
    names cannot occur.  An empty table gives an empty table.  Ties (equal
    lengths) are in the order in which they were read.
    """
    spark = docs.sparkSession
    pieces = keep(piece_rows(docs, text, key, vocabulary, capacity, end), "pieces")
    counts = keep(pieces.groupBy("length", "_task").agg(F.count("*").alias("n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    plan = spark.sparkContext.broadcast(slots(solve(histogram, capacity)))
    # A piece's rank among those of its length: its rank in the task that wrote it, behind all tasks before.
    before = Window.partitionBy("length").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    ranked = pieces.join(first, ["length", "_task"]).withColumn("_rank", F.col("_first") + F.col("_nth"))
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", "_rank")
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, {_PIECES}, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan.value
        order = runs["length"] * (1 << 44) + runs["first"] if len(runs["length"]) else None
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_rank"))
            if not len(length):
                continue
            at = np.searchsorted(order, length * (1 << 44) + rank, "right") - 1
            inside = rank - runs["first"][at]
            each = runs["each"][at]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (key, "piece", "start", "length", "ids_crc32")]
                + [
                    pa.array(runs["sequence"][at] + inside // each),
                    pa.array(runs["offset"][at] + inside % each * length),
                ],
                names=[key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, schema)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op7_best_fit_packing": op7_best_fit_packing}
ORACLES: dict[str, str] = {}
