"""Operator 6, substring dedup: fuzzy repeated passages by collinear chaining.

Seeds are word runs of three lengths.  All short ones count, as few equal words
stand together in passages that are changed every few words; longer ones, thinned
to the least hash in each window of runs, the same in every document, tell
passages apart where the short ones are common.  A seed's first occurrence (least document, then position) stands for
all of them, and every other occurrence is joined to it: links grow with the
text, never with the square of a passage's copies.

A passage of n words with n / 5 of them changed still has n / 5 - 3 runs of four
words, and all of these are links of the later document, to whichever document
has them first.  So links count only where they stand as dense as that.  Pairs
of documents whose own links are as dense, or that share a long seed, are
aligned first; the other pairs, most of which share a common phrase within such
a passage, only where links still stand as dense outside what was found.

Per document, the links to one other document are merged along diagonals and
chained with gap costs through Fenwick trees.  Chains are aligned word by word, gaps with a small edit table,
ends by extension, with more of the texts where it meets the edge; a chain is cut where it stops being alike, and all stretches
of it that are long and alike enough are returned.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm.common import (
    WORD,
    free_shuffles,
    hashed,
    keep,
    lean,
    mix,
    rows_of,
    sieve,
    table,
    text_batches,
    text_slices,
    word_hashes,
)

SEEDS = ((4, 1), (7, 12), (44, 7))  # words of a seed, runs of a window
K = min(k for k, _ in SEEDS)  # words that a match of any seed has
LONG = max(k for k, _ in SEEDS)  # any 50 equal words have a seed of so many
W = 12  # unmatched words inside a match, at most
BUCKET_BITS, SLOT_BITS = 12, 16  # of a seed's hash, in the bitmap of repeated seeds
REST_BITS = 24  # beside those of the bucket, that tell seeds apart for the bitmap
LENGTH = 50
SIMILARITY = 0.8
GAP = 0.04  # cost of a skipped word, on either side
FAR = 64  # words between two matches of a chain that always compete; at twice as many they no longer do
FLANK = 64  # words beside a chain that the first alignment may use
WIDER = 8  # growth of the flank where an alignment meets its edge
STEP = 32  # words on each side that an extension looks at in one step
SENT = 5  # bytes of a word's hash that are sent to the alignments
ROUGH = 2  # bytes of it that tell pairs apart which cannot have a passage
NEAR = 40  # words beside a chain that this looks at
ASKED = 4096  # pairs that ask one copy of a text, about
LEVELS = 8  # of the other rows of a row, by their order


Seeds = tuple[np.ndarray, np.ndarray, np.ndarray]


def seeds(text: str | None) -> Seeds:
    """(hash, word position, words) of the least seed of each window, for each kind of seed; a short text is one window."""
    return _seeds(word_hashes(text))


def _seeds(words: np.ndarray) -> Seeds:
    found = []
    for k, w in SEEDS:
        if len(words) == 0 or found and len(words) < k:
            continue
        runs = run_hashes(words, k)
        at = least(runs, min(w, len(runs)))
        found.append((runs[at], at, np.full(len(at), k, np.int8)))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8))
    return tuple(np.concatenate(c) for c in zip(none, *found, strict=True))


def all_seeds(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The seeds of all texts, and the number of the text of each; long texts are taken as one, but for runs over two of them."""
    words, counts = hashed(texts)
    of, begin = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    long = counts >= max(k + w - 1 for k, w in SEEDS)
    found = []
    for i in np.flatnonzero(~long & (counts > 0)).tolist():
        some = _seeds(words[begin[i] : begin[i] + counts[i]])
        found.append((*some, np.full(len(some[0]), i)))
    here = long[of]
    at = np.arange(len(words))[here] - begin[of][here]
    words, of = words[here], of[here]
    left = counts[of] - at  # words from here to the end of the text
    for k, w in SEEDS if len(words) else ():
        runs = run_hashes(words, k)
        some = left[: len(runs)] >= k
        if w > 1:
            padded = np.zeros(len(runs) + w - 1, np.uint64)
            inside = left[: len(runs) - w + 1] >= k + w - 1
            padded[w - 1 : len(runs)] = np.where(inside, sliding(np.minimum, runs, w), np.uint64(0))
            some &= runs == sliding(np.maximum, padded, w)
        some = np.flatnonzero(some)
        found.append((runs[some], at[some], np.full(len(some), k, np.int8), of[some]))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(none, *found, strict=True))


def sliding(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The least or greatest of each window, put together from windows of doubling width."""
    size = 1
    while 2 * size <= width:
        values, size = best(values[:-size], values[size:]), 2 * size
    rest = width - size
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def least(runs: np.ndarray, width: int) -> np.ndarray:
    """The places that have the least value of some window, in order."""
    if width == 1:
        return np.arange(len(runs))
    padded = np.zeros(len(runs) + width - 1, np.uint64)
    padded[width - 1 : len(runs)] = sliding(np.minimum, runs, width)
    return np.flatnonzero(runs == sliding(np.maximum, padded, width))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words, put together from runs of doubling length; a shorter text is one run."""
    n = min(n, len(words))
    size, power, runs = 1, 0x9E3779B97F4A7C15, words
    out, done = np.zeros(len(words), np.uint64), 0
    while True:
        if n & size:
            out = out[: len(words) - done - size + 1] * np.uint64(power) + runs[done : len(words) - size + 1]
            done += size
        if 2 * size > n:
            return mix(out ^ np.uint64(n))
        runs = runs[:-size] * np.uint64(power) + runs[size:]
        power, size = power * power % 2**64, 2 * size


def _row(key: str, text: str) -> Column:
    """The id of a row: equal rows are one document."""
    return F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))


def sorted_runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns, as arrays, of each run of rows with equal values in the first `keys` of them."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            cols = [np.concatenate(c) for c in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        new = np.zeros(len(cols[0]) - 1, bool)
        for c in cols[:keys]:
            new |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1).tolist()]
        for at, end in zip(cuts, cuts[1:], strict=False):
            yield [c[at:end] for c in cols]
        rest = [c[cuts[-1] :] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


def packed(values: np.ndarray, size: int) -> bytes:
    """The low bytes of whole numbers by significance, so that those that are nearly always zero compress."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(size, -1).T
    return out.view("<u8").ravel()


def _steps(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of sorted values in groups that begin at `start`: each less the one before it in its group."""
    out = np.diff(values, prepend=values[:1])
    out[start] = values[start]
    return out


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted values, and where each begins."""
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return values[start], start


@lean
def _mark_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, and steps between REST_BITS more bits of each seed's hash in it; a seed counts twice a chunk at most."""
    held: list[np.ndarray] = []

    def rows() -> pa.RecordBatch:
        h = np.sort(np.concatenate([np.zeros(0, np.uint64), *held]))
        h = h[np.r_[np.ones(min(2, len(h)), bool), h[2:] != h[:-2]]]
        buckets, start = _runs((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        rest = _steps((h >> np.uint64(64 - BUCKET_BITS - REST_BITS)) & np.uint64(2**REST_BITS - 1), start)
        blobs = [packed(r, 3) for r in np.split(rest, start[1:])] if len(h) else []
        return pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "rest": pa.array(blobs, pa.binary())})

    n = 0
    for batch in text_slices(batches, 1):
        held.append(all_seeds(batch.column(1))[0])
        n += len(held[-1])
        if n > 1_000_000:
            yield rows()
            held.clear()
            n = 0
    yield rows()


def _slots(rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a seed in the bitmap of its bucket, by its REST_BITS."""
    other = (rest * np.uint32(0x9E3779B1)) & np.uint32(2**REST_BITS - 1)
    return rest >> np.uint32(REST_BITS - SLOT_BITS), other >> np.uint32(REST_BITS - SLOT_BITS)


def _repeated_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, and a bitmap of the hashes that more than one seed has."""
    for bucket, rest in sorted_runs(batches, ["bucket", "rest"], 1):
        values = np.sort(np.concatenate([np.cumsum(unpacked(r, 3)) for r in rest])).astype(np.uint32)
        marked = np.zeros(1 << SLOT_BITS, bool)
        for slot in _slots(values[1:][values[1:] == values[:-1]]):
            marked[slot] = True
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array([int(bucket[0])], pa.int32()), "bits": pa.array([np.packbits(marked).tobytes()], pa.binary())}
        )


def repeated_seeds(rows: DataFrame) -> np.ndarray:
    """A bitmap of fixed size that has every seed which occurs twice, and few others.

    It saves the shuffles of single seeds; the join after it still decides.
    A seed has two bits there.  With some hundred million repeated seeds about
    a third of the others pass.
    """
    bits = (
        rows.mapInArrow(_mark_rows, "bucket int, rest binary")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_repeated_bits, "bucket int, bits binary")
    )
    out = np.zeros((1 << BUCKET_BITS, (1 << SLOT_BITS) // 8), np.uint8)
    for bucket, found in keep(bits, "marks").collect():  # 32 MB at most
        out[bucket] = np.frombuffer(found, np.uint8)
    free_shuffles(rows.sparkSession)  # once more: till the collect, Spark held the job before it
    return out.ravel()


REST = 5  # bytes of a seed's hash beside its bucket that tell seeds apart: 48 bits in all
_SEEDS = "bucket int, rest binary, row binary, pos binary, words binary"


def _seed_rows(marks: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The marked seeds, a row for each chunk of texts and bucket: sorted hashes by their steps, rows, places, words."""

    def rows(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8))
        h, row, pos, words = (np.concatenate(c) for c in zip(none, *held, strict=True))
        order = np.argsort(h)
        h, row, pos, words = h[order], row[order], pos[order], words[order]
        buckets, start = _runs((h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        rest = _steps((h >> np.uint64(64 - BUCKET_BITS - 36)) & np.uint64(2**36 - 1), start)
        ends = [*start[1:].tolist(), len(h)]
        parts = list(zip(start.tolist(), ends, strict=True)) if len(h) else []
        blobs = {
            "rest": [packed(rest[i:j], REST) for i, j in parts],
            "row": [row[i:j].tobytes() for i, j in parts],
            "pos": [packed(pos[i:j], 4) for i, j in parts],
            "words": [words[i:j].tobytes() for i, j in parts],
        }
        return pa.RecordBatch.from_pydict(
            {"bucket": pa.array(buckets, pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in blobs.items()}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, n = marks.value, [], 0
        for batch in text_slices(batches, 1):
            hashes, at, size, of = all_seeds(batch.column(1))
            row = batch.column(0).to_numpy()[of]
            bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) << SLOT_BITS
            rest = ((hashes >> np.uint64(64 - BUCKET_BITS - REST_BITS)) & np.uint64(2**REST_BITS - 1)).astype(np.uint32)
            one, other = _slots(rest)
            keep_ = np.arange(len(hashes))
            for slots in (one, other):
                slot = bucket[keep_] + slots[keep_]
                keep_ = keep_[(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1]
            held.append((hashes[keep_], row[keep_], at[keep_], size[keep_]))
            n += len(held[-1][0])
            if n > 500_000:
                yield rows(held)
                held, n = [], 0
        yield rows(held)

    return lean(run)


_LINKS = "row long, ref long, pos int, ref_pos int, words byte"


Links = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # as _LINKS


def _link_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[Links]:
    """A link from each seed that is not in the least row of its hash to its first place there, by row and other row.

    Comes sorted by bucket, and takes some buckets at a time.
    """

    def links(held: list[tuple[np.ndarray, ...]]) -> Links:
        h, row, pos, words = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(h)
        h, row, pos, words = h[order], row[order], pos[order], words[order]
        _, start = _runs(h)
        size = np.diff(start, append=len(h))
        ref = np.repeat(np.minimum.reduceat(row, start), size)
        own = row == ref
        ref_pos = np.repeat(np.minimum.reduceat(np.where(own, pos, np.iinfo(np.int64).max), start), size)
        later = np.flatnonzero(~own)
        # Links of a pair stand together, which the shuffle's compression needs.
        later = later[np.lexsort((ref[later], row[later]))]
        return row[later], ref[later], pos[later].astype("<i4"), ref_pos[later].astype("<i4"), words[later]

    held, n = [], 0
    for bucket, *blobs in sorted_runs(batches, ["bucket", "rest", "row", "pos", "words"], 1):
        for rest, row, pos, words in zip(*blobs, strict=True):
            h = np.cumsum(unpacked(rest, REST)) + (np.uint64(bucket[0]) << np.uint64(36))
            held.append((h, np.frombuffer(row, "<i8"), unpacked(pos, 4).astype(np.int64), np.frombuffer(words, np.int8)))
            n += len(h)
        if n > 500_000:
            yield links(held)
            held, n = [], 0
    if held:
        yield links(held)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each link."""
    for found in _link_arrays(batches):
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["row", "ref", "pos", "ref_pos", "words"])


LINK = 25  # bytes: row, other row, both places, words


@lean
def _link_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket (of the row), and the bytes of its links by significance, for some links at a time."""
    for found in _link_arrays(batches):
        n = len(found[0])
        sent = np.concatenate([c.view(np.uint8).reshape(n, -1) for c in found], axis=1) if n else np.zeros((0, LINK), np.uint8)
        order = np.argsort((found[0].view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16), kind="stable")
        sent = sent[order]
        buckets, start = _runs((found[0][order].view(np.uint64) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32))
        ends = [*start[1:].tolist(), n]
        blobs = [sent[i:j].T.tobytes() for i, j in zip(start.tolist(), ends[: len(start)], strict=True)]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(buckets, pa.int32()), "links": pa.array(blobs, pa.binary())})


def _unpacked_links(blobs: np.ndarray) -> Links:
    sent = np.concatenate([np.frombuffer(b, np.uint8).reshape(LINK, -1) for b in blobs], axis=1)
    cols = (np.ascontiguousarray(sent[i:j].T).view(t).ravel() for i, j, t in ((0, 8, "<i8"), (8, 16, "<i8"), (16, 20, "<i4"), (20, 24, "<i4")))
    row, ref, pos, ref_pos = cols
    return row, ref, pos.astype(np.int64), ref_pos.astype(np.int64), sent[24].view(np.int8)


# -------------------------------------------------------------------- chaining
def diagonals(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches of each pair merged along diagonals: (pair, x, y, length), fewer than W + 1 unmatched words apart inside.

    They come by pair, x and y.
    """
    order = np.lexsort((x, x - y, pair))
    pair, x, y = pair[order], x[order], y[order]
    new = (np.diff(pair) != 0) | (np.diff(x - y) != 0) | (np.diff(x) > K + W)
    start = np.flatnonzero(np.concatenate([[True], new]))
    end = np.concatenate([start[1:], [len(x)]]) - 1
    pair, x, y, size = pair[start], x[start], y[start], x[end] - x[start] + K
    order = np.lexsort((y, x, pair))
    return pair[order], x[order], y[order], size[order]


class Fenwick:
    """Best (value, match) at or below a place, for FAR places."""

    def __init__(self) -> None:
        self.best: list[tuple[float, int]] = [(-np.inf, -1)] * (FAR + 1)

    def put(self, place: int, value: float, match: int) -> None:
        place += 1
        while place <= FAR:
            if value > self.best[place][0]:
                self.best[place] = (value, match)
            place += place & -place

    def upto(self, place: int) -> tuple[float, int]:
        place, found = place + 1, (-np.inf, -1)
        while place:
            if self.best[place][0] > found[0]:
                found = self.best[place]
            place &= place - 1
        return found


def chains(x: np.ndarray, y: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of (x, y, length), best first; every match is in one chain at most.

    A match goes on from the one with the best score, less GAP for each word
    between, among those that end before it on both sides and at most FAR words
    away; some up to twice as far compete, too.  Matches come by their start in
    x, and ended ones are in a Fenwick tree over their end in y.  There is a
    tree for each square of FAR by FAR words, so that far ones are out of reach
    however good they are, and trees that x has passed are dropped.
    """
    return _best_chains(list(zip(*(c.tolist() for c in diagonals(np.zeros(len(x), np.int8), x, y)[1:]), strict=True)))


def _best_chains(rows: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    if len(rows) == 1:
        return [rows]
    n = len(rows)
    score, before = [0.0] * n, [-1] * n
    by_end = sorted(range(n), key=lambda i: rows[i][0] + rows[i][2])
    trees: dict[int, dict[int, Fenwick]] = {}  # by square of x, then of y
    waiting = 0
    for i, (px, py, size) in enumerate(rows):
        while waiting < n:
            j = by_end[waiting]
            ex, ey = rows[j][0] + rows[j][2], rows[j][1] + rows[j][2]
            if ex > px:
                break
            column = trees.setdefault(ex // FAR, {})
            column.setdefault(ey // FAR, Fenwick()).put(ey % FAR, score[j] + GAP * (ex + ey), j)
            waiting += 1
        for passed in [c for c in trees if c < px // FAR - 1]:
            del trees[passed]
        best = (-np.inf, -1)
        for column in trees.values():
            for square, top in ((py // FAR, py % FAR), (py // FAR - 1, FAR - 1)):
                if square in column:
                    best = max(best, column[square].upto(top))
        gain = best[0] - GAP * (px + py)
        score[i] = float(size)
        if gain > 0:
            score[i], before[i] = size + gain, best[1]
    used = [False] * n
    out = []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            chain.append(rows[at])
            at = before[at]
        if chain:
            out.append(chain[::-1])
    return out


#: Runs of K words that LENGTH words have at least, if a fifth of them is changed.
DENSE = 7


def dense(at: np.ndarray) -> np.ndarray:
    """Which of the sorted, distinct places of seeds may belong to a passage.

    A passage of n >= LENGTH words on a side has n / 5 - 3 seeds at least: a
    changed word breaks K of its n - 3 runs, a word put in breaks three.  So a
    seed counts if some range of DENSE or more seeds around it spans
    at most five words a seed and fifteen more.
    """
    n = np.arange(len(at))
    up = 5 * n - at
    top = np.maximum.accumulate(up[::-1])[::-1]
    last = np.searchsorted(-top, 16 - up, side="right") - 1  # the farthest j with up[j] >= up[i] - 16
    ok = last - n + 1 >= DENSE
    marks = np.zeros(len(at) + 1, np.int64)
    np.add.at(marks, n[ok], 1)
    np.add.at(marks, last[ok] + 1, -1)
    return np.cumsum(marks[:-1]) > 0


def _chained(pair: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> list[tuple[list[int], list[int]]]:
    """Of each of n pairs, all with matches, its chains as flat triples with a size before each chain, and their ends."""
    of, *parts = diagonals(pair, x, y)
    rows = list(zip(*(c.tolist() for c in parts), strict=True))
    cuts = np.searchsorted(of, np.arange(n + 1)).tolist()
    out = []
    for i, j in zip(cuts, cuts[1:], strict=False):
        flat, ends = [], []
        for c in _best_chains(rows[i:j]):
            flat.append(len(c))
            for part in c:
                flat += part
            ends += _ends_of(c)
        out.append((flat, ends))
    return out


def _ints(values: list[int] | np.ndarray) -> bytes:
    return np.array(values, "<i4").tobytes()


def _joined_ints(blobs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of all blobs, and of which blob each is."""
    values = np.frombuffer(b"".join(blobs), "<i4").astype(np.int64)
    return values, np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])


def _dense_in(group: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places are dense among the distinct ones of their group; groups are counted from 0."""
    if len(at) == 0:
        return np.zeros(0, bool)
    place = group * (int(at.max()) + 5 * len(at) + 17) + at  # so far apart that no range spans two groups
    known, which = np.unique(place, return_inverse=True)
    return dense(known)[which]


def _places_of(row: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The wanted ones of the rows, each with its different places in order."""
    some = np.isin(row, wanted)
    row, x = row[some], x[some]
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    new = np.concatenate([np.ones(min(1, len(x)), bool), (np.diff(row) != 0) | (np.diff(x) != 0)])
    row, x = row[new], x[new]
    rows, start = _runs(row)
    cuts, places = [*start.tolist(), len(row)], _ints(x)
    return rows.tolist(), [places[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:], strict=False)]


def _may_be_dense(row: np.ndarray, ref: np.ndarray, x: np.ndarray, pair: np.ndarray, start: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """Which of the weak pairs have a link that is dense among the seeds that both rows may have.

    Links come by row and ref, those of a pair from its start on.  A link goes
    to the least row that has its seed, so a row before that has it not: of the
    links of a row only those to the same or a lesser row than ref count for
    ref.  A row's pairs are taken in LEVELS steps, each by its greatest ref.
    """
    group = np.cumsum(np.diff(row, prepend=row[:1]) != 0)
    place = group * (int(x.max()) + 5 * len(x) + 17) + x
    order = np.argsort(place)
    known, first = _runs(place[order])
    which = np.empty(len(place), np.int64)
    which[order] = np.repeat(np.arange(len(known)), np.diff(first, append=len(place)))
    least, of = np.minimum.reduceat(ref[order], first), group[order][first]
    weak_pairs = np.flatnonzero(weak)
    mine = group[start[weak_pairs]]
    size = np.bincount(mine, minlength=group[-1] + 1)
    rank = np.arange(len(mine)) - np.searchsorted(mine, mine)
    level = rank * LEVELS // np.maximum(size[mine], LEVELS)
    out = np.zeros(len(start), bool)
    for step in range(LEVELS):
        some = weak_pairs[level == step]
        if len(some) == 0:
            break
        top = np.full(len(size), np.iinfo(np.int64).min)
        np.maximum.at(top, group[start[some]], ref[start[some]])
        may = np.flatnonzero(least <= top[of])
        ok = np.zeros(len(known), bool)
        ok[may[dense(known[may])]] = True
        asked = np.zeros(len(start), bool)
        asked[some] = True
        out[pair[asked[pair] & ok[which]]] = True
    return out


_CHAINS = "row long, ref long, strong boolean, parts binary, ends binary, at binary"
_PAIRS = "row long, ref long, parts binary, ends binary"


@lean
def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row and each other row with links where links are dense, the chains if the pair is strong.

    parts has the matches as flat triples with a size before each chain, ends
    their four ends.  A pair that is not strong has the places of its links
    instead, at in the row and parts in the other: few are ever chained.
    Pairs whose links lie where too few words can stand in both are left out;
    a row with itself has the places of their links, where it has weak pairs.
    """

    def rows(links: list[Links]) -> pa.RecordBatch:
        row, ref, x, y, words = (np.concatenate(c) for c in zip(*links, strict=True))
        live = _dense_in(np.unique(row, return_inverse=True)[1], x)
        row, ref, x, y, words = (c[live] for c in (row, ref, x, y, words))
        order = np.lexsort((ref, row))
        row, ref, x, y, words = (c[order] for c in (row, ref, x, y, words))
        start = np.flatnonzero(np.concatenate([np.ones(min(1, len(row)), bool), (np.diff(row) != 0) | (np.diff(ref) != 0)]))
        n = len(start)
        pair = np.repeat(np.arange(n), np.diff(start, append=len(row)))
        strong = np.zeros(n, bool)
        strong[pair[(words == LONG) | _dense_in(pair, x)]] = True
        others: tuple[list, list] = ([], [])
        if n:
            some = strong | _may_be_dense(row, ref, x, pair, start, ~strong)
            here, start = some[pair], start[some]
            others = _places_of(row[~here], x[~here], row[start[~strong[some]]])
            row, ref, x, y, pair, strong = row[here], ref[here], x[here], y[here], (np.cumsum(some) - 1)[pair[here]], strong[some]
            n, start = len(start), np.searchsorted(pair, np.arange(len(start)))
        some = strong[pair]
        found = _chained((np.cumsum(strong) - 1)[pair[some]], x[some], y[some], int(strong.sum())) if n else []
        parts, ends, at = [b""] * n, [b""] * n, [b""] * n
        for i, (flat, four) in zip(np.flatnonzero(strong).tolist(), found, strict=True):
            parts[i], ends[i] = _ints(flat), _ints(four)
        cuts, xs, ys = [*start.tolist(), len(row)], _ints(x), _ints(y)
        for i in np.flatnonzero(~strong).tolist():
            at[i], parts[i] = xs[4 * cuts[i] : 4 * cuts[i + 1]], ys[4 * cuts[i] : 4 * cuts[i + 1]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([*row[start].tolist(), *others[0]], pa.int64()),
                pa.array([*ref[start].tolist(), *others[0]], pa.int64()),
                pa.array([*strong.tolist(), *[False] * len(others[0])], pa.bool_()),
                pa.array([*parts, *others[1]], pa.binary()),
                pa.array([*ends, *[b""] * len(others[0])], pa.binary()),
                pa.array([*at, *others[1]], pa.binary()),
            ],
            names=["row", "ref", "strong", "parts", "ends", "at"],
        )

    held, n = [], 0
    for _, blobs in sorted_runs(batches, ["bucket", "links"], 1):
        held.append(_unpacked_links(blobs))
        n += len(held[-1][0])
        if n > 100_000:
            yield rows(held)
            held, n = [], 0
    if held:
        yield rows(held)


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[np.ndarray]]:
    """The columns, as arrays, of as many rows as come at a time, but no run of equal keys in two parts."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if rest is not None:
            cols = [np.concatenate(c) for c in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        same = np.ones(len(cols[0]), bool)
        for c in cols[:keys]:
            same &= c == c[-1]
        at = len(same) - int(same[::-1].argmin()) if not same.all() else 0
        if at:
            yield [c[:at] for c in cols]
        rest = [c[at:] for c in cols]
    if rest is not None and len(rest[0]):
        yield rest


@lean
def _late_chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of the weak pairs (row, ref) with a link where links are dense outside the found passages.

    Comes sorted by row: passages with their start and end, pairs with start -1, ref and the places of their links.
    """
    for row, start, end, ref, at, parts in whole_runs(batches, ["row", "start", "end", "ref", "at", "parts"], 1):
        group = np.unique(row, return_inverse=True)[1]
        places, of = _joined_ints(at)
        others, _ = _joined_ints(parts)
        span = max(int(end.max()), int(places.max(initial=0)) + K) + 1
        begins, stops = (np.sort((group * span + c)[start >= 0]) for c in (start, end))
        # Inside some passage: more of them have begun than have ended before the seed's last word.
        place = group[of] * span + places
        covered = np.searchsorted(begins, place, "right") > np.searchsorted(stops, place + K - 1, "right")
        bare = np.flatnonzero(~covered)
        wanted = np.zeros(len(row), bool)
        wanted[of[bare[_dense_in(group[of[bare]], places[bare])]]] = True
        wanted &= ref != row
        some = wanted[of]
        if not some.any():
            continue
        found = _chained((np.cumsum(wanted) - 1)[of[some]], places[some], others[some], int(wanted.sum()))
        yield pa.RecordBatch.from_pydict(
            {
                "row": pa.array(row[wanted], pa.int64()),
                "ref": pa.array(ref[wanted], pa.int64()),
                "parts": pa.array([_ints(p) for p, _ in found], pa.binary()),
                "ends": pa.array([_ints(e) for _, e in found], pa.binary()),
            }
        )


# ------------------------------------------------------------------- alignment
def common(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions, in both, of a longest common subsequence of two short stretches.

    A row of the edit table is a whole number: a bit that is not set stands
    where the row grows by one.  Only words of a that b has make a new row.
    """
    if len(a) == len(b):
        straight = [i for i, (v, w) in enumerate(zip(a, b, strict=True)) if v == w]
        if len(straight) >= len(a) - 1:
            return straight, straight
    at: dict[int, int] = {}
    for j, w in enumerate(b):
        at[w] = at.get(w, 0) | 1 << j
    full = grown = (1 << len(b)) - 1
    rows, places = [full], [-1]
    for i, w in enumerate(a):
        if w in at:
            both = grown & at[w]
            grown = (grown + both | grown - both) & full
            rows.append(grown)
            places.append(i)
    in_a, in_b, i, j = [], [], len(rows) - 1, len(b)
    low = full
    while i and j:
        if (rows[i] & low).bit_count() == (rows[i - 1] & low).bit_count():
            i -= 1
            continue
        j -= 1
        low >>= 1
        if not rows[i] >> j & 1:
            in_a.append(places[i])
            in_b.append(j)
            i -= 1
    return in_a[::-1], in_b[::-1]


def extended(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Equal words from the start of two texts on, for as long as half of the next STEP words is common.

    The last of the three is how many words the step that ended it had on each side, or beyond.
    """
    found_a, found_b, at_a, at_b = [], [], 0, 0
    while True:
        size, same = STEP, 0
        while True:  # a plain equal run, in doubling looks
            n = min(size, len(a) - at_a - same, len(b) - at_b - same)
            differ = a[at_a + same : at_a + same + n] != b[at_b + same : at_b + same + n]
            run = int(differ.argmax()) if n else 0
            run = run if n and differ[run] else n
            same += run
            if run < n or n < size:
                break
            size *= 2
        found_a.append(np.arange(at_a, at_a + same))
        found_b.append(np.arange(at_b, at_b + same))
        at_a, at_b = at_a + same, at_b + same
        in_a, in_b = common(a[at_a : at_a + STEP].tolist(), b[at_b : at_b + STEP].tolist())
        found_a.append(at_a + np.array(in_a, np.int64))
        found_b.append(at_b + np.array(in_b, np.int64))
        if 2 * len(in_a) < STEP:
            return np.concatenate(found_a), np.concatenate(found_b), (len(a) - at_a, len(b) - at_b)
        at_a, at_b = at_a + in_a[-1] + 1, at_b + in_b[-1] + 1


def matched(
    a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]
) -> tuple[np.ndarray, np.ndarray, tuple[int, int], tuple[int, int]]:
    """Positions, in both texts, of the equal words along a chain and beyond its two ends; what was left at the ends."""
    x, y, _ = chain[0]
    left_a, left_b, before = extended(a[:x][::-1], b[:y][::-1])
    found_a, found_b = [x - 1 - left_a[::-1]], [y - 1 - left_b[::-1]]
    at_a, at_b = x, y
    for x, y, size in chain:
        if x > at_a and y > at_b:
            in_a, in_b = common(a[at_a:x].tolist(), b[at_b:y].tolist())
            found_a.append(at_a + np.array(in_a, np.int64))
            found_b.append(at_b + np.array(in_b, np.int64))
        same = np.flatnonzero(a[x : x + size] == b[y : y + size])
        found_a.append(x + same)
        found_b.append(y + same)
        at_a, at_b = x + size, y + size
    right_a, right_b, behind = extended(a[at_a:], b[at_b:])
    return np.concatenate([*found_a, at_a + right_a]), np.concatenate([*found_b, at_b + right_b]), before, behind


def _segments(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The maximal scoring ranges of matches (Ruzzo and Tompa): +1 an equal word, -2 an exchanged, -1 a lone one."""
    da, db = np.diff(a) - 1, np.diff(b) - 1
    cost = np.minimum(da, db) + np.maximum(da, db)
    starts = np.concatenate([[0], np.flatnonzero(cost) + 1])
    stops = np.concatenate([starts[1:], [len(a)]])
    total = 0
    kept: list[tuple[int, int, int, int]] = []  # sum before, sum after, first, last
    for first, stop, lost in zip(starts.tolist(), stops.tolist(), [0, *cost[cost > 0].tolist()], strict=True):
        total -= lost
        low, total = total, total + stop - first
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][0] >= low:
                at -= 1
            if at < 0 or kept[at][1] >= total:
                kept.append((low, total, first, stop - 1))
                break
            low, first = kept[at][0], kept[at][2]
            del kept[at:]
    return [(first, last) for _, _, first, last in kept]


def stretches(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """First and last of the matches of each passage; a and b are the positions of equal words.

    First the best-scoring ranges that are long and alike enough.  Between
    them, the longest range that is, as long as there is one: a short tail
    behind many exchanged words never pays by its score.
    """
    n = np.arange(len(a))
    # Ranges i..j with u[j] - u[i] >= -1 have equal words for 4/5 of the side; so with v.
    u, v = 5 * n - 4 * a, 5 * n - 4 * b

    def fits(i: int, j: int) -> bool:
        return a[j] - a[i] + 1 >= LENGTH and u[j] - u[i] >= -1 and v[j] - v[i] >= -1

    def longest(lo: int, hi: int) -> tuple[int, int] | None:
        """Of lo..hi."""
        if hi < lo or a[hi] - a[lo] + 1 < LENGTH:
            return None
        best, size = None, 0
        tops = [np.maximum.accumulate(w[lo : hi + 1][::-1])[::-1] for w in (u, v)]
        far = np.searchsorted(a[lo : hi + 1], a[lo : hi + 1] + LENGTH - 1)
        ok = far <= hi - lo
        far = far.clip(max=hi - lo)
        for top, w in zip(tops, (u, v), strict=True):
            ok &= top[far] - w[lo : hi + 1] >= -1
        for i in np.flatnonzero(ok).tolist():
            at = lo + int(far[i])
            good = np.flatnonzero((u[at : hi + 1] - u[lo + i] >= -1) & (v[at : hi + 1] - v[lo + i] >= -1))
            if len(good) and a[at + good[-1]] - a[lo + i] + 1 > size:
                best, size = (lo + i, at + int(good[-1])), int(a[at + good[-1]] - a[lo + i] + 1)
        return best

    if len(a) < LENGTH * 4 // 5:
        return []
    out = [s for s in _segments(a, b) if fits(*s)]
    cuts = [-1, *(v for s in out for v in s), len(a)]
    open_ = [(i + 1, j - 1) for i, j in zip(cuts[::2], cuts[1::2], strict=True)]
    while open_:
        lo, hi = open_.pop()
        found = longest(lo, hi)
        if found:
            out.append(found)
            open_ += [(lo, found[0] - 1), (found[1] + 1, hi)]
    return sorted(out)


def passages_of(in_a: np.ndarray, in_b: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(a start, a end, b start, b end, equal words) of each passage among the equal words of two texts."""
    return [
        (int(in_a[i]), int(in_a[j]) + 1, int(in_b[i]), int(in_b[j]) + 1, j - i + 1) for i, j in stretches(in_a, in_b)
    ]


def align(a: np.ndarray, b: np.ndarray, chain: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int]:
    """The longest passage along a chain."""
    return max(passages_of(*matched(a, b, chain)[:2]), key=lambda p: p[1] - p[0])


_ASKED = "_of long, _copy int, side int, row long, ref long, parts binary, want binary"


def _asked(flank: int, often: dict[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each pair and side, the first and last words of the stretches of its chains with their flanks.

    The side of the row has the chains, too.  often: how many copies there are
    of the texts that have more than one; a pair asks one of them.
    """
    known = np.array(sorted(often), np.int64)
    copies = np.array([often[k] for k in known.tolist()], np.uint64)

    def stretches_of(of: np.ndarray, first: np.ndarray, last: np.ndarray, n: int) -> list[bytes]:
        order = np.lexsort((first, of))
        of, first, last = of[order], first[order], last[order]
        span = int(last.max()) + 3
        reach = np.maximum.accumulate(last + of * span)
        start = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (first[1:] + of[1:] * span > reach[:-1] + 1)]))
        both = np.stack([first[start], np.maximum.reduceat(last, start)], 1).astype("<i4").tobytes()
        cuts = (8 * np.searchsorted(of[start], np.arange(n + 1))).tolist()
        return [both[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches):
            n = batch.num_rows
            if n == 0:
                continue
            ends, of = _joined_ints(batch.column("ends").to_numpy(zero_copy_only=False))
            ends, of = ends.reshape(-1, 4), of[::4]
            for side, name in enumerate(("row", "ref")):
                first, last = np.maximum(ends[:, 2 * side] - flank, 0), ends[:, 2 * side + 1] - 1 + flank
                copy = np.zeros(n, np.int32)
                if often:
                    asked = batch.column(name).to_numpy()
                    place = np.searchsorted(known, asked).clip(max=len(known) - 1)
                    pairs = mix(batch.column("row").to_numpy().view(np.uint64) ^ mix(batch.column("ref").to_numpy().view(np.uint64)))
                    copy = np.where(known[place] == asked, pairs % copies[place], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(name),
                        pa.array(copy),
                        pa.array(np.full(n, side, np.int32)),
                        batch.column("row"),
                        batch.column("ref"),
                        pa.nulls(n, pa.binary()) if side else batch.column("parts"),
                        pa.array(stretches_of(of, first, last, n), pa.binary()),
                    ],
                    names=["_of", "_copy", "side", "row", "ref", "parts", "want"],
                )

    return run


_CUT = "row long, ref long, side int, parts binary, at binary, data binary, size long"
FETCHED = 500_000  # words that a task fetches at a time


def _cut_rows(sent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each asked row, the start and number of words of its stretches, so many bytes of their hashes, and the words of the text.

    Comes sorted by text; before the rows that ask stands the text itself, want
    of a row at side -1, once or more often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sizes = np.zeros((0, sent), np.uint8), np.zeros(1, np.int64)
        for batch in text_slices(batches, 5):
            side = batch.column("side").to_numpy()
            told, counts = hashed(batch.column("want").filter(pa.array(side < 0)))
            words = np.concatenate([words[len(words) - sizes[-1] :], told.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :sent]])
            sizes = np.concatenate([sizes[-1:], counts])  # of the text before the batch, and of those in it
            begin, which = np.cumsum(sizes) - sizes, np.cumsum(side < 0)
            asking = np.flatnonzero(side >= 0)
            if len(asking) == 0:
                continue
            which = which[asking]
            want, of = _joined_ints(batch.column("want").to_numpy(zero_copy_only=False)[asking])
            first, end, of = want[::2], want[1::2] + 1, of[::2]
            end = np.minimum(end, sizes[which[of]])
            inside = end > first
            first, n, of = first[inside], (end - first)[inside], of[inside]
            per_row = np.bincount(of, n, len(asking)).astype(np.int64)
            at = np.stack([first, n], 1).astype("<i4").tobytes()
            pieces = np.searchsorted(of, np.arange(len(asking) + 1))
            step = np.cumsum(per_row) // FETCHED
            for lo in np.flatnonzero(np.diff(step, prepend=-1)).tolist():
                hi = int(np.searchsorted(step, step[lo], "right"))
                some = slice(pieces[lo], pieces[hi])
                total = np.cumsum(n[some])
                place = np.repeat(begin[which[of[some]]] + first[some] - (total - n[some]), n[some])
                data = words[place + np.arange(len(place))].tobytes()
                ends = (np.cumsum(per_row[lo:hi], dtype=np.int64) * sent).tolist()
                rows = batch.take(pa.array(asking[lo:hi]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(rows.column(c) for c in ("row", "ref", "side", "parts")),
                        pa.array([at[8 * i : 8 * j] for i, j in zip(pieces[lo:hi].tolist(), pieces[lo + 1 : hi + 1].tolist(), strict=True)], pa.binary()),
                        pa.array([data[i:j] for i, j in zip([0, *ends], ends, strict=False)], pa.binary()),
                        pa.array(sizes[which[lo:hi]]),
                    ],
                    names=["row", "ref", "side", "parts", "at", "data", "size"],
                )

    return lean(run)


class Fetched:
    """The fetched stretches of one text: words has their hashes one after the other, at the start and size of each."""

    def __init__(self, at: bytes, words: np.ndarray, size: int):
        places = np.frombuffer(at, "<i4").tolist()
        self.starts, self.pieces, done = places[::2], [], 0
        for n in places[1::2]:
            self.pieces.append(words[done : done + n])
            done += n
        self.size = size
        self.lists: dict[int, list[int]] = {}

    def around(self, at: int) -> tuple[int, np.ndarray, bool, bool]:
        """The piece with a word: its start, its words, and whether the text goes on before and behind it."""
        i = bisect_right(self.starts, at) - 1
        start, words = self.starts[i], self.pieces[i]
        return start, words, start > 0, start + len(words) < self.size

    def listed(self, start: int, words: np.ndarray) -> list[int]:
        if start not in self.lists:
            self.lists[start] = words.tolist()
        return self.lists[start]


def _some_equal(a: list[int], b: list[int], a_more: bool, b_more: bool) -> int | None:
    """How many words `extended` can find from the start of two texts on, at most; None if it may go beyond a step."""
    same, top = 0, min(len(a), len(b))
    while same < top and a[same] == b[same]:
        same += 1
    x, y = a[same : same + STEP], b[same : same + STEP]
    if len(x) < STEP and a_more or len(y) < STEP and b_more:
        return None
    known = set(y)
    bound = sum(w in known for w in x)
    return None if 2 * bound >= STEP else same + bound


def hopeless(a: list[int], b: list[int], chain: list[tuple[int, int, int]], more: tuple[bool, bool, bool, bool]) -> bool:
    """Whether a chain and what `extended` finds at its ends have too few equal words for a passage, by a bound.

    more: whether the texts go on before the words of a, of b, and behind them.
    """
    need = LENGTH * 4 // 5
    (x, y, _), (ex, ey, size) = chain[0], chain[-1]
    n, reach = min(ex + size - x, ey + size - y), STEP + need
    if n >= need:
        return False
    lo, hi = max(0, x - reach), max(0, y - reach)
    before = _some_equal(a[lo:x][::-1], b[hi:y][::-1], more[0] or lo > 0, more[1] or hi > 0)
    if before is None or n + before >= need:
        return False
    ex, ey = ex + size, ey + size
    behind = _some_equal(
        a[ex : ex + reach], b[ey : ey + reach], more[2] or ex + reach < len(a), more[3] or ey + reach < len(b)
    )
    return behind is not None and n + before + behind < need


def _cut_short(a: tuple[int, bool], b: tuple[int, bool]) -> bool:
    """Whether an extension ended for want of fetched words: (words left, text goes on) of both sides."""
    over = any(left == 0 and not more for left, more in (a, b))
    return not over and any(left < STEP and more for left, more in (a, b))


def _fetched(
    batches: Iterator[pa.RecordBatch], sent: int
) -> Iterator[tuple[int, int, bytes, list[list[tuple[int, int, int]]], Fetched, Fetched]]:
    """row, ref, the chains as they came and as lists, and both texts of each pair; the two follow each other."""
    cols = ["row", "ref", "side", "parts", "at", "data", "size"]
    for row, ref, side, parts, at, data, size in whole_runs(batches, cols, 2):
        told = np.frombuffer(b"".join(data), np.uint8).reshape(-1, sent)
        words = np.zeros((len(told), 8), np.uint8)
        words[:, :sent] = told
        words, ends = words.view("<u8").ravel(), np.cumsum([0, *map(len, data)]) // sent
        texts = [Fetched(*x) for x in zip(at, np.split(words, ends[1:-1]), size.tolist(), strict=True)]
        both = (row[1:] == row[:-1]) & (ref[1:] == ref[:-1]) & (side[:-1] == 0) & (side[1:] == 1)
        for i in np.flatnonzero(both).tolist():
            flat, place, chains_ = np.frombuffer(parts[i], "<i4").tolist(), 0, []
            while place < len(flat):
                end = place + 1 + 3 * flat[place]
                chains_.append([(flat[j], flat[j + 1], flat[j + 2]) for j in range(place + 1, end, 3)])
                place = end
            yield int(row[i]), int(ref[i]), parts[i], chains_, texts[i], texts[i + 1]


def _ends_of(chain: list[tuple[int, int, int]]) -> list[int]:
    """Where a chain begins and ends in both texts."""
    (x0, y0, _), (x1, y1, size) = chain[0], chain[-1]
    return [x0, x1 + size, y0, y1 + size]


def _roughly_equal(a: list[int], b: list[int], a_more: bool, b_more: bool) -> int | None:
    """As `_some_equal`, where different words may have equal hashes."""
    same, top = 0, min(len(a), len(b))
    while same < top and a[same] == b[same]:
        same += 1
    x, y = a[: same + STEP], b[: same + STEP]
    if len(x) < same + STEP and a_more or len(y) < same + STEP and b_more:
        return None
    known = set(y)
    bound = sum(w in known for w in x)
    return None if 2 * bound >= STEP else bound


@lean
def _possible_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that a bound by a few bits of each word does not rule out, with their chains."""
    need = LENGTH * 4 // 5
    out: list[tuple] = []
    for row, ref, parts, found, text, other in _fetched(batches, ROUGH):
        for chain in found:
            x, ex, y, ey = _ends_of(chain)
            n = min(ex - x, ey - y)
            a0, a, a_before, a_behind = text.around(x)
            b0, b, b_before, b_behind = other.around(y)
            a, b = text.listed(a0, a), other.listed(b0, b)
            if n < need:
                before = _roughly_equal(a[: x - a0][::-1], b[: y - b0][::-1], a_before, b_before)
                behind = _roughly_equal(a[ex - a0 :], b[ey - b0 :], a_behind, b_behind) if before is not None else None
                if behind is not None and n + before + behind < need:
                    continue
            out.append((row, ref, parts, _ints([v for c in found for v in _ends_of(c)])))
            break
    cols = list(zip(*out, strict=True)) or [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["row", "ref", "parts", "ends"])


_PASSAGES = "row long, ref long, start long, end long, ref_start long, ref_end long, n_equal long, parts binary, ends binary"


@lean
def _align_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The passages of each pair of texts, or one row that starts at -1, with the chains, if the pair needs wider flanks."""
    names = ("row", "ref", "start", "end", "ref_start", "ref_end", "n_equal", "parts", "ends")
    kinds = [pa.int64()] * 7 + [pa.binary()] * 2
    out: list[tuple] = []

    def rows() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(names))

    for row, ref, parts, found, text, other in _fetched(batches, SENT):
        more, taken = (None, None), set()
        for chain in found:
            # A chain within an accepted passage has nothing to add.
            if any(t[0] <= chain[0][0] and chain[-1][0] + chain[-1][2] <= t[1] for t in taken):
                continue
            a0, a, a_before, a_behind = text.around(chain[0][0])
            b0, b, b_before, b_behind = other.around(chain[0][1])
            here = [(x - a0, y - b0, k) for x, y, k in chain]
            if hopeless(text.listed(a0, a), other.listed(b0, b), here, (a_before, b_before, a_behind, b_behind)):
                continue
            in_a, in_b, (la, lb), (ra, rb) = matched(a, b, here)
            if _cut_short((la, a_before), (lb, b_before)) or _cut_short((ra, a_behind), (rb, b_behind)):
                taken = {(-1, -1, -1, -1, -1)}
                more = (parts, _ints([v for c in found for v in _ends_of(c)]))
                break
            taken |= {(s + a0, e + a0, rs + b0, re_ + b0, n_) for s, e, rs, re_, n_ in passages_of(in_a, in_b)}
        out += [(row, ref, *t, *more) for t in sorted(taken)]
        if len(out) > 20_000:
            yield rows()
            out = []
    yield rows()


def repeated_passages(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Passages that stand in an earlier document, too: one row per passage of a chain.

    key, start and end (words, end excluded), ref_<key>, ref_start, ref_end and
    n_equal.  "Earlier" is an arbitrary fixed order; of all documents with a
    passage exactly one is never the later one.  A passage has at least LENGTH
    words on its own side and equal words for SIMILARITY of the longer side.
    Rows equal in key and text are one document, and a null key is a value.
    Of words that a found passage has, no second one has to be named: pairs that
    share few seeds are looked at only for what the first ones leave.
    Null and empty texts have no passages.  Only key and text are read, so other
    columns cannot clash; an empty table gives an empty table.
    """
    text_batches(docs)
    rows = docs.where(F.col(text).isNotNull()).select(_row(key, text).alias("row"), F.col(text).alias("text"))
    marks = docs.sparkSession.sparkContext.broadcast(repeated_seeds(rows))
    links = (
        rows.mapInArrow(_seed_rows(marks), _SEEDS)
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_link_blobs, "bucket int, links binary")
    )
    chained = keep(
        links.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_chain_rows, _CHAINS),
        "chains",
    )
    marks.destroy()

    def met(pairs: DataFrame, flank: int, sent: int) -> DataFrame:
        """Both sides of each pair, with the words around its chains.

        A text meets all that is asked of it in one task, but for one asked so
        often that copies of it go to several.
        """
        asking = pairs.groupBy("ref").count().where(F.col("count") > ASKED).collect()
        often = {r["ref"]: -(-r["count"] // ASKED) for r in asking}
        wanted = pairs.select("row").union(pairs.select("ref"))
        touched, _ = sieve(rows, F.col("row"), wanted, "wanted")
        copies = F.lit(1)
        if often:
            copies = F.coalesce(F.create_map(*(F.lit(v) for kv in often.items() for v in kv))[F.col("row")], copies)
        nothing = F.lit(0).cast("long")
        texts = touched.select(
            F.col("row").alias("_of"), F.explode(F.sequence(F.lit(0), copies - 1)).alias("_copy"),
            F.lit(-1).alias("side"), nothing.alias("row"), nothing.alias("ref"),
            F.lit(None).cast("binary").alias("parts"), F.col("text").cast("binary").alias("want"),
        )
        return (
            texts.unionByName(pairs.mapInArrow(_asked(flank, often), _ASKED))
            .repartition("_of", "_copy")
            .sortWithinPartitions("_of", "_copy", "side")
            .select("_of", "side", "row", "ref", "parts", "want")
            .mapInArrow(_cut_rows(sent), _CUT)
            .repartition("row", "ref")
            .sortWithinPartitions("row", "ref", "side")
        )

    def all_aligned(pairs: DataFrame) -> DataFrame:
        """Each round has pairs whose alignments met the edges of the one before; flanks as long as the texts end it."""
        flank, found = FLANK, None
        while found is None or not pairs.isEmpty():
            now = keep(met(pairs, flank, SENT).mapInArrow(_align_rows, _PASSAGES), "passages")
            pairs = now.where("start < 0").select("row", "ref", "parts", "ends")
            now = now.where("start >= 0").drop("parts", "ends")
            found, flank = now if found is None else found.unionByName(now), flank * WIDER
        return found

    passages = all_aligned(chained.where("strong").select("row", "ref", "parts", "ends"))
    weak = chained.where("not strong")
    covers = passages.join(weak.select("row").distinct(), "row", "left_semi")
    bare = F.lit(-1).cast("long")
    late = keep(
        weak.select("row", bare.alias("start"), bare.alias("end"), "ref", "at", "parts")
        .union(covers.select("row", "start", "end", "ref", F.lit(b""), F.lit(b"")))
        .repartition("row")
        .sortWithinPartitions("row")
        .mapInArrow(_late_chains, _PAIRS),
        "late",
    )
    late = keep(met(late, NEAR, ROUGH).mapInArrow(_possible_rows, _PAIRS), "possible")
    passages = passages.unionByName(all_aligned(late))
    named = docs.where(F.col(text).isNotNull()).select(F.col(key), _row(key, text).alias("row"))
    ends = passages.select(F.col("row").alias("_r")).union(passages.select("ref")).distinct()
    names = keep(named.join(ends, F.col("row") == F.col("_r"), "left_semi").dropDuplicates(["row"]), "names")
    refs = names.select(F.col(key).alias(f"ref_{key}"), F.col("row").alias("ref"))
    return (
        passages.join(names, "row")
        .join(refs, "ref")
        .select(key, "start", "end", f"ref_{key}", "ref_start", "ref_end", "n_equal")
    )


def without(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans; what stays keeps its white space."""
    at = [m.span() for m in re.finditer(WORD, text)]
    gone: list[list[int]] = []
    for span in sorted((s["start"], s["end"]) for s in spans):
        if gone and span[0] <= gone[-1][1]:
            gone[-1][1] = max(gone[-1][1], span[1])
        else:
            gone.append(list(span))
    out, last = [], 0
    for start, end in gone:
        out.append(text[last : at[start][0]])
        last = at[end][0] if end < len(at) else len(text)
    return "".join([*out, text[last:]]).strip(" \t\n\x0b\x0c\r")


def cut_words(text: str, spans: str) -> Column:
    """A column: the text without the words of array<struct<start, end>>; null spans cut nothing."""

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), found.to_pylist(), strict=True)
        return pa.array([without(t, s) if t and s else t for t, s in pairs], pa.string())

    return F.arrow_udf(cut, "string")(F.col(text), F.col(spans))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_repeated_passages": op6_repeated_passages}
ORACLES: dict[str, str] = {}
