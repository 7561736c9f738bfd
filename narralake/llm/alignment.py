"""Operator 11, cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both token lists of a text cover the same bytes, so each is a rising list of
byte offsets where tokens end.  Stretches where both have token for token the
same ends are diagonals of constant index shift; they are jumped over by
comparing slices of doubling length.  Where the ends part, the smaller end
moves on until both meet, and the shift is what it then is.

How often two ids end together in the whole corpus is counted by Spark.  The
most frequent pairs, a bounded number found from a histogram of the counts,
are broadcast; all others are joined by pair, so no frequent pair is ever a
hot key of the join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from narralake.llm.common import keep, table, text_batches
from narralake.llm.tokens import OTHER, PRETOKEN, IdCache

BYTE_LEVEL = "byte_bpe_50k"
PIECES = "piece_bpe_32k"
#: Pairs of ids that are broadcast at most, each of 17 bytes.
FREQUENT = 1 << 18
#: Links that a task counts at a time.
LINKS = 2_000_000

#: Behind the last end of a list; greater than any.
LAST = 1 << 62

BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """Character to byte of the byte-level alphabet: printable bytes stand for themselves,
    the others follow in order from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    found = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
    assert set(found) == set(ByteLevel.alphabet())
    return found


class Entries:
    """Bytes and byte lengths of all ids, and their decimal names followed by each separator."""

    def __init__(self, entries: list[bytes]):
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        names = [str(i) for i in range(len(entries))]
        self.named = {s: np.array([n + s for n in names], object) for s in ",|;"}

    def ends(self, ids: np.ndarray, want: np.ndarray) -> np.ndarray | None:
        """Where each token ends, or None if their bytes are not the wanted ones."""
        length = self.length[ids]
        ends = np.cumsum(length)
        if len(ids) == 0 or ends[-1] != len(want):
            return None
        found = self.bytes[np.arange(len(want)) + np.repeat(self.start[ids] - (ends - length), length)]
        return ends if np.array_equal(found, want) else None


class ByteLevelTokens:
    """Ids by the byte-level vocabulary; its special strings are ordinary text."""

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
        self.library.encode_special_tokens = True
        alphabet = byte_alphabet()
        special = self.library.get_added_tokens_decoder()
        entries = [b""] * self.library.get_vocab_size()
        for entry, i in self.library.get_vocab().items():
            entries[i] = entry.encode() if i in special else bytes(alphabet[c] for c in entry)
        self.entries = Entries(entries)
        self.ids_of = IdCache(vocabulary)

    def ids(self, text: str) -> np.ndarray:
        if OTHER.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.frombuffer(b"".join(map(self.ids_of.__getitem__, PRETOKEN.findall(text))), "<u4")


class PieceTokens:
    """Ids by a piece model, which puts one space before a text."""

    def __init__(self, vocabulary: str):
        self.model = sentencepiece.SentencePieceProcessor(
            model_file=public_tokenizers.path(f"{vocabulary}.model")
        )
        self.entries = Entries([self._bytes(i) for i in range(self.model.get_piece_size())])

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        found = BYTE_PIECE.fullmatch(piece)
        return bytes([int(found[1], 16)]) if found else piece.replace("▁", " ").encode()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.uint32)


@lru_cache(2)
def tokenizers(first: str, second: str) -> tuple[ByteLevelTokens, PieceTokens]:
    """One of each per worker process, so that the caches live as long as the worker."""
    return ByteLevelTokens(first), PieceTokens(second)


def common_runs(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Runs (i, j, n) of equal values a[i:i+n] == b[j:j+n] of two strictly rising lists.

    The runs hold every value that both lists have.
    """
    runs = []
    n_a, n_b = len(a), len(b)
    a, b = [*a, LAST], [*b, LAST]
    i = j = 0
    while i < n_a and j < n_b:
        # An irregular group: the smaller end moves on until both are equal.
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        if x == LAST:
            break
        # Slices of doubling length at this shift, as long as they are equal, then of halving length.
        at, shift, width = i + 1, j - i, 1
        while at < n_a and a[at : at + width] == b[at + shift : at + shift + width]:
            at += width
            width *= 2
        while width > 1:
            width //= 2
            if a[at : at + width] == b[at + shift : at + shift + width]:
                at += width
        # The last slices may have been cut short, or hold the mark behind the last end.
        n = min(at, n_a, n_b - shift) - i
        runs.append((i, j, n))
        i, j = i + n, j + n
    return runs


def common_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in a and in b of the values that both rising arrays have."""
    runs = np.array(common_runs(a.tolist(), b.tolist()), np.int64).reshape(-1, 3)
    n = runs[:, 2]
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(runs[:, 0], n) + inside, np.repeat(runs[:, 1], n) + inside


def groups_text(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, first: Entries, second: Entries) -> str:
    """`a1,a2|b1;a3|b2,b3`: the ids of each group of tokens between common ends."""
    n_a, n_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
    out = np.empty(len(a) + len(b), object)
    # Before a token stand its own list up to it and the other list up to its group.
    place_a = np.arange(len(a)) + np.repeat(at_b + 1 - n_b, n_a)
    place_b = np.arange(len(b)) + np.repeat(at_a + 1, n_b)
    out[place_a], out[place_b] = first.named[","][a], second.named[","][b]
    out[place_a[at_a]], out[place_b[at_b]] = first.named["|"][a[at_a]], second.named[";"][b[at_b]]
    return "".join(out.tolist())[:-1]


def align(text: str | None, first: ByteLevelTokens, second: PieceTokens):
    """Ids of both tokenizers and the places of their common ends, or None without tokens."""
    if not text:
        return None
    whole = " " + text
    a, b = first.ids(whole), second.ids(text)
    want = np.frombuffer(whole.encode(), np.uint8)
    ends_a, ends_b = first.entries.ends(a, want), second.entries.ends(b, want)
    if ends_a is None or ends_b is None:
        return None
    return a, b, *common_places(ends_a, ends_b)


ALIGNED = "struct<n_a: long, n_b: long, n_groups: long, groups: string, pairs: binary, times: binary>"


def aligned(text: Column, first: str = BYTE_LEVEL, second: str = PIECES) -> Column:
    """n_a, n_b, n_groups, groups (ids by group), and the linked pairs of ids of each text.

    `pairs` holds each pair once, the first id above 32 bits of the second, as
    little-endian 64-bit values in rising order, `times` how often, in 32 bits.
    Texts that are null, empty, or that one of the tokenizers does not give
    back byte for byte have no tokens: zeros and empty values.
    """

    def run(texts: pa.Array) -> pa.Array:
        one, two = tokenizers(first, second)
        rows = []
        for text in texts.to_pylist():
            found = align(text, one, two)
            if found is None:
                rows.append((0, 0, 0, "", b"", b""))
                continue
            a, b, at_a, at_b = found
            pairs, times = np.unique(
                a[at_a].astype(np.uint64) << np.uint64(32) | b[at_b], return_counts=True
            )
            groups = groups_text(a, b, at_a, at_b, one.entries, two.entries)
            rows.append((len(a), len(b), len(at_a), groups, pairs.astype("<u8").tobytes(), times.astype("<u4").tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        names = ("n_a", "n_b", "n_groups", "groups", "pairs", "times")
        return pa.StructArray.from_arrays(
            [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names
        )

    return F.arrow_udf(run, ALIGNED)(text)


def _count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def total() -> pa.RecordBatch:
        pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        times = np.bincount(place, np.concatenate([t for _, t in held]), len(pairs)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"pair": pairs.astype(np.int64), "n": times})

    for batch in batches:
        for pairs, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.append((np.frombuffer(pairs, "<u8"), np.frombuffer(times, "<u4")))
            n += len(held[-1][0])
            if n >= LINKS:
                yield total()
                held, n = [], 0
    if held:
        yield total()


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (links in the whole corpus) and best (no other pair of its second id has more).

    links has the columns pairs and times; tasks add up before the shuffle.
    """
    counted = links.select("pairs", "times").mapInArrow(_count_pairs, "pair long, n long")
    pairs = counted.groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = keep(pairs.withColumn("second", F.col("pair").bitwiseAND(0xFFFFFFFF)), "pairs")
    most = pairs.groupBy("second").agg(F.max("n").alias("most"))
    return pairs.join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_pairs(pairs: DataFrame, size: int) -> tuple[pa.Table, int]:
    """The pairs from some count on, at most `size`, by rising pair; and that count.

    A histogram in steps of a fourth of a power of two says from which count
    on there are few enough; only those are collected.
    """
    step = F.floor(F.log2("n") * 4)
    steps = pairs.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("n").alias("least")).collect()
    least, total = 1 << 62, 0
    for row in sorted(steps, reverse=True):
        total += row.n
        if total > size:
            break
        least = row.least
    return pairs.where(F.col("n") >= least).toArrow().sort_by("pair"), least


def _score(known):
    """Sums over the frequent pairs of a text, and its other pairs."""

    def run(pairs: pa.Array, times: pa.Array) -> pa.Array:
        code, n, best = known.value
        sums, others, other_times, sizes = [], [], [], []
        for p, t in zip(pairs.to_pylist(), times.to_pylist()):
            pair, time = np.frombuffer(p, "<u8").astype(np.int64), np.frombuffer(t, "<u4").astype(np.int64)
            at = np.minimum(np.searchsorted(code, pair), max(len(code) - 1, 0))
            hit = code[at] == pair if len(code) else np.zeros(len(pair), bool)
            at = at[hit]
            sums.append((int((time[hit] * best[at]).sum()), int((time[hit] * n[at]).sum())))
            others.append(pair[~hit])
            other_times.append(time[~hit])
            sizes.append(len(others[-1]))
        rest = pa.StructArray.from_arrays(
            [pa.array(np.concatenate([*x, np.empty(0, np.int64)]), pa.int64()) for x in (others, other_times)],
            ["pair", "times"],
        )
        ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array([s[k] for s in sums], pa.int64()) for k in (0, 1)] + [pa.ListArray.from_arrays(ends, rest)],
            ["n_best", "count_sum", "rest"],
        )

    return F.arrow_udf(run, "struct<n_best: long, count_sum: long, rest: array<struct<pair: long, times: long>>>")


def link_scores(links: DataFrame, row: str, frequent: int = FREQUENT) -> DataFrame:
    """row, n_best and count_sum of each row of links (row, pairs, times); row names a row.

    count_sum adds the corpus-wide counts of the row's links, n_best counts
    those links whose pair is the most frequent of its second id, ties
    included.  Rows without links have zeros; an empty table gives none.
    """
    pairs = keep(pair_counts(links), "pair-counts")
    top, least = frequent_pairs(pairs, frequent)
    known = links.sparkSession.sparkContext.broadcast(
        (
            top["pair"].to_numpy().astype(np.int64),
            top["n"].to_numpy().astype(np.int64),
            top["best"].to_numpy().astype(np.int64),
        )
    )
    scored = keep(links.select(row, _score(known)("pairs", "times").alias("s")), "scored")
    rest = scored.select(row, F.explode("s.rest").alias("r")).select(row, "r.pair", "r.times")
    joined = rest.join(pairs.where(F.col("n") < least), "pair")
    more = joined.groupBy(row).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("times") * F.col("n")).alias("more_sum"),
    )
    total = lambda name, more: (F.col(f"s.{name}") + F.coalesce(more, F.lit(0))).cast("long").alias(name)
    return scored.join(more, row, "left").select(row, total("n_best", "more_best"), total("count_sum", "more_sum"))


def align_documents(
    docs: DataFrame,
    text: str = "text",
    digest: bool = False,
    first: str = BYTE_LEVEL,
    second: str = PIECES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """docs without its text, with one column `alignment`: a struct of n_a, n_b, n_groups,
    n_links, n_best, count_sum and groups.

    groups is the text of ids by group, `a1,a2|b1;a3|b2,b3`; with `digest` its
    SHA-256 in hexadecimal digits, '' without tokens.  Rows are told apart by
    a number of their own, so null or repeated ids and equal rows each keep a
    row, and equal texts have equal values.  A column of docs named alignment
    is replaced, all others stay, whatever their names.  Texts that are null,
    empty or not given back byte for byte have zeros and ''.  An empty table
    gives an empty table.
    """
    text_batches(docs)
    others = [c for c in docs.columns if c not in (text, "alignment")]
    found = F.col("found")
    groups = found["groups"]
    if digest:
        groups = F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    # One evaluation of the tokenizers; the struct of the other columns hides their names.
    coded = keep(
        docs.select(F.struct(F.lit(0), *others).alias("docs"), aligned(F.col(text), first, second).alias("found"))
        .select(
            F.monotonically_increasing_id().alias("row"),
            "docs",
            F.struct("found.n_a", "found.n_b", "found.n_groups", groups.alias("groups")).alias("sizes"),
            "found.pairs",
            "found.times",
        ),
        "aligned",
    )
    scores = link_scores(coded.select("row", "pairs", "times"), "row", frequent)
    s = F.col("sizes")
    alignment = F.struct(
        s["n_a"].alias("n_a"), s["n_b"].alias("n_b"), s["n_groups"].alias("n_groups"),
        s["n_groups"].alias("n_links"), F.col("n_best"), F.col("count_sum"), s["groups"].alias("groups"),
    )
    return coded.select("row", "docs", "sizes").join(scores, "row").select(
        *(F.col("docs")[c].alias(c) for c in others), alignment.alias("alignment")
    )


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = align_documents(docs, digest=True)
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    return out.select(
        "doc_id",
        *(F.col(f"alignment.{c}").alias(c) for c in counts),
        F.col("alignment.groups").alias("groups_sha256"),
    )


QUERIES = {"op11_align_tokenizers": op11_align_tokenizers}
#: No SQL has the two tokenizers; tests compare with a plain alignment.
ORACLES: dict[str, str] = {}
