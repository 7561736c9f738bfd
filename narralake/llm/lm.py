"""Operator 9, scoring texts with a hidden Markov language model.

Tokens are lower-cased words and one end.  The counts of all words are taken
over all training documents.  Frequent words are symbols of their own; all
other words fall into classes by their last letters, and inside a class a word
has its smoothed share.  A Markov chain of latent states emits the symbols; it
is trained by Baum-Welch, whose expected counts are summed over the partitions
of all training documents in every round, and the scaled forward recursion
gives the exact likelihood of a whole text.

The counts of frequent words are broadcast, in a table of bounded size; the
rare words of the texts meet theirs in a join, so no word count is limited by
the memory of one machine and no hot word is ever a join key.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm.common import fold_of, heaviest, keep, rows_of, table

#: Words with a symbol of their own, and classes of the others.
FREQUENT = 60_000
CLASSES = 512
STATES = 8
ROUNDS = 4
WINDOW = 256  # tokens of a training sequence
BATCH = 512
_END, _FIRST_CLASS = 0, 1
_FIRST_WORD = _FIRST_CLASS + CLASSES
LOG10 = float(np.log(10.0))


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words; the methods of bytes know A-Z and the six white-space characters."""
    return text.encode().lower().split() if text else []


def class_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % CLASSES


# ------------------------------------------------------------------- counting
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"word": pa.array(counts.keys(), pa.binary()), "n": pa.array(counts.values(), pa.int64())}
        )

    for batch in rows_of(batches, 500):
        for text in batch.column(0).to_pylist():
            counts.update(tokens(text))
        if len(counts) > 400_000:
            yield rows()
            counts.clear()
    yield rows()


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts; words are added up in each task first."""
    return docs.select(text).mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Symbols of frequent words, sizes of the classes, and the base model's constants."""

    def __init__(self, frequent: list[tuple[bytes, int]], classes: dict[int, tuple[int, int]], documents: int):
        self.symbols = {w: _FIRST_WORD + i for i, (w, _) in enumerate(frequent)}
        self.counts = np.zeros(_FIRST_WORD + len(frequent), np.int64)
        self.counts[_FIRST_WORD:] = [n for _, n in frequent]
        self.counts[_END] = documents
        self.class_total = np.zeros(CLASSES)
        self.class_words = np.zeros(CLASSES)
        for c, (words, n) in classes.items():
            self.counts[_FIRST_CLASS + c] = n
            self.class_total[c], self.class_words[c] = n, words
        self.total = int(self.counts.sum())
        self.distinct = len(frequent) + int(self.class_words.sum()) + (documents > 0)
        self.base = np.log10((self.counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def base_of(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def share_in_class(self, n: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 share of a rare word in its class, with one place for all unseen words."""
        return np.log10((n + 0.5) / (self.class_total[c] + 0.5 * (self.class_words[c] + 1)))


def class_column(word: str) -> Column:
    return (F.crc32(F.substring(F.col(word), -3, 3)) % CLASSES).cast("int")


def vocabulary(counts: DataFrame, documents: int, size: int = FREQUENT) -> Vocabulary:
    """Symbols for the `size` most frequent words, fewer where the last ones tie; classes for the others."""
    frequent = heaviest(counts, "word", "n", size)
    top = sorted(((bytes(r[0]), r[1]) for r in counts.where(frequent).collect()), key=lambda t: (-t[1], t[0]))
    rest = counts.where(~frequent)
    classes = rest.groupBy(class_column("word").alias("c")).agg(F.count("*"), F.sum("n")).collect()
    return Vocabulary(top, {r[0]: (r[1], r[2]) for r in classes}, documents)


# ------------------------------------------------------------------- the model
class Hmm:
    """start, move (states x states) and emit (symbols x states)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, counts: np.ndarray, states: int, seed: int = 5) -> Hmm:
        """Smoothed unigram shares, disturbed at random so that states can part."""
        rng = np.random.default_rng(seed)
        emit = (counts[:, None] + 0.5) * np.exp(1.0 * rng.standard_normal((len(counts), states)))
        move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def estimated(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, counts: np.ndarray) -> Hmm:
        """From expected counts; every state keeps a little of every move and, by its share, every symbol."""
        prior = (counts + 0.5) / (counts + 0.5).sum()
        start = start + 0.1
        move = move + 1.0
        emit = emit + 50.0 * prior[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each whole sequence, by the scaled recursion."""
        out = np.zeros(len(sequences))
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        for at in range(0, len(order), BATCH):
            mine = order[at : at + BATCH]
            lengths = np.array([len(sequences[i]) for i in mine])
            log = np.zeros(len(mine))
            alpha = np.tile(self.start, (len(mine), 1))
            for block in range(0, int(lengths.max(initial=0)), 1024):
                here = int((lengths > block).sum())
                width = min(1024, int(lengths[0]) - block)
                ids = np.zeros((width, here), np.int64)
                for j in range(here):
                    part = sequences[mine[j]][block : block + width]
                    ids[: len(part), j] = part
                for t in range(width):
                    n = int((lengths > block + t).sum())
                    a = alpha[:n] * self.emit[ids[t, :n]]
                    scale = a.sum(1)
                    log[:n] += np.log(scale)
                    a /= scale[:, None]
                    alpha[:n] = a @ self.move
            out[mine] = log / LOG10
        return out

    def expected(self, windows: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Baum-Welch counts of windows (time x sequence, longest first): start, move, emit and the likelihood."""
        steps, n = windows.shape
        states = len(self.start)
        emit = self.emit.astype(np.float32)
        move = self.move.astype(np.float32)
        alpha = np.zeros((steps, n, states), np.float32)
        scale = np.ones((steps, n), np.float32)
        begin = np.where(first[:, None], self.start, self.stationary()).astype(np.float32)
        active = [(lengths > t).sum() for t in range(steps)]
        for t in range(steps):
            k = active[t]
            a = (begin[:k] if t == 0 else alpha[t - 1, :k] @ move) * emit[windows[t, :k]]
            s = a.sum(1)
            alpha[t, :k] = a / s[:, None]
            scale[t, :k] = s
        gamma = alpha  # becomes the posterior in place, from the back
        moves = np.zeros((states, states))
        beta = np.ones((n, states), np.float32)
        for t in range(steps - 1, -1, -1):
            k = active[t]
            if t + 1 < steps and active[t + 1]:
                j = active[t + 1]
                ahead = emit[windows[t + 1, :j]] * beta[:j] / scale[t + 1, :j, None]
                moves += alpha[t, :j].T.astype(np.float64) @ ahead
                beta[:j] = ahead @ move.T
            gamma[t, :k] *= beta[:k]
        moves *= self.move
        mask = np.arange(steps)[:, None] < lengths[None]
        flat = windows[mask]
        weight = gamma[mask]
        emits = np.stack([np.bincount(flat, weight[:, s], len(self.emit)) for s in range(states)], 1)
        return gamma[0][first].sum(0).astype(np.float64), moves, emits, float(np.log(scale[mask]).sum() / LOG10)

    def stationary(self) -> np.ndarray:
        p = np.full(len(self.start), 1 / len(self.start))
        for _ in range(50):
            p = p @ self.move
        return p


def _windows(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    parts = [
        (s[a : a + WINDOW], a == 0) for s in sequences for a in range(0, len(s), WINDOW)
    ]
    parts.sort(key=lambda p: -len(p[0]))
    for at in range(0, len(parts), BATCH):
        mine = parts[at : at + BATCH]
        lengths = np.array([len(p) for p, _ in mine])
        ids = np.zeros((lengths[0], len(mine)), np.int64)
        for j, (p, _) in enumerate(mine):
            ids[: len(p), j] = p
        yield ids, lengths, np.array([f for _, f in mine])


def baum_welch(coded: DataFrame, words: Vocabulary, states: int = STATES, rounds: int = ROUNDS) -> Hmm:
    """Rounds of expected counts over all coded training rows.

    A task returns its counts only for symbols that it has seen; they are added
    up by symbol, and the sum, symbols x (states + 1) numbers, makes the next model.
    """
    spark = coded.sparkSession
    model = Hmm.initial(words.counts, states)
    n_symbols = len(words.counts)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            start, move = np.zeros(states), np.zeros((states, states))
            emit = np.zeros((n_symbols, states))
            for batch in rows_of(batches, 1000):
                coded_rows = [np.frombuffer(b, "<u2") if n_symbols <= 65536 else np.frombuffer(b, "<u4") for b in batch.column(0).to_pylist()]
                for ids, lengths, first in _windows(coded_rows):
                    s, m, e, _ = model.expected(ids, lengths, first)
                    start += s
                    move += m
                    emit += e
            seen = np.flatnonzero(emit.sum(1))
            row = np.concatenate([seen, -1 - np.arange(states), [-1 - states]])
            values = np.concatenate([emit[seen], move, start[None]])
            yield pa.RecordBatch.from_pydict(
                {"row": pa.array(row, pa.int64()), **{f"s{i}": values[:, i] for i in range(states)}}
            )

        schema = "row long, " + ", ".join(f"s{i} double" for i in range(states))
        sums = coded.mapInArrow(expect, schema).groupBy("row").agg(
            *[F.sum(f"s{i}").alias(f"s{i}") for i in range(states)]
        )
        start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((n_symbols, states))
        got = sums.toArrow()
        row = got["row"].to_numpy()
        values = np.stack([got[f"s{i}"].to_numpy() for i in range(states)], 1)
        emit[row[row >= 0]] = values[row >= 0]
        start = values[row == -1 - states].sum(0)
        for i in range(states):
            move[i] = values[row == -1 - i].sum(0)
        shared.unpersist()
        model = Hmm.estimated(start, move, emit, words.counts)
    return model


# --------------------------------------------------------------------- scoring
_CODED = "_row long, ids binary, n_tokens long, rare array<struct<w:binary,n:int>>"


def _coder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        kind = "<u2" if len(words.counts) <= 65536 else "<u4"
        for batch in rows_of(batches, 1000):
            ids, n_tokens, rare = [], [], []
            for text in batch.column(1).to_pylist():
                found = tokens(text)
                symbols = list(map(words.symbols.get, found))
                others: Counter = Counter()
                if None in symbols:
                    for i, s in enumerate(symbols):
                        if s is None:
                            w = found[i]
                            symbols[i] = _FIRST_CLASS + class_of(w)
                            others[w] += 1
                symbols.append(_END)
                ids.append(np.array(symbols, kind).tobytes())
                n_tokens.append(len(symbols))
                rare.append([{"w": w, "n": n} for w, n in others.items()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ids, pa.binary()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array(rare, pa.list_(pa.struct([("w", pa.binary()), ("n", pa.int32())]))),
                ],
                names=["_row", "ids", "n_tokens", "rare"],
            )

    return run


def score_texts(
    docs: DataFrame,
    training: Column,
    text: str = "text",
    key: str = "doc_id",
    states: int = STATES,
    rounds: int = ROUNDS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row.

    `training` says which rows the model learns from.  A null or empty text is
    the end token alone.  Rows with null or repeated keys are scored one by
    one; only the key is carried, so clashing names cannot occur.  Words of
    equal counts are ordered by a hash.  Without training rows all words are unseen;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    learned = docs.where(training)
    counts = keep(word_counts(learned, text), "words")
    words = vocabulary(counts, learned.count(), frequent)
    shared = spark.sparkContext.broadcast(words)
    numbered = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(text).alias("_text"), training.alias("_train"))
    # The row numbers are fixed by being written next to the coded texts.
    schema = f"_row struct<r:long,k:{docs.schema[key].dataType.simpleString()},t:boolean>, {_CODED.split(', ', 1)[1]}"
    coded = keep(
        numbered.select(F.struct(F.col("_row").alias("r"), F.col("_key").alias("k"), F.col("_train").alias("t")).alias("_row"), "_text")
        .mapInArrow(_coder(shared), schema),
        "coded",
    )
    model = baum_welch(coded.where("_row.t").select("ids"), words, states, rounds)
    fitted = spark.sparkContext.broadcast(model)

    # Rare words meet their counts; each document gets three sums back.
    uses = coded.select(F.col("_row.r").alias("_r"), F.explode("rare").alias("_u")).select(
        "_r", F.col("_u.w").alias("_w"), F.col("_u.n").alias("_n")
    )
    known = counts.select(F.col("word").alias("_w"), F.col("n").alias("_c"))
    c = F.coalesce(F.col("_c"), F.lit(0))
    denominator = words.total + 0.5 * (words.distinct + 1)
    sizes = F.array(*[F.lit(float(t + 0.5 * (w + 1))) for t, w in zip(words.class_total, words.class_words, strict=True)])
    per_doc = (
        uses.join(known, "_w", "left")
        .groupBy("_r")
        .agg(
            F.sum(F.when(F.col("_c") > 0, F.col("_n")).otherwise(0)).alias("_known"),
            F.sum(F.col("_n") * F.log10((c + 0.5) / denominator)).alias("_base"),
            F.sum(F.col("_n") * F.log10((c + 0.5) / F.get(sizes, class_column("_w")))).alias("_share"),
        )
    )

    def forward(ids: pa.Array) -> pa.Array:
        words, model = shared.value, fitted.value
        kind = "<u2" if len(words.counts) <= 65536 else "<u4"
        rows = [np.frombuffer(b, kind) for b in ids.to_pylist()]
        known, base = [], []
        own = words.counts > 0
        own[_FIRST_CLASS:_FIRST_WORD] = False
        rare = np.zeros(len(words.counts), bool)
        rare[_FIRST_CLASS:_FIRST_WORD] = True
        for r in rows:
            known.append(int(own[r].sum()))
            base.append(float(words.base[r[~rare[r]]].sum()))
        return pa.StructArray.from_arrays(
            [pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(model.forward(rows))],
            names=["known", "base", "likelihood"],
        )

    run = F.arrow_udf(forward, "known long, base double, likelihood double")
    scored = coded.select("_row", "n_tokens", run("ids").alias("_f"))
    return (
        scored.join(per_doc, scored["_row.r"] == per_doc["_r"], "left")
        .select(
            F.col("_row.k").alias(key),
            F.col("_row.t").alias("_train"),
            "n_tokens",
            (F.col("_f.known") + F.coalesce("_known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(words.total).cast("long").alias("train_tokens"),
            (F.col("_f.base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
            (F.col("_f.likelihood") + F.coalesce("_share", F.lit(0.0))).alias("score"),
        )
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_texts(docs, fold_of(F.col("doc_id")) != 1)
    return out.withColumn("held_out", ~F.col("_train")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


QUERIES = {"op9_lm_score": op9_lm_score}
ORACLES: dict[str, str] = {}
