"""Operator 2, language identification with a bit-sliced Bloom filter.

Slot i of the filter is a bitmask: bit l says that some n-gram of language l
hashes to i.  The AND of an n-gram's slots names all languages that contain it,
in one look-up for all of them.  A text's popcount per language, less what the
fill of that language's slice yields by chance, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm.common import fold_of, mix, rows_of, table, text_batches

#: An n-gram belongs to a language if it makes up this share of the language's
#: n-grams, so a language has at most 1 / SHARE of them.
SHARE = 1e-5
HASHES = 3
SLOTS_PER_GRAM = 16
CHUNK = 1 << 20
#: Counts that a task holds for a language before it adds them up; more than half as many distinct ones go out.
HELD = 500_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: is it a letter?"""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str) -> Iterator[np.ndarray]:
    """Runs of three, packed into 63 bits, over the lower-case letters with one space between words."""
    lower = text.lower()
    rest = np.array([32], np.uint64)
    for at in range(0, len(lower), CHUNK):
        piece = lower[at : at + CHUNK] + (" " if at + CHUNK >= len(lower) else "")
        points = np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)
        is_letter = _letters()[points]
        points = np.where(is_letter, points, 32).astype(np.uint64)
        stay = is_letter.copy()
        stay[1:] |= is_letter[:-1]
        stay[0] |= rest[-1] != 32
        # The last two of a piece begin the runs that end in the next one.
        points = np.concatenate([rest, points[stay]])
        if len(points) > 2:
            yield points[:-2] << np.uint64(42) | points[1:-1] << np.uint64(21) | points[2:]
        rest = points[-2:]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(inverse, np.concatenate(counts), len(found)).astype(np.int64)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: dict[str, list] = {}
    counts: dict[str, list] = {}
    for batch in rows_of(batches, 200):
        new: dict[str, list] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            new.setdefault(lang, []).extend(trigrams(text))
        for lang, grams in new.items():
            if grams:
                k, n = np.unique(np.concatenate(grams), return_counts=True)
                keys.setdefault(lang, []).append(k)
                counts.setdefault(lang, []).append(n)
                if sum(map(len, keys[lang])) > HELD:
                    k, n = _summed(keys[lang], counts[lang])
                    keys[lang], counts[lang] = [k], [n]
                    if 2 * len(k) > HELD:
                        yield _gram_rows(lang, k, n)
                        keys[lang], counts[lang] = [], []
    for lang in keys:
        if keys[lang]:
            yield _gram_rows(lang, *_summed(keys[lang], counts[lang]))


def _gram_rows(lang: str, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "lang": pa.array([lang] * len(keys), pa.string()),
            "gram": pa.array(keys.astype(np.int64)),
            "n": pa.array(counts.astype(np.int64)),
        }
    )


def slots_of(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The slots of each n-gram: double hashing over a power of two."""
    h = mix(grams.astype(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        yield ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


class LanguageFilter:
    """The filter, one bit slice per language, and each slice's chance of a false hit."""

    def __init__(self, grams: dict[str, np.ndarray]):
        self.languages = sorted(grams)
        most = max([1, *(len(g) for g in grams.values())])
        self.size = 1 << int(np.ceil(np.log2(SLOTS_PER_GRAM * most)))
        self.table = np.zeros((self.size, max(1, -(-len(grams) // 8))), np.uint8)
        for i, lang in enumerate(self.languages):
            for at in slots_of(grams[lang], self.size):
                self.table[at, i // 8] |= np.uint8(1 << i % 8)
        self.false = np.array(
            [((self.table[:, i // 8] >> (i % 8)) & 1).mean() ** HASHES for i in range(len(grams))]
        )

    def masks(self, grams: np.ndarray) -> np.ndarray:
        first, *rest = slots_of(grams, self.size)
        out = self.table[first]
        for at in rest:
            out &= self.table[at]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages:
            return UNKNOWN, 0.0
        hits, n = np.zeros(8 * self.table.shape[1], np.int64), 0
        letter = False
        for grams in trigrams(text):
            n += len(grams)
            masks = self.masks(grams)
            for b in range(masks.shape[1]):
                tally = np.bincount(masks[:, b], minlength=256)
                hits[8 * b : 8 * b + 8] += tally @ _BITS
            letter = True
        if not letter or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        share = (hits[: len(self.languages)] / n - self.false) / (1 - self.false)
        best = int(share.argmax())
        return self.languages[best], float(np.clip(share[best], 0, 1))


_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = SHARE) -> LanguageFilter:
    """Learn from all rows with a text and a language.

    Every task adds up its own n-grams; what returns to the driver are one
    total per language and at most 1 / share n-grams per language.
    """
    text_batches(docs)
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang)
    counts = (
        labelled.mapInArrow(_count_grams, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    ).persist()
    try:
        totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
        if not totals:
            return LanguageFilter({})
        least = F.create_map(*[F.lit(x) for k, v in totals.items() for x in (k, float(v) * share)])
        common = counts.where(F.col("n") >= least[F.col("lang")])
        grams = common.groupBy("lang").agg(F.collect_list("gram")).collect()
    finally:
        counts.unpersist()
    return LanguageFilter({r[0]: np.array(sorted(r[1]), np.int64) for r in grams})


def identify(docs: DataFrame, model: LanguageFilter, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, the corrected share of the winner's n-grams.

    Null texts and texts without a letter are `und` with score 0, and so is all
    text if nothing was learned.  Equal shares go to the first language by
    name.  Columns of docs with those two names are replaced, all others stay;
    repeated rows get equal answers; an empty table gives an empty table.
    """
    text_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        found = [model.predict(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
            names=["lang_pred", "score"],
        )

    answer = F.arrow_udf(predict, "lang_pred string, score double")
    found = "_found"
    while found in docs.columns:
        found += "_"
    out = docs.withColumn(found, answer(F.col(text)))
    return out.withColumns(
        {"lang_pred": F.col(f"{found}.lang_pred"), "score": F.col(f"{found}.score")}
    ).drop(found)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold_of(F.col("doc_id")) == 0
    model = train(docs.where(~held_out))
    asked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return identify(asked, model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
