"""Byte-level BPE of whole texts through a cache of pre-tokens, and operator 3, token counts.

The library splits a text at its special strings, then by one pattern into
pre-tokens, and merges bytes inside each pre-token alone, so the ids of a text
are the ids of its pre-tokens in order.  That makes a table from pre-token to
ids (or to their number) exact.  Frequent pre-tokens come with the broadcast,
the others are encoded once and stay in a worker's bounded cache; no pre-token
is ever shuffled.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from narralake.llm.common import heaviest, keep, rows_of, table, text_batches

VOCABULARY = "byte_bpe_50k"
LIMIT = 1024
FREQUENT = 65_536
#: Distinct entries that a worker keeps; beyond it the cache starts anew.
CACHE = 300_000

# Characters for which Python's own classes split as the tokenizer's pattern
# does (a test compares them one by one).  A text with any other character is
# encoded by the library as a whole.
_SAFE = (
    r"\t\n\r\x20-\x7e\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-ɏЀ-ԯ"
    r"‐-‧‰-⁞₠-₵"
)
OTHER = re.compile(f"[^{_SAFE}]")
PRETOKEN = re.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
)


@lru_cache(2)
def library(vocabulary: str = VOCABULARY) -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@lru_cache(2)
def merges(vocabulary: str = VOCABULARY) -> tiktoken.Encoding:
    """The same vocabulary as ranks; it encodes one pre-token in a third of the time."""
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(
        vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


class IdCache(dict):
    """Pre-token to its ids as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str):
        self._encode = merges(vocabulary).encode_ordinary

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        value = self[piece] = np.array(self._encode(piece), "<u4").tobytes()
        return value


class CountCache(dict):
    """Pre-token to its number of ids; `frequent` is never dropped."""

    def __init__(self, vocabulary: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self._frequent = frequent
        self._encode = merges(vocabulary).encode_ordinary

    def __missing__(self, piece: str) -> int:
        if len(self) >= CACHE + len(self._frequent):
            self.clear()
            self.update(self._frequent)
        value = self[piece] = len(self._encode(piece))
        return value


class BytePairs:
    """Ids and counts of whole texts, equal to the library's default encoding."""

    def __init__(self, vocabulary: str = VOCABULARY, frequent: dict[str, int] | None = None):
        self.library = library(vocabulary)
        special = self.library.get_added_tokens_decoder()
        self.special = {t.content: i for i, t in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.ids_of = IdCache(vocabulary)
        self.count_of = CountCache(vocabulary, frequent or {})

    def _parts(self, text: str) -> list[str]:
        """Ordinary and special strings in turn."""
        found = any(s in text for s in self.special)
        return self.split.split(text) if found else [text]

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if OTHER.search(text):
            got = self.library.encode(text, add_special_tokens=False).ids
            return np.array(got, "<u4").tobytes()
        out = []
        for i, part in enumerate(self._parts(text)):
            if i % 2:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            else:
                out.append(b"".join(map(self.ids_of.__getitem__, PRETOKEN.findall(part))))
        return b"".join(out)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if OTHER.search(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(
            1 if i % 2 else sum(map(self.count_of.__getitem__, PRETOKEN.findall(part)))
            for i, part in enumerate(self._parts(text))
        )


@lru_cache(2)
def byte_pairs(vocabulary: str) -> BytePairs:
    """One per worker process, so its cache lives as long as the worker."""
    return BytePairs(vocabulary)


def pruned(counts: Counter, size: int) -> Counter:
    """Misra-Gries: keep `size` entries and subtract the first count left out."""
    top = counts.most_common(size + 1)
    cut = top[size][1] if len(top) > size else 0
    return Counter({w: c - cut for w, c in top[:size] if c > cut})


def _heavy_words(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in rows_of(batches, 500):
            for text in batch.column(0).to_pylist():
                counts.update((text or "").split())
            if len(counts) > 6 * size:
                counts = pruned(counts, size)
        top = pruned(counts, size)
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(list(top), pa.string()), "n": pa.array(top.values(), pa.int64())}
        )

    return run


def frequent_words(docs: DataFrame, text: str, size: int = FREQUENT) -> list[str]:
    """The heaviest words of all texts.

    Every task keeps a Misra-Gries summary of `size` words over all its texts;
    the summaries, not the words, are added up.  At most `size` words return,
    and no others reach the driver.
    """
    found = docs.select(text).mapInArrow(_heavy_words(size), "word string, n long")
    counts = keep(found.groupBy("word").agg(F.sum("n").alias("n")), "summaries")
    return [r[0] for r in counts.where(heaviest(counts, "word", "n", size)).select("word").collect()]


def pretoken_lengths(found: list[str], vocabulary: str = VOCABULARY) -> dict[str, int]:
    """Number of ids of each pre-token of the given words, with and without a space before."""
    pieces = {p for w in found if not OTHER.search(w) for t in (w, " " + w) for p in PRETOKEN.findall(t)}
    encode = merges(vocabulary).encode_ordinary
    return {p: len(encode(p)) for p in sorted(pieces)}


def token_counts(
    docs: DataFrame,
    text: str = "text",
    vocabulary: str = VOCABULARY,
    limit: int = LIMIT,
    frequent: int = FREQUENT,
) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more than `limit` tokens).

    A null or empty text has 0 bytes and 0 tokens.  Equal rows count alike;
    columns of docs with those three names are replaced, all others stay.  An
    empty table gives an empty table.  The broadcast table holds at most
    2 * `frequent` words' pre-tokens.
    """
    text_batches(docs)
    spark = docs.sparkSession
    lengths = spark.sparkContext.broadcast(
        pretoken_lengths(frequent_words(docs, text, frequent), vocabulary)
    )
    coders: dict = {}

    def count(texts: pa.Array) -> pa.Array:
        if not coders:
            coders[0] = BytePairs(vocabulary, lengths.value)
        return pa.array([coders[0].count(t) for t in texts.to_pylist()], pa.int64())

    counted = F.arrow_udf(count, "long")
    n_bytes = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    out = docs.withColumns({"n_bytes": n_bytes, "n_tokens": counted(F.col(text))})
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


QUERIES = {"op3_token_counts": op3_token_counts}
ORACLES: dict[str, str] = {}
