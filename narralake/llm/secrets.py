"""Operator 12, secret scans: known forms of secrets, and stretches of high entropy.

Known forms are three patterns.  Everything else that looks random is found by
its Shannon entropy: candidates are long runs of the characters of a class,
a window slides over each and its entropy is kept up to date by the counts of
the one character that leaves and the one that enters.  Windows at or over the
entropy of their class make a span; allowed strings suppress what they cover.

A text is scanned alone, so the whole scan is one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm.common import table, text_batches

# The known forms, in the order in which equal starts are listed.
# Each is a pattern, the group that counts and its least length.  Letters are
# folded for ASCII alone.
BASE = {
    "assign": (
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        2,
        6,
    ),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}


class EntropyClass(NamedTuple):
    """A class of characters: candidates are runs of at least `window` of them."""

    name: str
    characters: str
    window: int
    #: Bits a character from which on a window is random.
    least: float
    #: Patterns that a candidate and a span must each match somewhere, such as a digit.
    needs: tuple[str, ...]


#: A window of 20 characters has at most log2(20) = 4.32 bits.  Words of a
#: language have letters alone, so classes with letters ask for digits, too.
CLASSES = (
    EntropyClass("hexdigits", "0-9A-Fa-f", 20, 3.0, (r"[0-9]", r"[A-Fa-f]")),
    EntropyClass("alphanumeric", "0-9A-Za-z", 20, 3.6, (r"[0-9].*[0-9]", r"[A-Za-z]")),
    EntropyClass("base64", "0-9A-Za-z+/=_-", 24, 4.0, (r"[0-9].*[0-9]", r"[A-Z]", r"[a-z]")),
)

#: What is no secret although it may look random.  A span that lies inside a
#: match of one of these, with word characters on neither side, is suppressed.
ALLOWED = (
    # Identifiers by the rules of UUIDs.
    r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",
    # Addresses of pages and of mail.
    r"[a-z][a-z0-9+.]*://[^\s\"'<>]+",
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+",
    # Digests that say what they are.
    r"(?:sha(?:1|224|256|384|512)|md5)[:-][0-9A-Za-z+/=]+",
    # Values put in place of secrets, and the alphabet itself.
    r"[A-Za-z0-9+/_=-]*(?:EXAMPLE|example|placeholder|PLACEHOLDER|your[_-]|YOUR[_-])[A-Za-z0-9+/_=-]*",
    r"[A-Za-z0-9+/_=-]*(?:abcdefghijklm|ABCDEFGHIJKLM|0123456789)[A-Za-z0-9+/_=-]*",
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def high_windows(text: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Unions of all windows whose Shannon entropy is at least `least` bits a character.

    The entropy of a window is log2(w) - sum(c * log2(c)) / w over the counts c
    of its characters; a step changes two counts, so it costs two table reads.
    The counts are integers; their part of the entropy is looked up, and the
    running sum is computed anew from the counts each `window` steps, so that
    no error builds up.
    """
    if len(text) < window:
        return
    part = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    most = (math.log2(window) - least) * window + 1e-9
    counts: dict[str, int] = {}
    for c in text[:window]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(part[n] for n in counts.values())
    start = end = -1
    for at in range(len(text) - window + 1):
        if at:
            gone, new = text[at - 1], text[at + window - 1]
            if gone != new:
                n, m = counts[gone], counts.get(new, 0)
                counts[gone], counts[new] = n - 1, m + 1
                total += part[n - 1] - part[n] + part[m + 1] - part[m]
            if at % window == 0:
                total = sum(part[n] for n in counts.values())
        if total <= most:
            if at > end:
                if end >= 0:
                    yield start, end
                start = at
            end = at + window
    if end >= 0:
        yield start, end


class Scanner:
    """Finds the spans of secrets in a text."""

    def __init__(self, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED):
        # Runs of one class of characters cannot overlap, so asking for the
        # least length at once finds the same runs as filtering them later.
        self.assign = re.compile(BASE["assign"][0], re.ASCII)
        self.access = re.compile(r"AKIA[A-Z0-9]{16,}")
        self.hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
        self.classes = [
            (
                c,
                re.compile(f"(?<![{c.characters}])[{c.characters}]{{{c.window},}}"),
                [re.compile(n) for n in c.needs],
            )
            for c in classes
        ]
        self.allowed = [re.compile(rf"(?<!\w)(?:{a})(?!\w)") for a in allowed]

    def base(self, text: str) -> list[Span]:
        """All matches of the known forms, leftmost and without overlaps within a kind."""
        found = [Span("assign", *m.span()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= 6]
        found += [Span("access", *m.span()) for m in self.access.finditer(text)]
        found += [Span("hex", *m.span()) for m in self.hex.finditer(text)]
        return found

    def entropy(self, text: str, covers: list[Span]) -> list[Span]:
        """Stretches of high entropy, named by class, outside allowed strings and `covers`.

        A stretch inside one of a class listed before says nothing new and is
        left out.
        """
        found: list[Span] = []
        covers = list(covers)
        for c, candidate, needs in self.classes:
            own = []
            for m in candidate.finditer(text):
                run, at = m.group(), m.start()
                if not all(n.search(run) for n in needs):
                    continue
                for start, end in high_windows(run, c.window, c.least):
                    if all(n.search(run, start, end) for n in needs):
                        own.append(Span(c.name, at + start, at + end))
            if own and not found:
                covers += [Span("allowed", *m.span()) for a in self.allowed for m in a.finditer(text)]
            own = outside(own, covers)
            found += own
            covers += own
        return found

    def scan(self, text: str | None) -> tuple[list[Span], list[Span]]:
        """The base spans and the added ones, each by start, then kind as listed."""
        if not text:
            return [], []
        base = self.base(text)
        order = {k: i for i, k in enumerate([*BASE, *(c.name for c, *_ in self.classes)])}
        key = lambda s: (s.start, order[s.kind])
        return sorted(base, key=key), sorted(self.entropy(text, base), key=key)


def outside(spans: list[Span], covers: list[Span]) -> list[Span]:
    """The spans that lie in none of the covers."""
    covers = sorted((c.start, c.end) for c in covers)
    starts = [start for start, _ in covers]
    reach = list(accumulate((end for _, end in covers), max))
    kept = []
    for s in spans:
        at = bisect_right(starts, s.start)
        if not at or reach[at - 1] < s.end:
            kept.append(s)
    return kept


SPANS = "array<struct<kind: string, start: long, end: long>>"


def _spans_array(rows: list[list[Span]]) -> pa.ListArray:
    flat = [s for r in rows for s in r]
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([s._asdict() for s in flat], kind))


def secret_spans(
    text: Column, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED
) -> Column:
    """struct(base, added): the spans of each text in code points, ends exclusive.

    base are the known forms, added the stretches of high entropy.  A null or
    empty text has none; equal texts have equal spans.
    """
    scanner: list[Scanner] = []

    def run(texts: pa.Array) -> pa.Array:
        if not scanner:
            scanner.append(Scanner(classes, allowed))
        found = [scanner[0].scan(t) for t in texts.to_pylist()]
        parts = [_spans_array([f[k] for f in found]) for k in (0, 1)]
        return pa.StructArray.from_arrays(parts, ["base", "added"])

    return F.arrow_udf(run, f"struct<base: {SPANS}, added: {SPANS}>")(text)


def scan_secrets(
    docs: DataFrame,
    text: str = "text",
    output: str = "secrets",
    classes: tuple[EntropyClass, ...] = CLASSES,
    allowed: tuple[str, ...] = ALLOWED,
) -> DataFrame:
    """docs with the column `output`, the struct that secret_spans() describes.

    A column of that name is replaced, all others stay.  Every row keeps its
    own result, so null or repeated ids and equal rows need no care; an empty
    table gives an empty table.
    """
    text_batches(docs)
    return docs.withColumn(output, secret_spans(F.col(text), classes, allowed))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_secrets(docs)
    base, added = F.col("secrets.base"), F.col("secrets.added")
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    order = F.array(*(F.lit(k) for k in (*BASE, *(c.name for c in CLASSES))))
    by_start = F.array_sort(
        F.transform(
            F.concat(base, added),
            lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("at"), s["end"], s["kind"]),
        )
    )
    return found.select(
        "doc_id",
        number("assign").alias("n_assign"),
        number("access").alias("n_access"),
        number("hex").alias("n_hex"),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(by_start).alias("spans"),
    )


QUERIES = {"op12_secret_scan": op12_secret_scan}
#: Sliding entropy has no plain SQL; tests compare with windows counted one by one.
ORACLES: dict[str, str] = {}
