"""Operator 13, source divergence audit: how far the sources of a language differ in their terms.

Smoothed shares of terms are compared in whole numbers, so all results are
exact.  A value depends only on how often a term occurs in the group and in
what it is compared with, and few pairs of counts occur, whatever the number
of terms.  So terms are grouped into cells of equal counts, values are found
and ranked once a cell, by the cumulative number of its terms, cells of equal
value are one, and only cells that reach the wanted ranks are turned back into
terms, in the order of UTF-8.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narralake.llm.common import keep, table

#: A term is kept in a language if so many of its documents have it.
LEAST_DOCUMENTS = 3
#: Shares are counted in parts of a thousand million.
UNIT = 1_000_000_000
#: Ranks that part `term` returns.
RANKS = 200
#: Distinct (lang, source, term), or cells, that a task counts before it hands them on.
HELD = 400_000
#: Joins of terms with their group are dealt out over so many salts a group.
SALTS = 32
#: Rows whose pairs of sources a task counts at a time.
ROWS = 200_000

#: Bytes of UTF-8 that belong to terms, A-Z as a-z; all others part terms.
FOLDED = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def total() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in groups.items():
            # Both counters met their terms in the same order.  A group is there even without terms.
            terms, n, with_term = [None, *times], [0, *times.values()], [0, *docs.values()]
            same = [pa.repeat(pa.scalar(x, pa.string()), len(terms)) for x in (lang, source)]
            counts = (pa.array(terms, pa.binary()), pa.array(n, pa.int64()), pa.array(with_term, pa.int64()))
            yield pa.RecordBatch.from_arrays([*same, *counts], ["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            times, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(times)
            found = Counter(text.translate(FOLDED).split())
            times.update(found)
            docs.update(found.keys())
            held += len(times)
            if held >= HELD:
                yield from total()
                groups.clear()
                held = 0
    yield from total()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs of every group and term; term is null in one row a group.

    Null lang, source and text are ''.  Tasks count before the shuffle, over
    all their texts, in a bounded number of entries.
    """
    whole = docs.select(
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"),
    )
    counted = whole.mapInArrow(_count_terms, "lang string, source string, term binary, n long, docs long")
    return (
        counted.withColumn("term", F.col("term").cast("string"))
        .groupBy("lang", "source", "term")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )


def part(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (total + terms)) of whole numbers, by long division.

    Each of three steps brings a thousandfold remainder down, so that nothing
    overflows below some 10**15 words a language (and what does is an error).
    """
    below = total + terms
    found, rest = F.lit(1).cast("long"), count + 1
    for unit in (UNIT // 1000, UNIT // 1_000_000, 1):
        found = found + F.call_function("div", rest * 1000, below) * unit
        rest = F.pmod(rest * 1000, below)
    return found


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q) squared / q); p and q are at most UNIT + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Join rows with the one row of their group; a hot group is dealt out over salts."""
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = rows.withColumn("__salt", F.pmod(F.hash("term"), F.lit(SALTS)))
    return mine.join(salted, [*keys, "__salt"]).drop("__salt")


def kept_terms(counts: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n and lang_n of the terms in at least `least` documents of their language."""
    terms = counts.where(F.col("term").isNotNull())
    per_lang = terms.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    return terms.drop("docs").join(per_lang.where(F.col("docs") >= least).drop("docs"), ["lang", "term"])


def group_totals(counts: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, n_group, n_lang, v: words of kept terms in the group and its language, and their number."""
    groups = counts.where(F.col("term").isNull()).select("lang", "source")
    per_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    per_lang = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n"))
    per_lang = per_lang.groupBy("lang").agg(F.sum("lang_n").alias("n_lang"), F.count("*").alias("v"))
    zero = {"n_group": 0, "n_lang": 0, "v": 0}
    return groups.join(per_group, ["lang", "source"], "left").join(per_lang, "lang", "left").fillna(zero)


def term_ranks(kept: DataFrame, groups: DataFrame, ranks: int = RANKS) -> DataFrame:
    """The terms that a group has more of than its language, by value, up to rank `ranks`."""
    here = Window.partitionBy("lang", "source")
    cells = kept.groupBy("lang", "source", "n", "lang_n").agg(F.count("*").alias("times"))
    p, q = part(F.col("n"), F.col("n_group"), F.col("v")), part(F.col("lang_n"), F.col("n_lang"), F.col("v"))
    salted = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    valued = (
        cells.withColumn("__salt", F.pmod(F.hash("n", "lang_n"), F.lit(SALTS)))
        .join(salted, ["lang", "source", "__salt"])
        .withColumns({"p": p, "q": q})
        .where("p > q")
        .withColumn("value", divergence(F.col("p"), F.col("q")))
    )
    merged = valued.groupBy("lang", "source", "value").agg(F.sum("times").alias("times"))
    # Each value has one term at least, so later values than the first `ranks` reach no rank.
    first = merged.withColumn("place", F.row_number().over(here.orderBy(F.desc("value")))).where(F.col("place") <= ranks)
    before = F.sum("times").over(here.orderBy(F.desc("value"))) - F.col("times")
    reached = first.withColumn("before", before).where(F.col("before") < ranks).select("lang", "source", "value", "before")
    # Back to the cells of these values, then to their terms.
    chosen = valued.select("lang", "source", "n", "lang_n", "value").join(reached, ["lang", "source", "value"])
    terms = cells_to_terms(kept, chosen)
    ordered = here.orderBy(F.desc("value"), "term")
    return (
        terms.withColumn("rank", F.row_number().over(ordered))
        .where(F.col("rank") <= ranks)
        .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    )


def cells_to_terms(kept: DataFrame, chosen: DataFrame) -> DataFrame:
    """lang, source, value, term of the terms in chosen cells; a cell of many terms is dealt out over salts."""
    keys = ["lang", "source", "n", "lang_n"]
    return with_group(kept, chosen, keys).select("lang", "source", "value", "term")


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of two sources' counts from rows in order of (lang, term), so that a term's rows are together."""
    keys = ["lang", "source", "other", "n", "other_n"]

    def cells(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, term = (rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term"))
        at = np.arange(len(rows))
        found, n = [], 0
        for step in range(1, len(rows)):
            at = at[at + step < len(rows)]
            at = at[(term[at] == term[at + step]) & (lang[at] == lang[at + step])]
            if not len(at):
                break
            one, two = rows.take(pa.array(at)), rows.take(pa.array(at + step))
            pairs = pa.table([one["lang"], one["source"], two["source"], one["n"], two["n"]], keys)
            found.append(summed(pairs.append_column("times", pa.array(np.ones(len(at), np.int64)))))
            n += len(found[-1])
            if n >= HELD:
                yield from summed(pa.concat_tables(found)).to_batches()
                found, n = [], 0
        if found:
            yield from summed(pa.concat_tables(found)).to_batches()

    def summed(t: pa.Table) -> pa.Table:
        return t.group_by(keys).aggregate([("times", "sum")]).rename_columns([*keys, "times"])

    held: list[pa.RecordBatch] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        rows = pa.Table.from_batches(held)
        held = []
        if not last:
            # The last term may go on in the next batch.
            lang, term = (rows[c].combine_chunks() for c in ("lang", "term"))
            end = len(rows) - 1
            while end > 0 and term[end - 1].as_py() == term[-1].as_py() and lang[end - 1].as_py() == lang[-1].as_py():
                end -= 1
            held = rows.slice(end).to_batches()
            rows = rows.slice(0, end)
        yield from cells(rows)

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= ROWS:
            yield from flush(False)
    if held:
        yield from flush(True)


def pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """For each two sources of a language the sum of the divergence over all kept terms.

    Terms that neither or only one of the two has are counted by count alone:
    with D(c, d) the value at counts c and d, the sum over all terms is
    v D(0, 0) + sum over one's terms of D(c, 0) - D(0, 0) + the same of the
    other + sum over terms of both of D(c, d) - D(c, 0) - D(0, d) + D(0, 0).
    Cells of terms of both are found within tasks and valued where they are;
    each is there once for two sources and is valued in both directions.
    """
    zero = F.lit(0).cast("long")
    one = groups.select("lang", "source", F.col("n_group").alias("n_source"), "v")
    two = groups.select("lang", F.col("source").alias("other"), F.col("n_group").alias("n_other"))
    sides = one.join(two, "lang").where(F.col("source") != F.col("other"))
    n, m = F.col("n"), F.col("other_n")
    mine = lambda c: part(c, F.col("n_source"), F.col("v"))
    theirs = lambda c: part(c, F.col("n_other"), F.col("v"))
    keys = ["lang", "source", "other"]

    ordered = kept.select("lang", "term", "source", "n").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    cells = ordered.mapInArrow(_count_cells, "lang string, source string, other string, n long, other_n long, times long")
    shares = {"p": mine(n), "p0": mine(zero), "q": theirs(m), "q0": theirs(zero)}
    p, p0, q, q0 = (F.col(c) for c in shares)
    there = divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)
    back = divergence(q, p) - divergence(q, p0) - divergence(q0, p) + divergence(q0, p0)
    both = (
        cells.join(sides, keys)
        .withColumns(shares)
        .groupBy(keys)
        .agg(F.sum(there * F.col("times")).alias("there"), F.sum(back * F.col("times")).alias("back"))
    )
    directions = F.array(
        F.struct("source", "other", F.col("there").alias("change")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("other"), F.col("back").alias("change")),
    )
    changes = both.select("lang", F.explode(directions).alias("d")).select("lang", "d.*")

    # Terms of one of the two, valued in both directions as well.
    single = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).join(sides, ["lang", "source"])
    alone = single.withColumns({"p": mine(n), "p0": mine(zero), "q0": theirs(zero)}).groupBy(keys).agg(
        F.sum((divergence(p, q0) - divergence(p0, q0)) * F.col("times")).alias("there"),
        F.sum((divergence(q0, p) - divergence(q0, p0)) * F.col("times")).alias("back"),
    )
    changes = changes.unionByName(alone.select("lang", F.explode(directions).alias("d")).select("lang", "d.*"))
    changes = changes.groupBy(keys).agg(F.sum("change").alias("change"))

    base = F.when(F.col("v") > 0, F.col("v") * divergence(mine(zero), theirs(zero))).otherwise(zero)
    value = base + F.coalesce("change", zero)
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        sides.join(changes, keys, "left")
        .select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), value.alias("value"))
        .withColumn("rank", F.row_number().over(by_value))
    )


def divergence_audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) of docs (lang, source, text).

    Part `pair`: how far the group is from each other source of its language.
    Part `term`: the terms that the group has more of than its language, up to
    rank `ranks`.  Nulls are ''; each row is a document, so repeated rows count
    each time.  Equal values rank by the bytes of the item.  Groups without
    terms are there; an empty table gives none.  Other columns of docs are not
    looked at.
    """
    counts = keep(term_counts(docs), "term-counts")
    kept = keep(kept_terms(counts, least), "kept-terms")
    groups = keep(group_totals(counts, kept), "group-totals")
    return pair_values(kept, groups).unionByName(term_ranks(kept, groups, ranks))


def op13_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY lang, term
      HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, sum(lang_n)::HUGEINT AS n_lang, count(*) AS v FROM k GROUP BY lang),
t AS (SELECT lang, source, sum(n)::HUGEINT AS n_group FROM c GROUP BY lang, source),
g AS (SELECT s.lang, s.source, coalesce(n_group, 0)::HUGEINT AS n_group, coalesce(n_lang, 0)::HUGEINT AS n_lang,
             coalesce(v, 0) AS v
      FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN t USING (lang, source) LEFT JOIN l USING (lang)),
-- every group with every kept term of its language
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
             1 + ({UNIT}::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n_group + g.v) AS p,
             1 + ({UNIT}::HUGEINT * (k.lang_n + 1)) // (g.n_lang + g.v) AS q
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, item, value::BIGINT AS value,
                  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM terms)
SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value,
       row_number() OVER (PARTITION BY a.lang, a.source ORDER BY coalesce(value, 0) DESC, b.source)::INTEGER AS rank
FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
UNION ALL
SELECT lang, source, 'term', item, value, rank FROM ranked WHERE rank <= {RANKS}
"""

QUERIES = {"op13_divergence_audit": op13_divergence_audit}
ORACLES = {"op13_divergence_audit": OP13_SQL}
