"""Operator 4, mixing sources to target weights, by Efraimidis-Spirakis sampling.  Built-in functions only.

Each source has a target in words.  Whole epochs of the source come first; what
remains of the target is a sample without replacement: documents get keys
-ln(u) / quality, ascending, and are taken while the running sum of their words
stays under the rest of the budget.

The running sum of a source never runs over the source's rows.  Keys fall into
fixed buckets of 1/1024 octave, so one row per (source, bucket) says how many
words lie below each bucket, and only the one bucket that the budget ends in is
ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narralake.llm.common import WORD, keep, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Buckets to an octave of the sampling key: the fullest holds about 1/4000 of a source.
BUCKETS = 1024
#: One row per source is broadcast up to this many sources; more are joined by shuffle.
SOURCES = 50_000

LETTERS = "[A-Za-zÀ-ɏ]{2,}"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_quality(text: Column, size: Column) -> Column:
    """From 0.1 to 1.1: the share of words that have two letters in a row."""
    runs = F.coalesce(F.regexp_count(text, F.lit(LETTERS)), F.lit(0))
    share = F.least(F.lit(1.0), runs.cast("double") / F.greatest(size, F.lit(1)))
    return F.lit(0.1) + share


def uniform(key: Column, seed: int) -> Column:
    """A number between 0 and 1 from 52 bits of the md5 of the id and the seed."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(2**52)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size -> target, __mix_epochs, rest; one row per source.

    Sources in order of code point, null last, have the weights in turn.  Where
    a target would pass `most` times its source, it stops there and the others
    share the excess by weight: with sources in order of their cap per weight,
    the first that keeps under its cap fixes the words per weight of the rest.
    """
    w = F.array(*[F.lit(x) for x in weights])
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    caps = sizes.withColumn("_w", F.get(w, turn)).withColumn("_cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.asc_nulls_last("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    budget = share * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    levels = caps.withColumn("_level", level).withColumn(
        "_free", F.when(F.col("_level") < F.col("_cap") / F.col("_w"), F.col("_level"))
    )
    # The first free source has the largest level of all free ones or the same.
    settled = levels.withColumn("_line", F.max("_free").over(everything))
    target = F.least(F.col("_cap"), F.coalesce(F.col("_line") * F.col("_w"), F.col("_cap")))
    out = settled.withColumn("target", target)
    epochs = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0))
    return out.select(
        "source", "source_size", "target", epochs.cast("long").alias("__mix_epochs")
    ).withColumn("rest", F.col("target") - F.col("__mix_epochs") * F.col("source_size"))


def _join_sources(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    same = rows["__mix_source"].eqNullSafe(sources["__mix_s"])
    return rows.join(F.broadcast(sources) if n <= SOURCES else sources, same, "left").drop("__mix_s")


def _first_of(rows: DataFrame) -> DataFrame:
    """Rows of which a source takes __mix_part.n: any of them, as all are equal in key and text.

    They are numbered within the tasks that wrote them, behind the rows of the
    tasks before, so that no task meets all of them.
    """
    kept = keep(rows.withColumn("__mix_id", F.monotonically_increasing_id()), "split")
    task, names = F.shiftright("__mix_id", 33), ["__mix_source", "__mix_task"]
    kept = kept.withColumn("__mix_task", task)
    before = Window.partitionBy("__mix_source").orderBy("__mix_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        kept.groupBy(*names)
        .agg(F.count("*").alias("__mix_n"))
        .select(
            F.col("__mix_source").alias("__mix_s"),
            F.col("__mix_task").alias("__mix_t"),
            F.coalesce(F.sum("__mix_n").over(before), F.lit(0)).alias("__mix_before"),
        )
    )
    same = F.col("__mix_source").eqNullSafe(F.col("__mix_s")) & (F.col("__mix_task") == F.col("__mix_t"))
    nth = F.col("__mix_before") + F.row_number().over(Window.partitionBy(*names).orderBy("__mix_id"))
    return (
        kept.join(counts, same)
        .withColumn("__mix_nth", nth)
        .withColumn("__mix_extra", F.when(F.col("__mix_nth") <= F.col("__mix_part.n"), 1).otherwise(0))
        .select(*rows.columns)
    )


def mix(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    source: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    quality: Column | None = None,
    seed: int = 17,
) -> DataFrame:
    """docs with size, source_size, target, copies (how often it is taken) and taken (words).

    A null text has size 0; documents without words are never worth anything
    and take 0 words.  Null is a source of its own, the last.  Rows with the
    same key and text are taken alike, but where the budget ends among them:
    there as many of them are taken as it holds.  A null key is a value like any other.
    An empty table gives an empty table.  Columns of docs that have the name of
    a result column are replaced, all others stay.  `quality` is any positive
    expression over docs.
    """
    size = word_count(F.col(text))
    good = quality if quality is not None else text_quality(F.col(text), F.col("size"))
    rows = (
        docs.withColumn("size", size)
        .withColumn("__mix_key", -F.log(uniform(F.col(key), seed)) / good)
        .withColumns(
            {
                "__mix_tie": F.xxhash64(key, text),
                "__mix_bucket": F.floor(F.log2("__mix_key") * BUCKETS).cast("long"),
                "__mix_source": F.col(source),
            }
        )
    )
    slim = keep(rows.select("__mix_source", "size", "__mix_key", "__mix_tie", "__mix_bucket"), "mix")
    buckets = slim.groupBy("__mix_source", "__mix_bucket").agg(F.sum("size").alias("n"))
    sizes = buckets.groupBy("__mix_source").agg(F.sum("n").alias("source_size"))
    per_source = keep(
        targets(sizes.withColumnRenamed("__mix_source", "source"), weights, share, most)
        .withColumnRenamed("source", "__mix_s"),
        "targets",
    )
    n_sources = per_source.count()
    upto = Window.partitionBy("__mix_source").orderBy("__mix_bucket")
    edge = (
        _join_sources(buckets.withColumn("__mix_upto", F.sum("n").over(upto)), per_source, n_sources)
        .where((F.col("__mix_upto") > F.col("rest")) & (F.col("__mix_upto") - F.col("n") <= F.col("rest")))
        .groupBy(F.col("__mix_source").alias("__mix_s"))
        .agg(
            F.min("__mix_bucket").alias("__mix_edge"),
            F.min_by(F.col("__mix_upto") - F.col("n"), "__mix_bucket").alias("__mix_below"),
            F.first("rest").alias("__mix_rest"),
        )
    )
    inside = _join_sources(slim, edge, n_sources).where(F.col("__mix_bucket") == F.col("__mix_edge"))
    # Rows equal in key and tie follow each other: the budget may end among them.
    equal = inside.groupBy("__mix_source", "__mix_key", "__mix_tie").agg(
        F.count("*").alias("__mix_n"),
        F.first("size").alias("size"),
        F.first("__mix_edge").alias("__mix_edge"),
        F.first("__mix_below").alias("__mix_below"),
        F.first("__mix_rest").alias("__mix_rest"),
    )
    run = Window.partitionBy("__mix_source").orderBy("__mix_key", "__mix_tie")
    upto_last = F.col("__mix_below") + F.sum(F.col("size") * F.col("__mix_n")).over(run)
    whole = F.col("__mix_upto") - F.col("size") / 2 <= F.col("__mix_rest")
    room = F.col("__mix_rest") - F.col("__mix_upto") + F.col("size") * F.col("__mix_n")
    some_of = F.coalesce(F.floor(room / F.nullif("size", F.lit(0)) + 0.5).cast("long"), F.lit(0).cast("long"))
    place = F.struct("__mix_key", "__mix_tie")
    cut = (
        equal.withColumn("__mix_upto", upto_last)
        .withColumn("__mix_whole", whole)
        .withColumn("__mix_some", F.when(~F.col("__mix_whole") & (F.col("__mix_n") > 1), some_of))
        .groupBy(F.col("__mix_source").alias("__mix_s2"))
        .agg(
            F.first("__mix_edge").alias("__mix_edge"),
            F.max(F.when(F.col("__mix_whole"), place)).alias("__mix_last"),
            F.min(F.when(F.col("__mix_some") > 0, F.struct(place.alias("place"), F.col("__mix_some").alias("n")))).alias("__mix_part"),
        )
    )
    decided = keep(
        per_source.join(cut, per_source["__mix_s"].eqNullSafe(cut["__mix_s2"]), "left").drop("__mix_s2", "rest"),
        "cuts",
    )
    chosen = (
        F.col("__mix_edge").isNull()
        | (F.col("__mix_bucket") < F.col("__mix_edge"))
        | ((F.col("__mix_bucket") == F.col("__mix_edge")) & (F.struct("__mix_key", "__mix_tie") <= F.col("__mix_last")))
    )
    # A source without an edge bucket is taken to its end, or has no rest at all.
    some = F.col("target") > F.col("__mix_epochs") * F.col("source_size")
    extra = F.when(some & F.coalesce(chosen, F.lit(False)), 1).otherwise(0)
    out = _join_sources(
        rows.drop("source_size", "target", "__mix_epochs", "__mix_edge", "__mix_last", "__mix_part"), decided, n_sources
    ).withColumn("__mix_extra", extra)
    if not decided.where("__mix_part IS NOT NULL").isEmpty():
        split = F.coalesce((F.col("__mix_bucket") == F.col("__mix_edge")) & (place == F.col("__mix_part.place")), F.lit(False))
        out = out.where(~split).unionByName(_first_of(out.where(split)))
    return (
        out.withColumn("copies", (F.col("__mix_epochs") + F.col("__mix_extra")).cast("long"))
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop(
            "__mix_key", "__mix_tie", "__mix_bucket", "__mix_source", "__mix_edge", "__mix_last", "__mix_part",
            "__mix_extra", "__mix_epochs",
        )
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(len(regexp_extract_all(text, '{LETTERS}')), 0) AS runs,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|17'), 1, 13))::BIGINT::DOUBLE + 0.5)
           / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (0.1 + least(1.0, runs::DOUBLE / greatest(size, 1))) AS k FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
      FROM s),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (SELECT 1.5::DOUBLE * sum(source_size) FROM w) AS budget FROM w),
-- words per weight if exactly the sources with a smaller cap per weight are full
l AS (SELECT *,
             (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST
                ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM c),
line AS (SELECT max(level) AS line FROM l WHERE level < cap / w),
t AS (SELECT source, source_size, least(cap, coalesce(line * w, cap)) AS target FROM l LEFT JOIN line ON true),
e AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.k, k.doc_id) - k.size / 2.0::DOUBLE AS middle
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       ((epochs + CASE WHEN target > epochs * source_size AND middle <= target - epochs * source_size
                       THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r
"""

QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLES = {"op4_mix_sources": OP4_SQL}
