"""A corpus, step by step: language, near copies, repeated passages, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before has kept.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.llm import jaccard, languages, mixing, packing, passages
from narralake.llm.common import keep, sieve, table, unused

#: A text is rejected if less than this share of its letter runs belongs to its language.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled texts; `und` and texts like no language go."""
    found = languages.identify(docs, languages.train(docs))
    kept = (F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(kept).select(*docs.columns)


def row_key() -> Column:
    """Names a row by its id and text: ids may be null, or stand for several texts."""
    return F.struct("doc_id", F.xxhash64("text").alias("text_hash"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays: the one with the least id, once.

    Rows repeated in id and text are one document.  Only documents of which
    some row may go are shuffled; all others pass as they are.
    """
    key = unused(docs, "_row")
    rows = docs.withColumn(key, row_key())
    classes = jaccard.similar_documents(rows.select(F.col(key).alias("_row"), "text"), key="_row")
    gone = keep(classes.where(F.col("_row") != F.col("class_id")).select(F.col("_row").alias(key)).distinct(), "gone")
    again = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)
    touched, clean = sieve(rows, F.col(key), gone.unionByName(again), "touched")
    left = touched.join(gone, key, "left_anti").dropDuplicates([key])
    return clean.unionByName(left).select(*docs.columns)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand in another document, too; documents without words left go."""
    key, found = unused(docs, "_row"), unused(docs, "_spans")
    rows = docs.withColumn(key, row_key())
    spans = passages.repeated_passages(rows.select(F.col(key).alias("_row"), "text"), key="_row")
    sets = spans.groupBy("_row").agg(F.collect_set(F.struct("start", "end")).alias(found))
    per_row = keep(sets.withColumnRenamed("_row", key), "spans")
    touched, clean = sieve(rows, F.col(key), per_row.select(key), "touched")
    cut = touched.join(per_row, key, "left").withColumn("text", passages.cut_words("text", found))
    kept = cut.where(F.col(found).isNull() | (F.length("text") > 0))
    resized = kept.withColumn("n_chars", F.length("text").cast("long"))
    return clean.select(*docs.columns).unionByName(resized.select(*docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs).where(F.col("copies") > 0)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    time = unused(docs, "_time")
    return mixed.select(*docs.columns, times.alias(time)).drop(time)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("cut_passages", cut_passages),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: Models and joins by sampled paths have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
