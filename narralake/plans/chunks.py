"""Queries of the chunking operators and chunk statistics, with their checks."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from narralake.functions import chunking as ck
from narralake.functions import text as tx
from narralake.functions.rows import explode_once
from narralake.operators import chunks as ch
from narralake.plans import chunk_sql as cs
from narralake.plans import corpus
from narralake.plans.views_sql import PARAGRAPHED, with_recursive
from narralake.sources import tables as tb
from narralake.sources.sinks import write_by_bucket


def _docs(spark, sf_dir):
    """Paragraphed documents."""
    return tb.documents(spark, sf_dir).select(
        "doc_id", "lang", "source", tb.paragraphed(F.col("text")).alias("text")
    )


def _pieces(fn):
    """Rows of an array made from each document text."""

    def query(spark, sf_dir):
        return ch.explode_chunks(_docs(spark, sf_dir), fn(F.col("text")), "doc_id")

    return query


def _sentences(c):
    return tx.split_sentences(c)


def _units(c):
    return ck.semantic_units(c)


def _packed(c):
    return ck.pack_units(_units(c))


def _merged(c):
    return ck.merge_small(_packed(c))


def clamp_cap(spark, sf_dir):
    """Caps asked for by each document; every seventh asks for none."""
    asked = F.when(F.col("doc_id") % 7 != 0, F.col("n_chars"))
    return tb.documents(spark, sf_dir).select(
        "doc_id", ck.clamp_cap(asked).cast("bigint").alias("cap")
    )


def corpus_chunks(spark, sf_dir):
    """The chunk table: one row per chunk of every document."""
    return ch.chunk_documents(_docs(spark, sf_dir), "lang", "source")


def chunk_corpus(spark, sf_dir):
    return corpus_chunks(spark, sf_dir).select("doc_id", "chunk_idx", "text")


def chunk_preview(spark, sf_dir):
    return ch.chunk_preview(corpus_chunks(spark, sf_dir))


def chunk_stats(spark, sf_dir):
    """Statistics per document; documents without chunks have zeros."""
    docs = _docs(spark, sf_dir).withColumn(
        "text", F.when(F.col("doc_id") % 50 == 0, F.lit(" \n ")).otherwise(F.col("text"))
    )
    return ch.document_stats(docs)


def chunk_stats_rollup(spark, sf_dir):
    return ch.stats_rollup(corpus_chunks(spark, sf_dir))


def write_chunks(spark, sf_dir):
    """Write the chunk table and read it back by document bucket."""
    folder = os.path.join(tb.scratch_dir(spark, "chunks"), "table")
    write_by_bucket(corpus_chunks(spark, sf_dir), "doc_id", folder)
    stored = spark.read.parquet(folder)
    return stored.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.countDistinct("doc_id").alias("documents"),
        F.sum("char_count").alias("chars"),
    )


def sentence_stats(spark, sf_dir):
    """Sentence counts and lengths of the cleaned corpus by language."""
    cleaned = tb.documents(spark, sf_dir).select("lang", tx.clean_text(F.col("text")).alias("text"))
    sentences = explode_once(cleaned, tx.split_sentences(F.col("text")), "s", "pos", "lang")
    return sentences.groupBy("lang").agg(
        F.count(F.lit(1)).alias("sentences"),
        F.sum(F.length("s").cast("bigint")).alias("chars"),
        F.max(F.length("s").cast("bigint")).alias("longest"),
    )


QUERIES = {
    "split_paragraphs": _pieces(tx.split_paragraphs),
    "split_sentences": _pieces(_sentences),
    "hard_split": _pieces(lambda c: ck.hard_split(c, 900)),
    "semantic_units": _pieces(_units),
    "pack_units": _pieces(_packed),
    "merge_small": _pieces(_merged),
    "repack_oversized": _pieces(lambda c: ck.repack_oversized(_merged(c))),
    "merge_validation_small": _pieces(
        lambda c: ck.merge_validation_small(tx.split_paragraphs(c), ck.SMALL_CHUNK, 1000)
    ),
    "fix_incomplete_endings": _pieces(
        lambda c: ck.fix_incomplete_endings(ck.hard_split(tx.collapse_spaces(F.replace(c, F.lit("\n"), F.lit(" "))), 400), 700)
    ),
    "validate_chunks": _pieces(lambda c: ck.validate_chunks(_merged(c), 600)),
    "chunk_corpus": chunk_corpus,
    "clamp_cap": clamp_cap,
    "chunk_preview": chunk_preview,
    "chunk_stats": chunk_stats,
    "chunk_stats_rollup": chunk_stats_rollup,
    "write_chunks": write_chunks,
    "sentence_stats": sentence_stats,
}

# ----------------------------------------------------------------- SQL side --
_SRC = "src AS (SELECT doc_id, 1 AS i, text FROM paragraphed)"
_OUT = "\nSELECT doc_id, CAST(i AS BIGINT) AS chunk_idx, text FROM {}"


def _sql(*ctes: str, out: str) -> str:
    return with_recursive(PARAGRAPHED, _SRC, *ctes) + _OUT.format(out)


_UNITS = cs.semantic_units("u", "src")
_PACK = cs.pack_units("k", "u")
_MERGE = cs.merge_small("m", "k")
_CORPUS = with_recursive(PARAGRAPHED, _SRC, cs.BODY, cs.chunk_corpus("c", "body"))
_STATS = """count(text) AS total_chunks,
  coalesce(round(sum(length(text)) / count(text), 1), 0.0) AS avg_chunk_length,
  coalesce(min(length(text)), 0) AS min_chunk_length, coalesce(max(length(text)), 0) AS max_chunk_length,
  count(*) FILTER (length(text) < 350) AS count_below_soft_min,
  count(*) FILTER (length(text) > 2500) AS count_above_2500,
  count(*) FILTER (length(text) < 300) AS count_small_chunks,
  count(*) FILTER (length(text) > 1300) AS count_large_chunks"""

ORACLES = {
    "split_paragraphs": _sql(cs.paragraphs("p", "src"), out="p"),
    "split_sentences": _sql(cs.sentences("s", "src"), out="s"),
    "hard_split": _sql(cs.hard_pieces("h", "src", 900), out="h"),
    "semantic_units": _sql(_UNITS, out="u"),
    "pack_units": _sql(_UNITS, _PACK, out="k"),
    "merge_small": _sql(_UNITS, _PACK, _MERGE, out="m"),
    "repack_oversized": _sql(_UNITS, _PACK, _MERGE, cs.repack("r", "m", 1300), out="r"),
    "merge_validation_small": _sql(
        cs.paragraphs("p", "src"), cs.merge_validation("v", "p", 300, 1000), out="v"
    ),
    "fix_incomplete_endings": _sql(
        "flat AS (SELECT doc_id, i, regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g') AS text FROM src)",
        cs.hard_pieces("h", "flat", 400),
        cs.fix_endings("e", "h", 700),
        out="e",
    ),
    "validate_chunks": _sql(_UNITS, _PACK, _MERGE, cs.validate("v", "m", 600), out="v"),
    "chunk_corpus": _CORPUS + _OUT.format("c"),
    "clamp_cap": """SELECT doc_id, greatest(600, least(1300, coalesce(
  CASE WHEN doc_id % 7 <> 0 THEN n_chars END, 1300))) AS cap FROM documents""",
    "chunk_preview": _CORPUS + """
SELECT doc_id, CAST(i AS BIGINT) AS index, length(text) AS char_count,
  CASE WHEN length(text) <= 300 THEN text ELSE left(text, 300) || '…' END AS preview, text AS full_text,
  CASE WHEN length(text) < 300 THEN 'Too small' WHEN length(text) > 1300 THEN 'Too large' END AS warning
FROM c""",
    "chunk_stats": _CORPUS + f"""
SELECT d.doc_id, {_STATS} FROM documents d
LEFT JOIN c ON c.doc_id = d.doc_id AND d.doc_id % 50 <> 0
GROUP BY d.doc_id""".replace("count(*)", "count(c.text)").replace("(text)", "(c.text)"),
    "chunk_stats_rollup": _CORPUS + f"""
SELECT lang, source, {_STATS} FROM c JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)
GROUP BY ROLLUP (lang, source)""",
    "sentence_stats": "WITH " + corpus.clean_from("documents") + f"""
SELECT lang, count(*) AS sentences, CAST(sum(length(s)) AS BIGINT) AS chars, max(length(s)) AS longest
FROM (SELECT lang, unnest({cs.sentences_list('text')}) AS s FROM clean) GROUP BY lang""",
    "write_chunks": _CORPUS + """
SELECT CAST(doc_id % 16 AS INTEGER) AS bucket, count(*) AS chunks, count(DISTINCT doc_id) AS documents,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM c GROUP BY doc_id % 16""",
}
