"""Stages of the pipeline keep columns of the input that are named like their own."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_columns_of_helper_names(spark):
    words = " ".join(f"w{i}" for i in range(80))
    own = [" ".join(f"o{d}x{i}" for i in range(40)) for d in range(3)]
    rows = [(0, f"{own[0]} {words}"), (1, f"{words} {own[1]}"), (2, own[2]), (3, own[2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s")})
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    extra = {c: F.concat(F.lit(c), F.col("doc_id")) for c in ("_row", "_spans", "_slot", "_BIT", "_word", "_time")}
    docs = docs.withColumns(extra)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    cut = corpus_pipeline.cut_passages(spark, docs, "")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    assert kept.count() == 3
    assert cut.where(F.col("text").isin(own)).count() >= 1
    for out in (kept, cut, mixed):
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in extra)
