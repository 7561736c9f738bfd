"""File listings, tables of one layout, and replacements held in a table."""

import os

import pytest
from pyspark.sql import functions as F

from narralake.operators import repair as rp
from narralake.operators import telemetry as tm
from narralake.operators.chunks import chunk_documents
from narralake.sources import listing
from narralake.sources.sinks import bucket_count, write_colocated


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def audio(tmp_path):
    for name, size in {
        "job-1/0001.wav": 10, "job-1/0002.WAV": 0, "job-1/0003.wav": 7, "job-1/0005.WAV": 4, "job-1/x.wav": 3, "job-1/0004.mp3": 3,
        "it's/0001.wav": 5, "it's/deep/00001.wav": 5,
    }.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(b"x" * size)
    return str(tmp_path)


def test_listing_reads_no_content(spark, audio):
    files = listing.file_listing(spark, audio)
    assert {(r.name, r.size) for r in files.collect()} == {
        ("0001.wav", 10), ("0003.wav", 7), ("0005.WAV", 4), ("x.wav", 3), ("0001.wav", 5), ("00001.wav", 5),
    }
    plan = plan_of(files.where("size > 4 AND modified > timestamp'2001-01-01'"))
    scan = plan[plan.index("FileScan") :]
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in scan
    assert "GreaterThan(length,4)" in scan


def test_listing_feeds_the_file_views(spark, audio):
    chunks = listing.chunk_listing(spark, audio)
    assert {(r.intake_id, r.chunk_idx, r.size) for r in chunks.collect()} == {
        ("job-1", 1, 10), ("job-1", 3, 7), ("job-1", 5, 4), ("it's", 1, 5),
    }
    lines = [r.line for r in tm.concat_manifest(chunks).where("intake_id = \"it's\"").collect()]
    assert len(lines) == 1 and lines[0].endswith("it'\\''s/0001.wav'")
    totals = spark.createDataFrame([("job-1", 3), ("it's", 1), ("none", 2)], "intake_id string, total long")
    points = {r.intake_id: r.start_index for r in tm.resume_points(totals, chunks).collect()}
    assert points == {"job-1": 2, "it's": 2, "none": 1}


def test_tables_of_one_layout_join_without_exchange(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"One {i}. Two.\n\nThree.") for i in range(60)], "doc_id bigint, text string")
    chunks = chunk_documents(docs)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        count = write_colocated(chunks, "layout_chunks", "doc_id", "chunk_idx", path=f"{tmp_path}/chunks")
        assert count == bucket_count(chunks) and count & (count - 1) == 0
        notes = chunks.select("doc_id", "chunk_idx", F.length("text").alias("n"))
        write_colocated(notes, "layout_notes", "doc_id", "chunk_idx", buckets=count, path=f"{tmp_path}/notes")
        joined = spark.table("layout_chunks").join(spark.table("layout_notes"), ["doc_id", "chunk_idx"])
        per_doc = joined.groupBy("doc_id").agg(F.sum("n").alias("n"))
        assert "Exchange" not in plan_of(per_doc)
        assert sum(r.n for r in per_doc.collect()) == notes.agg(F.sum("n")).first()[0]
        assert len([f for f in os.listdir(f"{tmp_path}/chunks") if f.endswith(".parquet")]) <= count
    finally:
        for name in settings:
            spark.conf.unset(name)
        spark.sql("DROP TABLE IF EXISTS layout_chunks")
        spark.sql("DROP TABLE IF EXISTS layout_notes")


GLYPHS = "lang string, position int, bad string, good string"


def test_glyph_table_equals_the_literal_map(spark):
    texts = ["روح 0 خمينی اس)می اس)می", "انق)بی انق)ب", "", None, "plain"]
    pages = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = [("x", i, k, v) for i, (k, v) in enumerate(rp.GLYPH_REPLACEMENTS.items())]
    got = rp.repair_glyphs(pages, spark.createDataFrame(rows, GLYPHS).repartition(3))
    want = pages.withColumn("repair", rp.glyph_repair(F.col("text")))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Exchange" not in plan_of(got).split("Subquery")[0]


def test_glyph_map_per_language(spark):
    pages = spark.createDataFrame([("a", "xy abc"), ("b", "xy abc"), (None, "xy"), ("c", "xy")], "lang string, text string")
    rows = [("a", 0, "x", "1"), ("a", 1, "xy", "2"), ("b", 0, "b", "?"), ("b", 5, "b", "!"), (None, 0, "y", "3"), ("c", 0, "", "z")]
    glyphs = spark.createDataFrame(rows, GLYPHS)
    got = {r.lang: r.repair.text for r in rp.repair_glyphs(pages, glyphs, "lang").collect()}
    assert got == {"a": "2 abc", "b": "xy a!c", None: "x3", "c": "xy"}
    assert {r.repair.text for r in rp.repair_glyphs(pages, glyphs.limit(0), "lang").collect()} == {"xy abc", "xy"}
    with pytest.raises(Exception, match="more than 2 glyph"):
        rp.repair_glyphs(pages, glyphs, "lang", limit=2).collect()
