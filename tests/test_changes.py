"""Changed and deleted documents: the difference, and chunks that follow it."""

import random

from pyspark.sql import functions as F

from narralake.operators.changes import content_manifest, differences
from narralake.operators.chunks import chunk_documents
from narralake.operators.records import apply_edits, delete_records
from narralake.streaming.corpus import ChunkedCorpus

DOCS = "doc_id bigint, text string"


def _rows(df):
    return sorted(map(repr, df.select("doc_id", "chunk_idx", "text", "char_count").collect()))


def test_manifest_does_not_depend_on_order_and_tells_rows_apart(spark):
    rows = [(1, "a"), (1, "b"), (2, None), (3, ""), (4, "a"), (4, "a"), (None, "x")]
    one = content_manifest(spark.createDataFrame(rows, DOCS).repartition(3), "doc_id", "text")
    two = content_manifest(spark.createDataFrame(rows[::-1], DOCS), "doc_id", "text")
    assert differences(one, two, "doc_id").count() == 0
    digests = {r.doc_id: r.digest for r in one.collect()}
    assert len(set(digests.values())) == len(digests) == 5


def test_differences(spark):
    manifest = lambda rows: content_manifest(spark.createDataFrame(rows, DOCS), "doc_id", "text")
    before = manifest([(1, "a"), (2, "b"), (3, None), (None, "n"), (5, "e"), (6, "f")])
    after = manifest([(1, "a"), (2, "B"), (3, ""), (None, "m"), (4, "d"), (6, "f"), (6, "f")])
    got = {(r.doc_id, r.change) for r in differences(before, after, "doc_id").collect()}
    assert got == {(2, "changed"), (3, "changed"), (None, "changed"), (4, "added"), (5, "gone"), (6, "changed")}


def test_refreshes_equal_a_full_run_and_touch_only_what_differs(spark, tmp_path):
    corpus, r = ChunkedCorpus(str(tmp_path), every=3), random.Random(7)
    sentence = lambda: " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.randrange(3, 40))) + ". "
    texts = {i: "".join(sentence() for _ in range(r.randrange(30))) for i in (*range(12), None)}
    version = -1
    for step in range(7):
        docs = spark.createDataFrame([(i, t) for i, t in texts.items()], DOCS).coalesce(2)
        due = {row.doc_id: row.change for row in corpus.changes(docs).collect()}
        if step == 0:
            assert set(due) == set(texts)
        else:
            assert due == expected
        got = corpus.refresh(docs)
        version += bool(due)
        assert got == version and corpus.refresh(docs) == version
        assert _rows(corpus.read(spark)) == _rows(chunk_documents(docs))
        expected = {}
        if step == 3:
            continue
        for i in r.sample(sorted(texts, key=str), 3):
            kind = r.choice(["changed", "gone", "empty"])
            if kind == "gone":
                del texts[i]
                expected[i] = "gone"
            else:
                new = "" if kind == "empty" else texts[i] + sentence()
                if new != texts[i]:
                    expected[i] = "changed"
                texts[i] = new
        texts[100 + step] = sentence()
        expected[100 + step] = "added"


def test_edited_and_deleted_records_are_chunked_again(spark, tmp_path):
    """Edits and deletions of intake records are what a refresh follows."""
    pages = F.expr("array(named_struct('page_number', 1, 'text', full_text))")
    records = (
        spark.createDataFrame([(1, "One. Two."), (2, "Three."), (3, "Four.")], "intake_id bigint, full_text string")
        .withColumns({"page_count": F.lit(1), "pages": pages, "preview_text": F.col("full_text")})
    )
    docs = lambda df: df.select(F.col("intake_id").alias("doc_id"), F.col("full_text").alias("text"))
    corpus = ChunkedCorpus(str(tmp_path))
    corpus.refresh(docs(records))
    edits = spark.createDataFrame([(2, "New text.")], "intake_id bigint, new_text string")
    after = delete_records(apply_edits(records, edits), spark.createDataFrame([(3,), (9,)], "intake_id bigint"))
    assert {(r.doc_id, r.change) for r in corpus.changes(docs(after)).collect()} == {(2, "changed"), (3, "gone")}
    corpus.refresh(docs(after))
    assert {(r.doc_id, r.text) for r in corpus.read(spark).collect()} == {(1, "One. Two."), (2, "New text.")}
