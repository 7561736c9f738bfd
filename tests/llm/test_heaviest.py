"""The heaviest words by histograms, and packing ranks by tasks."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from narralake.llm import common, packing


@pytest.mark.parametrize(("size", "top"), [(1, 9), (50, 40), (300, 10**9), (5000, 10**12), (0, 5)])
def test_heaviest_are_above_all_others(spark, monkeypatch, size, top):
    monkeypatch.setattr(common, "BINS", 16)
    r = random.Random(size)
    rows = [(f"w{i}", int(top ** r.random())) for i in range(1000)]
    counts = spark.createDataFrame(rows, "word string, n long")
    test = common.heaviest(counts, "word", "n", size)
    taken = {r.word for r in counts.where(test).collect()}
    assert counts.where(~test).count() == len(rows) - len(taken)
    n = dict(rows)
    least = min((n[w] for w in taken), default=top)
    assert all(n[w] <= least for w in n if w not in taken)
    # Only words equal in count and in the hash's last bits may be missing.
    ties = max(Counter(n.values()).values())
    assert min(size, len(rows)) - ties <= len(taken) <= size


def test_heaviest_of_no_words(spark):
    counts = spark.createDataFrame([], "word string, n long")
    assert counts.where(common.heaviest(counts, "word", "n", 10)).count() == 0


def test_one_length_in_many_tasks_is_packed_without_gaps(spark):
    common.ship(spark)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text")).repartition(7)
    rows = packing.pack(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(3000))
    places = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    ends = {}
    for sequence, offset, length in places:
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + length
    each = packing.CAPACITY // rows[0].length
    assert len(ends) == -(-3000 // each)
