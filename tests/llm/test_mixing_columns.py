"""Operator 4: columns of the input that have the name of something the mix works with."""

from narralake.llm import mixing
from narralake.llm.common import ship


def test_clashing_columns_stay(spark):
    ship(spark)
    rows = [(i, "one two three four", f"s{i % 3}", "kept", "rest") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epochs string, rest string")
    out = mixing.mix(docs)
    assert {*docs.columns} <= {*out.columns}
    assert {(r.epochs, r.rest) for r in out.collect()} == {("kept", "rest")}
    assert mixing.mix(docs.drop("epochs")).count() == 30
