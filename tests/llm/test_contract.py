"""Which queries of this subpackage have SQL, and which are tested otherwise."""

import __spark_entry__ as contract
from narralake.llm.registry import ORACLES, QUERIES

#: Models, tokenizers, sampled joins and sliding entropy: tests hold them
#: against brute force, round trips, a library or held-out accuracy.
WITHOUT_SQL = {
    "op2_language_id",
    "op3_token_counts",
    "op6_repeated_passages",
    "op7_best_fit_packing",
    "op8_nearest_neighbours",
    "op9_lm_score",
    "op10_jaccard_join",
    "op11_align_tokenizers",
    "op12_secret_scan",
}


def test_queries_without_sql_are_named():
    assert QUERIES.keys() - ORACLES.keys() == WITHOUT_SQL
    assert contract.queries().keys() - contract.oracle_sql().keys() == {*WITHOUT_SQL, "pipeline"}
