"""Every document query against its SQL on random texts."""

import duckdb
import pytest
from compare import compare
from random_documents import write_documents

from narralake.plans import chunks, corpus, narrations, quality, registry

DOCUMENT_QUERIES = {**corpus.QUERIES, **quality.QUERIES}
CHUNK_QUERIES = {**chunks.QUERIES, **narrations.QUERIES}
OTHER_TABLES = {"upload_filter", "delete_intake"}


@pytest.fixture(scope="module", params=[1, 2])
def wild(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp(f"wild{request.param}")
    return write_documents(str(folder), request.param, 250, True)


@pytest.fixture(scope="module", params=[3, 4])
def tame(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp(f"tame{request.param}")
    return write_documents(str(folder), request.param, 150, False)


def _check(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    fn, sql = registry.queries()[name], registry.oracle_sql()[name]
    ok, note = compare(spark, con, folder, name, fn, sql)
    assert ok, note


@pytest.mark.parametrize("name", sorted(set(DOCUMENT_QUERIES) - OTHER_TABLES))
def test_wild_texts(spark, wild, name):
    _check(spark, wild, name)


@pytest.mark.parametrize("name", sorted(CHUNK_QUERIES))
def test_tame_texts(spark, tame, name):
    _check(spark, tame, name)
