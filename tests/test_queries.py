"""Every named query against DuckDB on the driver's tables."""

import pytest
from compare import connect, differences

from __spark_entry__ import entry, oracle_sql, queries
from catalog.duckdb_sql import SQL
from catalog.spark_queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, name):
    assert differences(queries()[name](spark, FOLDER), duck, oracle_sql()[name]) == []


def test_entry_finds_three_per_query(spark):
    rows = entry(spark).collect()
    assert len(rows) == 200
    assert all(row.n_chars > 0 for row in rows)


@pytest.mark.parametrize("name", ["paired_t", "wilcoxon_signed_rank", "compare_runs"])
def test_all_three_measures_are_compared(spark, name):
    rows = {r.measure: r.n for r in queries()[name](spark, FOLDER).collect()}
    assert set(rows) == {"correct", "severity_error", "pred_confidence"}
    assert all(rows.values())


@pytest.mark.parametrize(
    "name", ["rag_context", "rag_context_few_queries", "rag_context_by_blocks", "rag_prompt_md5", "rag_run", "rag_run_from_text"]
)
def test_retrieval_answers_every_document(spark, name):
    assert queries()[name](spark, FOLDER).count() == 200
