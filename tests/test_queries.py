"""Every registered query against its SQL, run by DuckDB on the same small tables."""

import os

import duckdb
import pandas as pd
import pytest

from gleanery.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return con


def plain(df):
    def text(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, row)) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        expected = duck.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(expected.columns)
        assert plain(got) == plain(expected)


def test_entry_module_without_the_llm_subpackage(monkeypatch):
    import sys

    import __spark_entry__

    for name in [m for m in sys.modules if m.startswith("gleanery.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "gleanery.llm", None)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(ORACLE_SQL)


def test_no_product_without_a_broadcast_side(spark):
    for name in ("lexical_rank", "score_units", "retrieval_metrics"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan


def against_sql(spark, folder, changed, *names):
    """The queries against their SQL on the small tables, of which ``changed`` (name: SQL) are made anew in ``folder``."""
    con = duckdb.connect()
    for file in os.listdir(DATA):
        name = file.split(".")[0]
        con.execute(f"CREATE VIEW given_{name} AS SELECT * FROM read_parquet('{DATA}/{file}')")
        con.execute(f"COPY ({changed.get(name, f'SELECT * FROM given_{name}')}) TO '{folder}/{file}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{file}')")
    for name in names:
        got, expected = QUERIES[name](spark, str(folder)).toPandas(), con.execute(ORACLE_SQL[name]).df()
        assert len(expected) and plain(got) == plain(expected[list(got.columns)])


ONE_WORD = "SELECT item_id, 'a single something' AS text FROM given_benchmark LIMIT 3"


def test_keywords_of_tasks_with_a_single_word(spark, tmp_path):
    against_sql(spark, tmp_path, {"benchmark": ONE_WORD}, "task_keywords")


def test_terms_of_tasks_with_a_single_word(spark, tmp_path):
    against_sql(spark, tmp_path, {"benchmark": ONE_WORD}, "task_terms")


def test_context_efficiency_has_no_row_for_a_strategy_without_a_selection(spark, tmp_path):
    long = "SELECT * REPLACE (CASE WHEN doc_id = 11 THEN repeat('lorem ', 900) WHEN doc_id = 50 THEN 'so: a single something' ELSE text END AS text) FROM given_documents"
    against_sql(spark, tmp_path, {"benchmark": ONE_WORD.replace("LIMIT 3", "WHERE item_id < 2"), "documents": long}, "context_efficiency")
