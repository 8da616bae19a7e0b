"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows_of
from tidewatch import plans

FOLDER = "/root/testdata/sf0.001"
plans.load_all()
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


#: What a trained model gives back row by row; queries beside them hold it against SQL.
BY_MODEL = {"boosted_tree_scores", "model_metrics", "model_feature_importance", "blended_by_regression"}


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) == set(QUERIES) - BY_MODEL
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, sql, name):
    df = QUERIES[name](spark, FOLDER)
    got = df.collect()
    assert got or name not in BY_MODEL
    if name in BY_MODEL:
        return
    result = sql.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_entry_is_lazy_and_has_a_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["tx_id", "user_id"] and df.schema == entry.entry(spark).schema
