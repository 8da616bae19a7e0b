"""Every query of the subpackage, next to its SQL where it has one, on the smallest tables."""

import duckdb
import pytest

from check_oracle import TABLES, rows_of
from tidewatch.llm import registry

FOLDER = "/root/testdata/sf0.001"
registry.load_all()


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n != "pipeline"])
def test_query_runs_and_agrees_with_its_sql(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    got = df.collect()
    assert got
    if name in registry.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
        result = con.execute(registry.ORACLES[name])
        columns = [d[0] for d in result.description]
        assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_each_operator_has_one_query():
    numbers = [n[2:].split("_")[0] for n in registry.QUERIES if n.startswith("op")]
    assert sorted(map(int, numbers)) == list(range(1, 14))
