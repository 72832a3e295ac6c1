"""Every query with a SQL counterpart agrees with DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from conftest import SF_SMALL
import __spark_entry__ as entry_module

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLE = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    return con


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    assert len(a) == len(b)
    a, b = (d[cols].sort_values(cols).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-6, atol=1e-6)


# category lists in the SQL are those of the larger tables; the small ones miss none of them
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    same(QUERIES[name](spark, SF_SMALL).toPandas(), duck.execute(ORACLE[name]).df())


def test_entry_runs(spark):
    out = entry_module.entry(spark)
    assert out.count() >= 1 and "Persona" in out.columns
