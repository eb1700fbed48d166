"""Every engine query against its SQL in DuckDB, at the smallest scale."""

import os

import duckdb
import pytest

from gridloom import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the standard tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got, want = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in cols:
        assert str(got[c].dtype) == str(want[c].dtype), c
        assert (got[c].to_numpy() == want[c].to_numpy()).all(), c


def test_every_query_has_sql_but_the_sequential_one():
    assert set(queries.QUERIES) - set(queries.ORACLE_SQL) == {"pagerank_sweeps"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_tensor_queries_see_all_rows_and_fill_zeros(spark, duck):
    (lines,) = duck.execute("select count(*) from (select distinct l_partkey % 50, l_suppkey, l_linenumber from lineitem)").fetchone()
    (quantity,) = duck.execute("select sum(l_quantity) from lineitem").fetchone()
    (cells,) = duck.execute("select 50 * count(*) * 8 from supplier").fetchone()
    assert queries.QUERIES["nonzero_positions"](spark, SF).count() == lines
    first = queries.QUERIES["dense_full"](spark, SF).where("depth = 0")
    n, total, zeros = first.selectExpr("count(*)", "sum(val)", "count_if(val = 0)").first()
    assert (n, total, zeros) == (cells, quantity, cells - lines) and zeros > 0
