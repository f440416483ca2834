import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from stepweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(rows):
    return sorted((tuple(round(x, 8) + 0.0 if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    want = con.execute(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert got == plain(want) and got


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())
