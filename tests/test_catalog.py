"""Every registered query with SQL gives the same rows as DuckDB on the small tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return str(v) if isinstance(v, list) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if not k.startswith("op")))
def test_against_sql(spark, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in got.description]
    want = [tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in got.fetchall()]
    assert sorted(names) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str) == sorted(want, key=str)
