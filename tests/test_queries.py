"""Every registered query runs on the smallest tables and equals its SQL there."""

import datetime
import decimal
import os

import duckdb
import numpy as np
import pytest

from sportlake import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(x):
    if x is None or (isinstance(x, float) and x != x):
        return "NULL"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.6f}"
    if isinstance(x, int):
        return f"{float(x):.6f}"
    if isinstance(x, datetime.datetime):
        return x.strftime("%Y-%m-%d %H:%M:%S")
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted("|".join(plain(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_equals_sql(spark, db, small, name):
    df = plans.QUERIES[name](spark, small)
    rows = df.collect()
    if name in plans.SQL:
        result = db.execute(plans.SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows_of(df.columns, rows) == rows_of(columns, result.fetchall())
    else:
        assert df.columns


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(plans.SQL) <= set(plans.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
