"""Every registered query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessera.registry import ORACLE_SQL, QUERIES, load

load()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    return str(x)


def ordered(rows, columns):
    return sorted(tuple(plain(r[c]) for c in columns) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name in ORACLE_SQL:
        found = duck.execute(ORACLE_SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == sorted(df.columns)
        want = [dict(zip(names, r)) for r in found.fetchall()]
        assert ordered(rows, sorted(df.columns)) == ordered(want, sorted(df.columns))
    else:
        assert rows
