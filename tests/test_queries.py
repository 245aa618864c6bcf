"""Every transit query against its SQL in DuckDB on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from tramline.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def plain(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        return (2, f"{float(v):.5g}" if abs(float(v)) > 1e-9 else "0")
    if isinstance(v, (list, tuple)):
        return (3, str([plain(x) for x in v]))
    return (4, str(v))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    # what has no SQL is only checked for rows, on tables that are large enough to have some
    df = QUERIES[name](spark, FOLDER if name in ORACLE_SQL else FOLDER.replace("0.001", "0.01"))
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert rows or name in ORACLE_SQL
    if name in ORACLE_SQL:
        out = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in out.description]
        assert sorted(names) == columns
        at = [names.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[i]) for i in at) for r in out.fetchall())
