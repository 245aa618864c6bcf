"""Queries without SQL against plain Python: no row of the tables is left out."""

import datetime as dt
import os
from collections import defaultdict

import pytest

from tramline.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def days(spark):
    """{(station, date): {slot: boarding}} of lineitem."""
    out = defaultdict(lambda: defaultdict(float))
    for r in spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_suppkey", "l_shipdate", "l_linenumber", "l_quantity").collect():
        date = r.l_shipdate.date() if isinstance(r.l_shipdate, dt.datetime) else r.l_shipdate
        out[r.l_suppkey, date][r.l_linenumber] += float(r.l_quantity)
    return out


@pytest.mark.parametrize(("name", "lags"), [("win24_history_arrays", (3, 2, 1)), ("win25_sequence_mask", (1,))])
def test_history_of_every_station(spark, days, name, lags):
    assert len({s for s, _ in days}) > 20
    got = QUERIES[name](spark, FOLDER).collect()
    assert sorted((r.station_no, r.date) for r in got) == sorted(days)
    for r in got:
        past = [days.get((r.station_no, r.date - dt.timedelta(days=n))) for n in (3, 2, 1)]
        want = [[p.get(s) for s in range(1, 8)] if p and n in lags else [None] * 7 for n, p in zip((3, 2, 1), past, strict=True)]
        assert [[None if c == "-" else float(c) for c in row.split(" ")] for row in r.history.split("|")] == want
        if name == "win24_history_arrays":
            assert [[c == "1" for c in row] for row in r.mask.split("|")] == [[bool(p) and s in p for s in range(1, 8)] for p in past]
