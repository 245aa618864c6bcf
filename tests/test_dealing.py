"""Panels are dealt to tasks by the rows of their table, and lags by frames are those by joins."""

import datetime
import random

import pytest

from tramline.operators import panel as P
from tramline.queries import base as B


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    """A station's rows stay in one task of as many as the table asks for; grouping by station and more adds no shuffle."""
    monkeypatch.setattr(B, "ROWS", 10)
    folder = str(tmp_path)
    at = datetime.datetime(2024, 1, 1)
    rows = [(s, at + datetime.timedelta(days=k), 1 + k % 3, 1.0, 2.0) for s in range(40) for k in range(5)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp_ntz, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{folder}/lineitem.parquet")
    assert B.parts(spark, folder) == 20
    lags = P.day_lags(B.v_panel(spark, folder), ["station_no", "slot"], ["boarding"])
    wide = P.pivot_direction(B.v_long(spark, folder), ["station_no", "date", "slot"])
    service = P.reshape_service_day(B.v_panel(spark, folder), ["station_no", "date"], "slot", "boarding")
    for out in (lags, wide, service):
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert out.rdd.getNumPartitions() == 20
    assert wide.count() == lags.count() == 200 and {(r.boarding, r.alighting) for r in wide.collect()} == {(1.0, 0.002)}


def test_lags_by_frames(spark):
    rnd = random.Random(2)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    rows = {(s, k): rnd.choice([None, rnd.random()]) for s in range(4) for k in range(40) if rnd.random() < 0.7}
    df = spark.createDataFrame([(s, day(k), v, 7) for (s, k), v in rows.items()], "s int, date date, v double, more int")
    out = P.day_lags(df, ["s"], ["v"], (1, 7))
    assert out.columns == ["s", "date", "v", "v_lag1d", "v_lag7d"]
    want = {(s, day(k)): (v, rows.get((s, k - 1)), rows.get((s, k - 7))) for (s, k), v in rows.items()}
    assert {(r.s, r.date): (r.v, r.v_lag1d, r.v_lag7d) for r in out.collect()} == want


def test_weather_is_parsed_once(spark):
    """One parse and one pass over the payloads; what is broken, without place or of another category leaves no value."""
    from tramline.sources import io

    body = '{"baseDate": "20240101", "baseTime": "600", "nx": "%s", "ny": 1, "category": "%s", "obsrValue": %s}'
    rows = [(body % (1, "A", '"3"'), 10), (body % (1, "A", '"4"'), 20), (body % (1, "A", "null"), 30), (body % (1, "C", '"7"'), 40), (body % ("x", "A", '"5"'), 50), (body % (2, "C", "2.5"), 60), ("{broken", 70), (None, 80)]
    env = spark.createDataFrame(rows, "payload_json string, at long").selectExpr("payload_json", "timestamp_seconds(at) AS poll_run_at", "current_timestamp() AS ingested_at")
    wide = io.weather_pivot(io.weather_payload(env), ["A", "B"])
    assert sorted((r.nx, r.A, r.B, r.collected_at.timestamp()) for r in wide.collect()) == [(1, 4.0, None, 40), (2, None, None, 60)]
    plan = wide._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("json_tuple") == 1 and "get_json_object" not in plan and "join" not in plan


def test_residuals_are_dealt_by_table_rows(spark, monkeypatch):
    """The trainer keeps its rows in as many partitions as the table's rows say, not in the few that small shuffles are put together to."""
    from pyspark.ml.regression import GBTRegressor

    from tramline.queries import QUERIES, base

    seen = []

    def fit(self, rows):
        seen.append([len(p) for p in rows.rdd.glom().collect()])
        raise InterruptedError

    monkeypatch.setattr(base, "ROWS", 600)
    monkeypatch.setattr(GBTRegressor, "fit", fit)
    folder = "/root/testdata/sf0.001"
    with pytest.raises(InterruptedError):
        QUERIES["ml03_residual_model"](spark, folder)
    assert len(seen[0]) == base.parts(spark, folder) >= 10 and max(seen[0]) < sum(seen[0]) / 4
