"""Small worked examples of the operators that tables of the driver do not show well."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tramline.functions import scalars as S
from tramline.operators import crowding as C
from tramline.operators import events as E
from tramline.operators import network as N
from tramline.operators import panel as P
from tramline.operators import stock as K
from tramline.sources import io
from tramline.streaming import streams as R


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_flat_snapshot_has_null_ratio_without_racks(spark):
    raw = spark.createDataFrame([("ST-1", "10", "5"), ("ST-2", "0", "2")], "stationId string, rackTotCnt string, parkingBikeTotCnt string").withColumn("collected_at", F.lit("2026-09-01 01:05:00").cast("timestamp"))
    out = {r.station_id: r for r in K.normalize_stock(raw, {"stationId": "station_id", "rackTotCnt": "racks", "parkingBikeTotCnt": "stock"}).collect()}
    assert out["ST-1"].ratio == 0.5 and out["ST-2"].ratio is None and (out["ST-1"].hour, out["ST-1"].minute) == (1, 5)


def payload(station, stock):
    return json.dumps({k: v for k, v in zip(io.STOCK, (station, "n", "10", str(stock), "0", "37.5", "127.0"), strict=True)})


def test_mixed_schema_folder(spark, tmp_path):
    root = str(tmp_path / "mixed")
    flat = spark.createDataFrame([("ST-1", "10", "5", "2026-09-01")], "stationId string, rackTotCnt string, parkingBikeTotCnt string, collected_at string")
    env = spark.createDataFrame([("ST-2", payload("ST-2", 5)), ("ST-3", payload("ST-9", 7)), (None, payload("ST-4", 9))], "entity_id string, payload_json string").withColumn("ingested_at", F.lit("2026-09-01T01:06:00+09:00"))
    flat.write.parquet(root)
    env.write.mode("append").parquet(root)
    out = io.read_mixed_schema(spark, root)
    assert {r.station_id for r in out.collect()} == {"ST-1", "ST-2", "ST-4"} and len(out.columns) == 4


def envelope(**changes):
    e = dict.fromkeys(io.ENVELOPE, "x") | {"source_generated_at": "2026-09-14T09:00:03+09:00", "ingested_at": "2026-09-14T09:00:05+09:00", "poll_run_at": "2026-09-14T09:00:00+09:00", "entity_id": "ST-1", "payload": payload("ST-1", 5)}
    return json.dumps({k: v for k, v in (e | changes).items() if v is not None})


def test_envelopes_and_stock(spark):
    rows = [envelope(), "{no", envelope(payload=None), envelope(event_id=" "), envelope(ingested_at="soon"), envelope(entity_id="ST-7"), envelope(payload='{"stationId": "ST-1"}')]
    good, bad = io.parse_envelope(spark.createDataFrame([(r,) for r in rows], "value string"))
    assert sorted(r.reason for r in bad.collect()) == ["bad_time", "blank_id", "broken_json", "missing_key"]
    assert [(r.station_id, r.stock, r.source) for r in io.stock_payload(good).collect()] == [("ST-1", 5, "bike.stock")]
    parts = io.with_partitions(good).select("dt", "hh").distinct().collect()
    assert [(p.dt, p.hh) for p in parts] == [("2026-09-14", "00")]  # the session's zone is UTC


def test_weather_envelopes(spark):
    base = {"baseDate": "20260914", "baseTime": "900", "nx": 60, "ny": 127}
    rows = [base | {"category": "T1H", "obsrValue": "21.5"}, base | {"category": "RN1", "obsrValue": "강수없음"}, base | {"category": "REH", "fcstDate": "20260914", "fcstTime": "1000", "fcstValue": "60"}, base | {"category": "T1H"}, base | {"category": "X", "obsrValue": "1", "fcstValue": "2"}]
    env = spark.createDataFrame([(json.dumps(r),) for r in rows], "payload_json string").withColumns({"poll_run_at": F.lit("2026-09-14 00:05:00").cast("timestamp"), "ingested_at": F.current_timestamp()})
    out = io.weather_payload(env)
    assert sorted((r.source, r.category, r.value) for r in out.collect()) == [("forecast", "REH", 60.0), ("observed", "RN1", 0.0), ("observed", "T1H", 21.5)]
    wide = {r.source: r for r in io.weather_pivot(out, ["T1H", "RN1", "REH"]).collect()}
    assert (wide["observed"].T1H, wide["observed"].RN1, wide["observed"].REH) == (21.5, 0.0, None) and wide["forecast"].valid_time == dt.datetime(2026, 9, 14, 10)


def test_arrivals(spark):
    env = spark.createDataFrame([("222", json.dumps({"subwayId": "1002", "updnLine": "up", "btrainNo": "7", "barvlDt": "90", "arvlMsg2": "m", "arvlMsg3": "221", "recptnDt": "2026-09-14 09:00:00"}))], "entity_id string, payload_json string").withColumns({"poll_run_at": F.lit("2026-09-14 09:00:05").cast("timestamp"), "ingested_at": F.lit("2026-09-14 09:00:06").cast("timestamp")})
    r = R.eta(io.arrival_payload(env)).first()
    assert (r.station, r.train_no, r.seconds, r.eta) == ("222", "7", 90, dt.datetime(2026, 9, 14, 9, 1, 30))


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,\n1,2,\n")
    (tmp_path / "b.csv").write_text("x,y,z\n3,4,5\n")
    out = io.read_rental_csv(spark, {str(tmp_path / "a.csv"): ["rent", "ret"], str(tmp_path / "b.csv"): ["rent", "ret", "cnt"]})
    assert sorted((r.rent, r.ret, r.cnt) for r in out.collect()) == [("1", "2", None), ("3", "4", "5")]
    (tmp_path / "m.json").write_text('[{"a": 1}, {"a": 2}]')
    assert io.read_json_arrays(spark, str(tmp_path / "m.json")).count() == 2
    (tmp_path / "w.csv").write_text("date,temp,rain,snow\n2026-01-01,1.5,,\n")
    assert io.read_hourly_weather(spark, str(tmp_path / "w.csv"), "date date, temp double, rain double, snow double").first()[1:] == (1.5, 0.0, 0.0)
    (tmp_path / "s.csv").write_text("date,station,stock,more\n2026-01-01,A,1,q\n2026-02-01,A,2,q\n")
    got = io.read_hourly_stock(spark, str(tmp_path / "s.csv"), "date date, station string, stock int, more string", ["date", "stock"], F.lit("2026-01-01").cast("date"), F.lit("2026-01-31").cast("date"))
    assert [r.stock for r in got.collect()] == [1]
    links = spark.createDataFrame([("08:30", 1)], "time_slot_30min string, v int")
    io.write_link_export(links, str(tmp_path / "links"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "links")).first().slot == "17"
    assert json.loads(spark.read.text(str(tmp_path / "links-meta")).first()[0])["rows"] == 1


def test_lags_go_by_calendar(spark):
    rows = [(dt.date(2026, 9, n), 1, s, n * 10.0 + s) for n in (1, 2, 3, 8) for s in range(3)]
    p = spark.createDataFrame(rows, "date date, station_no int, slot int, v double")
    out = {(r.date.day, r.slot): r for r in P.day_lags(p, ["station_no", "slot"], ["v"]).collect()}
    assert len(out) == 12 and out[2, 1].v_lag1d == 11 and out[8, 0].v_lag7d == 10 and out[8, 0].v_lag1d is None
    assert {r.slot: r.v_prev for r in P.slot_lag(p, ["station_no", "date"], "slot", ["v"]).where("date = '2026-09-02'").collect()} == {0: None, 1: 20, 2: 21}


def test_one_way_line(spark):
    rows = list(zip(range(4), (100.0, 50.0, 0.0, 0.0), (0.0, 0.0, 60.0, 90.0), strict=True))
    out = C.linear_loads(spark.createDataFrame(rows, "seq int, boarding double, alighting double").withColumn("k", F.lit(1)), ["k"]).orderBy("seq").collect()
    assert [round(r.load_up, 9) for r in out] == [100, 150, 90, 0] and [r.load_down for r in out] == [0, 0, 0, 0]


def test_nobody_alights_and_ring(spark):
    df = spark.createDataFrame([(0, 5.0, 0.0), (1, 5.0, 0.0)], "seq int, boarding double, alighting double").withColumn("k", F.lit(1))
    assert all(r.load_up == r.load_down == 0 for r in C.linear_loads(df, ["k"]).collect())
    n, b, a = 5, [3.0, 1.0, 4.0, 1.0, 5.0], [2.0, 7.0, 1.0, 8.0, 2.0]
    up, down = [0.0] * n, [0.0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                t = b[i] / (sum(a) - a[i]) * a[j]
                if (j - i) % n <= (i - j) % n:
                    for s in range((j - i) % n):
                        up[(i + s) % n] += t
                else:
                    for s in range((i - j) % n):
                        down[(i - s) % n] += t
    ring = spark.createDataFrame(list(zip(range(n), b, a, strict=True)), "seq int, boarding double, alighting double").withColumn("k", F.lit(1))
    out = C.circular_loads(ring, ["k"]).orderBy("seq").collect()
    assert all(math.isclose(r.load_up, x) and math.isclose(r.load_down, y) for r, x, y in zip(out, up, down, strict=True))


def test_expected_wait(spark):
    out = {r.slot: r.wait for r in N.expected_wait(spark.createDataFrame([(1, 43_200)], "edge int, sec int"), ["edge"], "sec").collect()}
    # one departure at noon: the half hour before waits 900 s on average, the one after nearly a day
    assert len(out) == 48 and out[23] == 900 and out[24] == 85_500 and out[0] == 42_300
    none = N.expand_edge_slots(spark.createDataFrame([(2,)], "edge int"), spark.createDataFrame([], "edge int, dow_type int, slot int, wait int"), ["edge"])
    assert none.count() == 144 and none.select("wait").distinct().first()[0] == 86_400


def test_half_hour_shares(spark):
    rows = [(222, d, 8, s, r) for d, rs in (("up", (30.0, 10.0)), ("down", (20.0, 20.0))) for s, r in zip(("08:00", "08:30"), rs, strict=True)] + [(222, "up", 5, "05:30", 0.2)]
    out = {r.slot: r.share for r in P.half_hour_shares(spark.createDataFrame(rows, "station_no int, direction string, hour int, slot string, ratio double"), ["station_no", "direction"], "hour", "slot", "ratio").collect()}
    assert math.isclose(out["08:00"], 0.625) and math.isclose(out["08:30"], 0.375) and out["05:30"] == 1


def test_blend_needs_six(spark):
    t = "station_id string, dow_type int, time_slot int, exp_bikes double, p_empty double, p_full double"
    prior = spark.createDataFrame([("A", 0, 1, 10.0, 0.0, 0.0), ("A", 0, 2, 10.0, 0.0, 0.0)], t)
    recent = spark.createDataFrame([("A", 0, 1, 4.0, 0.5, 0.0, 6), ("A", 0, 2, 4.0, 0.5, 0.0, 5), ("B", 0, 1, 3.0, 0.0, 1.0, 1)], t + ", n long")
    out = {(r.station_id, r.time_slot): r.exp_bikes for r in K.blend_profile(prior, recent, ["station_id", "dow_type", "time_slot"]).collect()}
    assert math.isclose(out["A", 1], (10 * 48 + 4 * 6) / 54) and out["A", 2] == 10 and out["B", 1] == 3


def test_polygons(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    shift = [(x + 10, y) for x, y in square]
    areas = spark.createDataFrame([("a", square), ("b", shift)], "area string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 2.0, 2.0), (2, 12.0, 1.0), (3, 5.0, 2.0), (4, 9.0, 2.0)], "id int, x double, y double")
    assert {r.id: (r.area, r.method) for r in E.point_in_polygon(points, areas, "id", "area").collect()} == {1: ("a", "within"), 2: ("b", "within"), 3: ("a", "nearest"), 4: ("b", "nearest")}


def test_topology(spark):
    t = spark.createDataFrame([("l", [1, 2, 3], False), ("r", [7, 8, 9, 10], True)], "line string, stations array<int>, circular boolean")
    out = {(r.line, r.station_no, r.other) for r in P.segment_neighbors(t).collect()}
    assert {x for x in out if x[0] == "l"} == {("l", 1, 2), ("l", 2, 1), ("l", 2, 3), ("l", 3, 2)} and ("r", 7, 10) in out and ("r", 10, 7) in out


def test_guards_stop_the_job(spark):
    index = K.station_index(spark.createDataFrame([("a",), ("b",)], "s string"), "s")
    with pytest.raises(PySparkException):
        K.encode_station(spark.createDataFrame([("z",)], "s string"), index, "s").collect()
    snap = spark.createDataFrame([(1, 2.0), (1, 3.0)], "k int, share double")
    with pytest.raises(PySparkException):
        P.calibration_ratio(snap, snap.select("k", F.lit(1.0).alias("mean")), ["k"], "share").collect()
    with pytest.raises(ValueError):
        P.feature_matrix(snap, ["k", "gone"])
    dates = spark.createDataFrame([(dt.date(2026, 1, 1), 1.0)], "date date, v_lag1d double")
    with pytest.raises(PySparkException):
        P.mask_by_date(dates, dates.select("date", F.lit("odd").alias("scenario")), {"all": []}).collect()


def test_cooldown(spark):
    rows = [("r", 0, True), ("r", 300, True), ("r", 700, True), ("q", 10, False)]
    out = {(r.entity, r.ts): r.fired for r in R.cooldown_batch(spark.createDataFrame(rows, "id string, ts long, hot boolean"), "id", "ts", "hot").collect()}
    assert out == {("r", 0): True, ("r", 300): False, ("r", 700): True, ("q", 10): False}


def test_arrival_board(spark):
    rows = [("s", 1, "t1", 1), ("s", 2, "t1", 2), ("s", 2, "t2", 3), ("s", 2, "t2", 4)]
    df = spark.createDataFrame(rows, "station string, poll_run_at int, train_no string, received_at int")
    assert sorted((r.train_no, r.received_at) for r in R.arrival_board(df).collect()) == [("t1", 2), ("t2", 4)]


def test_scalars(spark):
    z = [-3.0, -1.0, 0.0, 0.5, 2.0]
    got = one(spark, v=F.array(*[S.normal_cdf(F.lit(x)) for x in z])).v
    assert all(abs(g - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1e-7 for g, x in zip(got, z, strict=True))
    empty, full = S.empty_full_risk(F.lit(1.0), F.lit(5.0), F.lit(9.0), F.lit(20.0))
    r = one(spark, e=empty, f=full, g=S.grade(F.lit(34.0), [34, 70]), n=S.grade(F.lit(None).cast("double"), [34]), p=S.platform_accumulation(F.lit(2.0), F.lit(4.0)))
    assert 0 < r.e < 0.5 and r.f < 1e-3 and r.g == 1 and r.n is None and r.p == 4.0
    t = F.lit("2026-09-14 09:00:00").cast("timestamp")
    a = one(spark, late=S.arrival_eta(F.lit(7200), t, t, F.lit("a"), F.lit("b")), here=S.arrival_eta(F.lit(0), t, t, F.lit("b"), F.lit("b")), none=S.arrival_eta(F.lit(0), t, t, F.lit("a"), F.lit("b")))
    assert a.late is None and a.here == dt.datetime(2026, 9, 14, 9) and a.none is None
    n = one(spark, a=S.station_name(F.lit("서울역(1호선)")), b=S.station_name(F.lit("역")), c=S.time_column_slot(F.lit("5시30분")))
    assert (n.a, n.b, n.c) == ("서울", "역", 11)


def test_history(spark):
    rows = [(1, dt.date(2026, 1, d), s, float(10 * d + s)) for d in (1, 2, 4) for s in (1, 2)]
    h = C.history_arrays(spark.createDataFrame(rows, "station_no int, date date, slot int, v double"), "station_no", "date", "slot", ["v"], 3, 2)
    r = h.where("date = '2026-01-04'").first()
    assert [[c.v if c else None for c in day] if day else None for day in r.history] == [[11, 12], [21, 22], None]
    m = C.sequence_mask(h, [2], 3).where("date = '2026-01-04'").first()
    assert [bool(x) for x in m.history] == [False, True, False]


def test_cooldown_of_runs(spark):
    """Runs of triggers of every density against a plain fold, with equal times, null times, triggers and entities."""
    rnd = random.Random(11)
    rows = [(e, rnd.randint(-5000, 20000) if rnd.random() > 0.02 else None, rnd.choice([True, True, False, None])) for e, n in (("a", 400), ("b", 30), (None, 60), ("c", 5)) for _ in range(n)]
    rows += [("d", 7, True), ("d", 7, True)]
    df = spark.createDataFrame(rows, "id string, ts long, hot boolean")
    for seconds in (600, 1, 0):
        want, last = [], {}
        for e, t, on in sorted(rows, key=lambda r: (r[0] or "", r[1] is None, r[1] or 0, bool(r[2]))):
            fire = bool(on) and t is not None and (e not in last or t - last[e] >= seconds)
            if fire:
                last[e] = t
            want.append((e, t, fire))
        got = [tuple(r) for r in R.cooldown_batch(df, "id", "ts", "hot", seconds).collect()]
        assert sorted(map(str, got)) == sorted(map(str, want))
    assert R.cooldown_batch(df.where("id = 'z'"), "id", "ts", "hot").collect() == []


def test_asof_over_buckets(spark):
    """The last right row lies in the same bucket, in one before, or nowhere; ties and null keys and times."""
    rnd = random.Random(5)
    at = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(hours=rnd.randint(0, 400))
    left = [(i, rnd.choice(["a", "a", "b", "c", None]), at()) for i in range(200)] + [(900, "a", None)]
    right = [(k, at(), i, float(i)) for i, k in enumerate(["a"] * 12 + ["b"] * 3 + [None] * 4)]
    l, r = spark.createDataFrame(left, "id int, k string, t timestamp"), spark.createDataFrame(right, "k string, t timestamp, n int, v double")
    for width in (3600, 86400, 10**9):
        got = {x.id: (x.anchor_v, x.minutes_since) for x in K.asof_backward(l, r, "k", "t", ["v"], "n", width).collect()}
        assert len(got) == len(left)
        for i, k, t in left:
            best = max(((b, n, v) for a, b, n, v in right if a == k and t is not None and b <= t), default=None)
            assert got[i] == ((best[2], (t - best[0]).total_seconds() / 60) if best else (None, None))
