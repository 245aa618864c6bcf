"""Places instead of rows, counts by sets of places, ties and last bits: what a larger table showed."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import events as E
from tramline.operators import quality as Q
from tramline.plans import jobs as J
from tests.test_spatial import km

POINT, STATION = "p int, lat double, lon double", "s int, lat double, lon double, p_empty double"


def town(seed):
    """Points and stations on few places, many on each, copies of a place under ids far apart."""
    rnd = random.Random(seed)
    spots = [(37.4 + rnd.randrange(12) * 0.003, 126.8 + rnd.randrange(12) * 0.004) for _ in range(30)]
    points = [(k, *rnd.choice(spots)) for k in range(80)] + [(90, 10.0, 10.0), (91, None, 126.8)]
    stations = [(k, *rnd.choice(spots), rnd.choice([None, 0.0, 0.3, 0.9])) for k in rnd.sample(range(1000), 120)]
    return points, stations


def test_searches_by_places(spark):
    """The nearest three and the best by score of each point as all pairs have them; places meet, not rows."""
    points, stations = town(1)
    p, s = spark.createDataFrame(points, POINT), spark.createDataFrame(stations, STATION)
    free = E.nearby(p, s.withColumn("is_empty", F.col("s") % 5 == 0), "p", "s", 1.0, 3, F.col("is_empty")).collect()
    best = {r.p: (r.s, r.score) for r in E.best_nearby(p, s, "p", "s", 1.0, 15, "p_empty").collect()}
    for i, la, lo in points:
        near = sorted((round(km((la, lo), x[1:3]), 9), x[0], x[3]) for x in stations if la is not None and km((la, lo), x[1:3]) <= 1.0)
        want = [x[:2] for x in near if x[1] % 5][:3]
        got = sorted((r["rank"], r.km, r.s) for r in free if r.p == i)
        assert [g[0] for g in got] == list(range(1, len(want) + 1))
        assert [g[1] for g in got] == pytest.approx([w[0] for w in want], abs=1e-5)
        scores = sorted((15 * d + 10 * e, d, x) for d, x, e in near if e is not None)
        assert (i in best) == bool(scores)
        if scores:
            assert best[i][1] == pytest.approx(scores[0][0], abs=1e-4)


def test_equal_distances_go_to_the_lowest_id(spark):
    """Stations a step north and a step south of a point are equally far but for the last bit, in either order of ids."""
    points = [(k, 37.4 + k * 0.003, 126.8 + k * 0.004) for k in range(40)]
    far = [(1000 - 2 * k, la + 0.05, lo) for k, la, lo in points] + [(1001 + 2 * k, la - 0.05, lo) for k, la, lo in points]
    near = [(k if up == (k % 2 == 0) else 500 + k, la + (0.003 if up else -0.003), lo + 20) for k, la, lo in points for up in (True, False)]
    for stations, offset in ((far, 0.0), (near, 20.0)):
        p = spark.createDataFrame([(k, la, lo + offset) for k, la, lo in points], POINT)
        out = {r.p: r.s for r in E.nearest_one(p, spark.createDataFrame(stations, "s int, lat double, lon double"), "p", "s").collect()}
        for k, la, lo in points:
            d = {x: round(km((la, lo + offset), (a, o)), 8) for x, a, o in stations}
            assert out[k] == min(x for x in d if d[x] <= min(d.values()) + 2e-8)


def test_last_bits_are_no_change(spark):
    """Sums of the same numbers in another order are the same, a difference is none, nulls and NaN are equal to themselves."""
    a = [(1, 0.1 + 0.2 + 0.3, 1), (2, 5.0, 1), (3, None, 1), (4, float("nan"), 1), (5, float("inf"), 1), (6, 1.0, 1), (7, 1.0, 1), (8, 2.0, 1)]
    b = [(1, 0.3 + 0.2 + 0.1, 1), (2, 5.0001, 1), (3, None, 1), (4, float("nan"), 1), (5, 1.0, 1), (6, None, 1), (7, 1.0, 2), (9, 2.0, 1)]
    assert a[0][1] != b[0][1]
    x, y = (spark.createDataFrame(t, "k int, v double, n int") for t in (a, b))
    assert {r.status: r.n for r in Q.table_diff(x, y, ["k"], ["v", "n"]).collect()} == {"same": 3, "changed": 4, "left": 1, "right": 1}


def test_grades_of_thresholds(spark):
    """A load that is a threshold but for its last bits has the threshold's grade."""
    low = 3.0 - 4e-16 * 2
    pred = spark.createDataFrame([("l", 1, 1, datetime.date(2024, 1, 1), 6, low, 0.0, 0.0), ("l", 2, 2, datetime.date(2024, 1, 1), 6, 0.0, 7.0, 0.0)], "line string, seq int, station_no int, date date, hour int, boarding double, alighting double, lookup double")
    cal = spark.createDataFrame([(1, "up", "06:00", 1.0, 0.0)], "station_no int, direction string, slot30 string, ratio double, offset double")
    targets = spark.createDataFrame([(1, "up", 2)], "station_no int, direction string, to_station int")
    row = J.crowding(pred, cal, targets, [3])[0].where("slot30 = '06:00'").first()
    assert row.calibrated == pytest.approx(3.0) and row.calibrated < 3.0 and row.grade == 1


def test_events_by_sets_of_places(spark):
    """Counts of each station and day as all pairs of events and stations give them, an event seen once at several places near."""
    rnd = random.Random(3)
    day = lambda k: datetime.date(2024, 1, 1 + k)
    venues = [(v, 37.5 + v * 0.02, 127.0) for v in range(4)]
    stations = [(k, 37.45 + rnd.random() * 0.2, 127.0) for k in range(60)]
    games = [(k, day(rnd.randrange(9)), rnd.randrange(4), rnd.choice([None, 10.0, 20.0])) for k in range(40)]
    fests = [(k % 25, day(b), day(b + rnd.randrange(5)), rnd.randrange(4)) for k in range(40) for b in [rnd.randrange(9)]]
    out = J.event_panel(
        spark.createDataFrame(games, "id int, date date, place int, attendance double"), spark.createDataFrame(fests, "id int, begin_date date, end_date date, place int"),
        spark.createDataFrame(stations, "station_no int, lat double, lon double"), spark.createDataFrame(venues, "place int, lat double, lon double"), F.lit(day(0)), F.lit(day(12)), 3.0,
    )
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_places" in plan
    want = {}
    for s, la, lo in stations:
        near = {v for v, a, o in venues if km((la, lo), (a, o)) <= 3.0}
        for k in range(13):
            g = [x for x in games if x[1] == day(k) and x[2] in near]
            f = [x for x in fests if x[1] <= day(k) <= x[2] and x[3] in near]
            if g or f:
                seen = [x[3] for x in g]
                want[s, day(k)] = (len(g), sum(seen) if g and None not in seen else None, len({x[0] for x in f}), len({x[0] for x in f if (x[2] - x[1]).days < 3}))
    assert {(r.station_no, r.date): (r.n_games, r.attendance, r.n_festivals, r.n_short) for r in out.collect()} == want
    assert len({frozenset(v for v, a, o in venues if km(s[1:], (a, o)) <= 3.0) for s in stations}) > 3


def test_points_of_a_place_look_once(spark, monkeypatch):
    """Many points on few places, some on none: one search a place, all points answered, as a search of each finds it."""
    rnd = random.Random(5)
    spots = [(rnd.uniform(-1, 4), rnd.uniform(-1, 4)) for _ in range(12)]
    points = [(k, *spots[k % 12]) for k in range(120)] + [(200, None, 1.0)]
    box = lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)]
    areas = [(k, box(k % 4, k // 4, 0.2 + 0.15 * k)) for k in range(9)]
    p = spark.createDataFrame(points, "p int, x double, y double")
    a = spark.createDataFrame(areas, "area int, ring array<struct<x:double,y:double>>")
    seen, search = [], E._nearest_boundary
    monkeypatch.setattr(E, "_nearest_boundary", lambda pts, *rest: (seen.append(pts.count()), search(pts, *rest))[1])
    near = {r.p: (r.area, r.distance) for r in E.nearest_boundary(p, a, "p", "area").collect()}
    inside = {r.p: (r.area, r.method) for r in E.point_in_polygon(p, a, "p", "area").collect()}
    assert seen[0] == 13 and seen[1] <= 13 and len(near) == len(inside) == 121 and near[200] == (None, None)

    def away(x, y, ring):
        out = []
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            t = max(0.0, min(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            out.append(((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (by - ay)) ** 2) ** 0.5)
        return min(out)

    for k, x, y in points[:-1]:
        best = min(away(x, y, r) for _, r in areas)
        assert near[k][1] == pytest.approx(best)
        held = [i for i, r in areas if r[0][0] <= x < r[2][0] and r[0][1] <= y < r[2][1]]
        assert inside[k] == ((min(held), "within") if held else (near[k][0], "nearest"))


def test_radius_join_deals_a_dense_cell(spark, monkeypatch):
    """All pairs, equal rows as often as they stand, where one cell has most rows; its points are dealt to many tasks, and a walk has
    the same edges."""
    monkeypatch.setattr(E, "PAIRS", 500)
    monkeypatch.setattr(E, "HELD", 7)
    points, stations = town(4)
    points = [(k % 60, 37.4, 126.8) for k in range(100)] + points
    stations = [(k, 37.401, 126.8, 0.0) for k in range(20)] + stations
    p, s = spark.createDataFrame(points, POINT), spark.createDataFrame(stations, STATION)
    want = sorted((a, b, km((la, lo), (x, y))) for a, la, lo in points if la is not None for b, x, y, _ in stations if km((la, lo), (x, y)) <= 0.5)
    got = E.radius_join(p, s, 0.5).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.p, r.s) for r in got) == [w[:2] for w in want]
    assert [k for *_, k in sorted((r.p, r.s, r.km) for r in got)] == pytest.approx([w[2] for w in want], abs=1e-5)
    assert len({r.task for r in got if r.lat == 37.4}) > 3
    walked = E.walk_edges(p, s, "p", "s").where("from_id LIKE 'a%'").collect()
    assert sorted((r.from_id, r.to_id) for r in walked) == sorted((f"a{a}", f"b{b}") for a, b, _ in want)
