"""Joins by distance against all pairs, at every latitude and across 180 degrees."""

import math
import random

import pytest

from tramline.operators import events as E


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def places(seed, lat, lon, n, spread):
    rnd = random.Random(seed)
    wrap = lambda x: (x + 180) % 360 - 180
    wide = min(spread / max(math.cos(math.radians(lat)), 0.02), 180)
    return [(k, max(-90.0, min(90.0, lat + rnd.uniform(-spread, spread))), wrap(lon + rnd.uniform(-wide, wide))) for k in range(n)]


@pytest.mark.parametrize("lat,lon", [(0, 10), (37, 127), (-37, 180), (69, 25), (85, -179.9), (89.9, 0), (-89.95, 40)])
def test_radius_join(spark, lat, lon):
    a, b = places(1, lat, lon, 150, 0.08), places(2, lat, lon, 120, 0.08)
    left, right = spark.createDataFrame(a, "p int, lat double, lon double"), spark.createDataFrame(b, "s int, lat double, lon double")
    got = sorted((r.p, r.s) for r in E.radius_join(left, right, 1.5).collect())
    near = {(x[0], y[0]): km(x[1:], y[1:]) for x in a for y in b}
    assert [k for k in got if not near[k] < 1.51] == [] and len(got) == len(set(got)) > 10
    assert {k for k, d in near.items() if d < 1.49} <= set(got)


def test_nearest_has_no_limit(spark):
    a = places(3, 10, 20, 40, 0.1) + [(100, -60.0, -150.0), (101, 88.0, 100.0), (102, None, 5.0)]
    b = places(4, 10, 20.05, 30, 0.05) + [(50, 40.0, 170.0)]
    left, right = spark.createDataFrame(a, "p int, lat double, lon double"), spark.createDataFrame(b, "s int, lat double, lon double")
    out = {r.p: r.s for r in E.nearest_one(left, right, "p", "s").collect()}
    assert len(out) == len(a) and out.pop(102) is None
    for p, s in out.items():
        (x,) = [v[1:] for v in a if v[0] == p]
        far = {y[0]: km(x, y[1:]) for y in b}
        assert far[s] <= min(far.values()) + 1e-6
    assert {r.s for r in E.nearest_one(left, right.limit(0), "p", "s").collect()} == {None}


@pytest.mark.parametrize("full", [1, 32])
def test_nearest_by_a_tree(spark, monkeypatch, full):
    """A dense city, equal places, poles and the date line, points everywhere: as a scan finds it."""
    monkeypatch.setattr(E, "FULL", full)
    rnd = random.Random(9)
    b = places(5, 37.5, 127, 300, 0.2) + [(400 + k, 37.5, 127.0) for k in range(40)] + [(500, 90.0, 0.0), (501, -89.9, 5.0), (502, 0.0, 180.0), (503, 0.001, -180.0), (504, 0.0, 0.0)]
    a = [(k, math.degrees(math.asin(rnd.uniform(-1, 1))), rnd.uniform(-180, 180)) for k in range(120)] + [(200, 37.5, 127.0), (201, -90.0, 77.0), (202, 0.0, 179.9999), (203, 36.0, 127.0)]
    left, right = spark.createDataFrame(a, "p int, lat double, lon double"), spark.createDataFrame(b, "s int, lat double, lon double")
    out = {r.p: r._b for r in E.nearest_by_tree(left, right, "p", "s").collect()}
    assert len(out) == len(a) and out[200].s == 400
    for p, *x in a:
        far = {y[0]: km(x, y[1:]) for y in b}
        assert far[out[p].s] <= min(far.values()) + 1e-6


def test_polygons_by_cells(spark):
    rnd = random.Random(6)
    rings = [("l", [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]), ("t", [(5.0, 5.0), (9.0, 5.0), (7.0, 9.0)]), ("in", [(0.2, 0.2), (0.8, 0.2), (0.8, 0.8), (0.2, 0.8)])]
    points = [(k, rnd.uniform(-1, 10), rnd.uniform(-1, 10)) for k in range(400)]

    def inside(x, y, ring):
        hit = False
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    areas = spark.createDataFrame(rings, "area string, ring array<struct<x:double,y:double>>")
    out = E.point_in_polygon(spark.createDataFrame(points, "p int, x double, y double"), areas, "p", "area", cells=7).collect()
    got = {r.p: r for r in out}
    assert len(out) == len(got) == len(points)
    for k, x, y in points:
        within = sorted(a for a, ring in rings if inside(x, y, ring))
        assert (got[k].method, got[k].area) == ("within", within[0]) if within else got[k].method == "nearest"


def to_segment(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / n)) if n else 0.0
    return math.hypot(x - a[0] - t * dx, y - a[1] - t * dy)


@pytest.mark.parametrize("spread", [3.0, 100.0])
def test_nearest_boundary_of_a_thousand_polygons(spark, spread):
    """Small rings in clusters, rings within rings, long thin ones over the whole map, single vertices; points far outside."""
    rnd = random.Random(int(spread))
    rings = []
    for k in range(1000):
        cx, cy = rnd.choice([(0, 0), (50, 50), (90, 3)])
        cx, cy = cx + rnd.gauss(0, spread), cy + rnd.gauss(0, spread)
        n, r = rnd.choice([1, 2, 3, 4, 9]), rnd.choice([0.01, 0.3, 2])
        rings.append((k, [(cx + r * math.cos(2 * math.pi * i / n), cy + r * math.sin(2 * math.pi * i / n)) for i in range(n)]))
    rings += [(1000, [(-150.0, -150.0), (250.0, 240.0), (250.0, 240.1)]), (1001, [(10.0, -99.0), (10.0, 199.0), (10.0, 199.0)]), (1002, [])]
    points = [(k, rnd.uniform(-60, 150), rnd.uniform(-60, 150)) for k in range(60)] + [(60, 1e4, -1e4), (61, 50.0, 50.0), (62, None, 3.0)]
    areas = spark.createDataFrame(rings, "area int, ring array<struct<x:double,y:double>>")
    places = spark.createDataFrame(points, "p int, x double, y double")
    found = E.nearest_boundary(places, areas, "p", "area")
    got = {r.p: r for r in found.collect()}
    assert len(got) == len(points) and got[62].area is None
    for p, x, y in points[:-1]:
        far = {k: min(to_segment(x, y, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) for k, ring in rings if ring}
        assert math.isclose(got[p].distance, min(far.values()), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(far[got[p].area], min(far.values()), rel_tol=1e-9, abs_tol=1e-12)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert all(r.area is None for r in E.nearest_boundary(places, areas.limit(0), "p", "area").collect())


@pytest.mark.parametrize("looking", [0, 200_000])
def test_nearest_boundary_where_every_edge_is_long(spark, monkeypatch, looking):
    """Rings from one task, most of them over half the map, some twice under two ids: their edges are dealt to many tasks, whether places
    go to them or meet them in a shuffle; what the JVM has to compile is short; answers are those of all pairs."""
    monkeypatch.setattr(E, "LAID", 100, raising=False)
    monkeypatch.setattr(E, "LOOKING", looking, raising=False)
    rnd = random.Random(11)
    at = lambda: (rnd.uniform(0, 10), rnd.uniform(0, 10))
    rings = [(k, [at() for _ in range(rnd.choice([1, 2, 3, 4]))]) for k in range(150)]
    rings += [(500 + k, [(k / 4, 1.0), (k / 4, 9.0)]) for k in range(40)] + [(600 + k, [(1.0, k / 4), (9.0, k / 4)]) for k in range(40)]
    rings += [(1000 - k, ring) for k, ring in rings[:20]]
    points = [(k, *at()) for k in range(80)] + [(100 + k, *rings[k][1][0]) for k in range(30)] + [(200, -3.0, 5.0), (201, 1e4, 1e4), (202, 2.5, 5.0), (203, None, 1.0)]
    areas = spark.createDataFrame([(k, ring) for k, ring in rings] + [(2000, [(5.0, None), (5.0, 5.0)])], "area int, ring array<struct<x:double,y:double>>").coalesce(1)
    tasks, methods, lay, cut = [], [], E.rasterised, E.cut

    def spied(rows):
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "codegen")
        methods.extend(int(x.split(";")[0]) for x in plan.split("maxMethodCodeSize:")[1:])
        return cut(rows)

    monkeypatch.setattr(E, "rasterised", lambda edges, *rest: (tasks.append(edges.rdd.getNumPartitions()), lay(edges, *rest))[1])
    monkeypatch.setattr(E, "cut", spied)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {r.p: r for r in E.nearest_boundary(spark.createDataFrame(points, "p int, x double, y double"), areas, "p", "area").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert min(tasks) > 5
    # the JVM's limit, -XX:-DontCompileHugeMethods
    assert methods and max(methods) < 8000
    assert len(got) == len(points) and (got[203].area, got[203].distance) == (None, None)
    for p, x, y in points[:-1]:
        far = {k: min(to_segment(x, y, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) for k, ring in rings}
        best = min(far.values())
        assert math.isclose(got[p].distance, best, rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(far[got[p].area], best, rel_tol=1e-9, abs_tol=1e-12)
        twins = [k for k, ring in rings if ring == dict(rings)[got[p].area]]
        assert got[p].area == min(twins)
