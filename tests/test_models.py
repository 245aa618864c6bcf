"""Learned operators against plain versions and planted truths."""

import random

import numpy as np
import pytest

from tramline.operators import crowding as C
from tramline.operators import evaluate as V


def pooled(points):
    """Pool adjacent violators: (x, fitted) of weighted points by ascending x."""
    blocks = []
    for x, y in sorted(points):
        blocks.append([y, 1, [x]])
        while len(blocks) > 1 and (blocks[-2][2][-1] == x or blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]):
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return [(x, s / n) for s, n, xs in blocks for x in xs]


def test_isotonic_fit_by_pooling(spark):
    rnd = random.Random(1)
    x = [rnd.randrange(40) / 40 for _ in range(600)]
    train = [(v, float(rnd.random() < 0.2 + 0.6 * v)) for v in x]
    mean = {}
    for v, y in train:
        mean.setdefault(v, []).append(y)
    # ties are one point first
    fit = dict(pooled([(v, sum(y) / len(y)) for v, y in mean.items() for _ in y]))
    xs = sorted(fit)
    test = [(-1.0,), (2.0,), *[(rnd.random(),) for _ in range(60)], *[(v,) for v in xs]]
    out = V.isotonic_calibrate(spark.createDataFrame(train, "p double, y double"), spark.createDataFrame(test, "p double"), "p", "y").collect()
    for r in out:
        assert r.calibrated == pytest.approx(float(np.interp(r.p, xs, [fit[v] for v in xs])), abs=1e-9)


def test_profiles_fall_into_their_shapes(spark):
    rnd = random.Random(2)
    shapes = [[0, 0, 9, 9, 0, 0], [9, 9, 0, 0, 0, 0], [0, 0, 0, 0, 9, 9]]
    # scale and level differ, the shape decides; a constant row has none
    rows = [(k, *[rnd.choice([1, 5]) * (v + rnd.random() / 2) + 3 for v in shapes[k % 3]]) for k in range(90)] + [(90, *[4.0] * 6)]
    names = [f"h{i}" for i in range(6)]
    df = spark.createDataFrame(rows, "k int, " + ", ".join(f"{n} double" for n in names))
    out = {r.k: r.cluster for r in V.cluster_profiles(df, "k", names, 3).collect()}
    of = [{out[k] for k in range(90) if k % 3 == s} for s in range(3)]
    assert 90 not in out and all(len(c) == 1 for c in of) and len(set.union(*of)) == 3


def test_residuals_are_learned(spark):
    """A step and a slope in the residual: held-out errors fall under a tenth of the look-up's; missing values give no prediction."""
    rnd = random.Random(3)
    rows = [(s, d, 100.0 + 10 * s, 100.0 + 10 * s + (30 if s > 5 else -20) + 4 * d) for s in range(12) for d in range(7) for _ in range(12)]
    rnd.shuffle(rows)
    kind = "slot int, dow int, lookup double, truth double"
    test = [*rows[:200], (3, None, 1.0, 2.0), (3, 1, None, 2.0)]
    out = V.residual_model(spark.createDataFrame(rows[200:], kind), spark.createDataFrame(test, kind), ["slot", "dow"], "truth", "lookup").collect()
    given = [r for r in out if r.prediction is not None]
    assert len(given) == 200
    error = lambda p: np.mean([abs(p(r) - r.truth) for r in given])
    assert error(lambda r: r.prediction) < 0.1 * error(lambda r: r.lookup)


@pytest.mark.parametrize(("block", "times"), [(64, 1024), (3, 5)])
def test_correlations_by_blocks(spark, block, times):
    """Series with gaps, a constant one, stations without values, pairs of and across blocks."""
    rnd = random.Random(4)
    series = {s: {t: 1e6 + s * t + rnd.gauss(0, 40) for t in range(60) if rnd.random() < 0.8} for s in range(11)}
    series[11] = {t: 5.0 for t in range(60)}
    pairs = [(a, b) for a in range(13) for b in range(13) if a < b and rnd.random() < 0.4] + [(0, 11), (3, 12)]
    pairs = sorted(set(pairs))
    want = []
    for a, b in pairs:
        both = sorted(set(series.get(a, {})) & set(series.get(b, {})))
        x, y = [series[a][t] for t in both], [series[b][t] for t in both] if both else []
        if len(both) > 1 and np.std(x) > 0 and np.std(y) > 0:
            want.append(np.corrcoef(x, y)[0, 1])
    values = spark.createDataFrame([(s, t, v) for s, of in series.items() for t, v in of.items()], "station int, t int, v double")
    r = C.neighbor_correlation(values, spark.createDataFrame(pairs, "a int, b int"), "station", "t", "v", block, times).first()
    assert r.pairs == len(want) and r.mean_corr == pytest.approx(np.mean(want), abs=1e-9)


@pytest.mark.parametrize(("block", "times"), [(64, 1024), (3, 5)])
def test_correlations_by_places(spark, block, times):
    """Stations of few places under scattered ids: pairs of places stand for all pairs of their stations, and blocks follow places,
    so few of them are neighbours."""
    rnd = random.Random(9)
    place = {s: s % 7 for s in range(23)}
    series = {s: {t: 50 + rnd.gauss(0, 9) + t % (2 + s % 5) for t in range(30) if rnd.random() < 0.8} for s in range(22)}
    paired = [(p, p) for p in range(6)] + [(p, p + 1) for p in range(6)] + [(5, 4)]
    want = []
    for a in range(22):
        for b in range(a + 1, 22):
            if {(place[a], place[b]), (place[b], place[a])} & set(paired):
                both = sorted(set(series[a]) & set(series[b]))
                want.append(np.corrcoef([series[a][t] for t in both], [series[b][t] for t in both])[0, 1])
    values = spark.createDataFrame([(s, t, v) for s, of in series.items() for t, v in of.items()], "station int, t int, v double")
    places = spark.createDataFrame([(s, p, p) for s, p in place.items()], "station int, place int, order int")
    pairs = spark.createDataFrame(paired, "a int, b int")
    r = C.neighbor_correlation(values, pairs, "station", "t", "v", block, times, places).first()
    assert r.pairs == len(want) and r.mean_corr == pytest.approx(np.mean(want), abs=1e-9)
    none = C.neighbor_correlation(values.limit(0), pairs, "station", "t", "v", block, times, places).first()
    assert none.pairs == 0 and none.mean_corr is None


def test_close_numbers_are_close_places(spark):
    """A run of 64 of 4,096 places of a square lies in a corner of it."""
    from tramline.operators.events import along_curve

    grid = spark.range(4096).selectExpr("37 + id % 64 * 0.01 AS lat", "127 + floor(id / 64) * 0.01 AS lon")
    rows = [(r.lat, r.lon) for r in grid.orderBy(along_curve(grid.lat, grid.lon)).collect()]
    runs = [rows[i : i + 64] for i in range(0, 4096, 64)]
    assert np.median([max(la for la, _ in run) - min(la for la, _ in run) + max(lo for _, lo in run) - min(lo for _, lo in run) for run in runs]) < 0.4
