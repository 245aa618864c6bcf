"""Names by an index, numbers of codes, latencies from partials, sums ahead of a hot entity, rings."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.operators import crowding as C
from tramline.operators import events as E
from tramline.operators import network as N
from tramline.operators import stock as S
from tramline.sources import view as V
from tramline.streaming import streams as R


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def test_an_index_finds_what_a_scan_finds(spark, root):
    rnd = random.Random(1)
    names = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(0, 9))) for _ in range(500)] + [None, "abc", "abcabc", "xabc", "ab"]
    df = spark.createDataFrame([(n,) for n in names], "station string")
    E.write_name_index(df, "station", root, buckets=8)
    for text in ("abc", "ab", "a", "é b", "bcab", "zzz", "", "abcabcab", "aaaa"):
        want = [(r.station, r.rank) for r in E.search_names(df, "station", text, 1000).collect()]
        assert [(r.name, r.rank) for r in E.search_index(spark, root, text, 1000, buckets=8).collect()] == want
    plan = E.search_index(spark, root, "bcab", buckets=8)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(gram" in plan


def test_numbers_of_codes_hang_on_no_partitioning(spark):
    codes = [f"ST-{k}" for k in range(3000)]
    df = spark.createDataFrame([(c,) for c in codes + codes[:50]] + [(None,)], "station string")
    want = {c: i for i, c in enumerate(sorted(codes))}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 4, 37):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {r.station: r.code for r in S.station_index(df.repartition(n + 1), "station").collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_latencies_of_28_days_from_partials(spark, root):
    """Within the bound for every key, from partials alone, and exact where a key has few rows."""
    rows = spark.range(280_000).select((F.col("id") % 28).cast("string").alias("day"), F.when(F.col("id") % 1000 == 0, "rare").otherwise("usual").alias("source"), F.lit(0).alias("p"), F.pmod(F.xxhash64("id"), F.lit(100_003)).alias("ms"))
    rows = rows.select("day", "source", F.timestamp_millis(F.col("p")).alias("made"), F.timestamp_millis("ms").alias("got"), "ms")
    each = R.keep_latency(root, ["source"], "day", "made", "got")
    for number in range(4):
        each(rows.where(F.pmod(F.xxhash64("ms"), F.lit(4)) == number), number)
    each(rows, 3)  # comes again
    view = V.read_view(spark, root)
    assert view.count() == 28 + 7
    got = {r.source: r for r in N.latency_from_partials(view, ["source"]).collect()}
    of = {k: sorted(r.ms for r in rows.where(F.col("source") == k).select("ms").collect()) for k in got}
    assert {k: (r.n, r.least, r.most) for k, r in got.items()} == {k: (len(v), v[0], v[-1]) for k, v in of.items()}
    for k, v in of.items():
        for share, p in ((0.5, got[k].p50), (0.95, got[k].p95)):
            under, upto = sum(x < p for x in v) / len(v), sum(x <= p for x in v) / len(v)
            assert under <= share + N.SKETCH_ERROR and upto >= share - N.SKETCH_ERROR
    exact = N.latency_stats(rows, ["source"], "ms").where("source = 'rare'").first()
    assert (got["rare"].p50, got["rare"].p95) == (exact.p50, exact.p95)


@pytest.mark.parametrize("frame", ["time", "rows_compat"])
def test_sums_ahead_of_an_entity_with_most_rows(spark, frame):
    rnd = random.Random(5)
    rows = [(0, rnd.randrange(40_000), rnd.randrange(9)) for _ in range(900)] + [(rnd.randrange(1, 9), rnd.randrange(40_000), rnd.randrange(9)) for _ in range(300)]
    rows = sorted(set((e, t) for e, t, _ in rows))
    df = spark.createDataFrame([(i, e, t, i % 7, "x") for i, (e, t) in enumerate(rows)], "id int, e int, t long, v int, other string").withColumn("ts", F.timestamp_seconds("t")).drop("t")
    if frame == "time":
        w = Window.partitionBy("e").orderBy(F.unix_timestamp("ts")).rangeBetween(1, 1800)
    else:
        w = Window.partitionBy("e").orderBy("ts").rowsBetween(-4, 1)
    want = {r.id: r.s for r in df.select("id", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")).collect()}
    out = S.forward_sum(df, "e", "ts", ["v"], 30, frame, rows=16)
    assert out.columns == [*df.columns, "v_next_30"]
    assert {r.id: r.v_next_30 for r in out.collect()} == want
    # the entity is many windows
    bucket = F.floor(F.unix_timestamp("ts") / (4 * 1800))
    assert df.where("e = 0").select(bucket).distinct().count() > 5


def test_rings_by_sums_are_rings_by_pairs(spark):
    rnd = random.Random(6)
    rows = [(k, i, float(rnd.randrange(0, 50)), float(rnd.choice([0, 0, rnd.randrange(50)]))) for k in range(14) for i in range(k)]
    rows += [(20, i, 5.0, 0.0) for i in range(4)] + [(21, i, 3.0, 7.0 if i == 2 else 0.0) for i in range(5)]
    df = spark.createDataFrame(rows, "ring int, seq int, boarding double, alighting double")
    a = {(r.ring, r.seq): (r.load_up, r.load_down) for r in C.circular_loads(df, ["ring"]).collect()}
    b = {(r.ring, r.seq): (r.load_up, r.load_down) for r in C.ring_loads(df, ["ring"]).collect()}
    assert a.keys() == b.keys()
    for k, loads in a.items():
        assert b[k] == pytest.approx(loads, abs=1e-9)


def test_circular_loads_build_no_pairs(spark):
    """A ring of 600 stations has 54 million passings: the loads come without them, as the pairs say."""
    n, rnd = 600, random.Random(8)
    b, a = [float(rnd.randrange(50)) for _ in range(n)], [float(rnd.randrange(50)) for _ in range(n)]
    df = spark.createDataFrame([(1, i, b[i], a[i]) for i in range(n)], "ring int, seq int, boarding double, alighting double")
    out = C.circular_loads(df, ["ring"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
    w, total = [b[i] / (sum(a) - a[i]) for i in range(n)], n // 2
    got = {r.seq: r for r in out.collect()}
    for s in (0, 1, 299, 300, 599):
        up = sum(w[(s - k) % n] * a[(s - k + d) % n] for k in range(total) for d in range(k + 1, total + 1))
        down = sum(w[(s + k) % n] * a[(s + k - d) % n] for k in range(total - 1) for d in range(k + 1, total))
        assert got[s].load_up == pytest.approx(up) and got[s].load_down == pytest.approx(down)
