import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.operators.quantiles import exact_quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]


def plain(values):
    return None if not len(values) else np.quantile(np.array(values), SHARES)


@pytest.mark.parametrize("kind", ["even", "few values", "far off", "ties at the middle"])
def test_whole_column(spark, kind):
    rnd = np.random.default_rng(1)
    values = {
        "even": rnd.random(5000),
        "few values": rnd.integers(0, 3, 5000).astype(float),
        "far off": np.concatenate([rnd.random(4000), [1e300, -1e300, 1e12], rnd.random(500) * 1e6]),
        "ties at the middle": np.concatenate([np.zeros(3000), rnd.normal(size=999)]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)] * 9, "v double")
    for few in (1, 50, 10**6):
        got = exact_quantiles(df, [], "v", SHARES, fan=16, few=few).first()[0]
        assert np.allclose(got, plain(values), rtol=1e-12)


def test_groups_with_a_hot_key_and_null_keys(spark):
    rnd = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in rnd.random(3000)] + [(k, float(v)) for k in (None, "a", "b") for v in rnd.integers(0, 9, 40)] + [("nulls", None)] * 4 + [("one", 3.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.q for r in exact_quantiles(df, ["k"], "v", SHARES, fan=8, few=20).collect()}
    assert set(got) == {"hot", None, "a", "b", "nulls", "one"}
    for k, q in got.items():
        of = [v for key, v in rows if key == k and v is not None]
        assert q == [None] * len(SHARES) if not of else np.allclose(q, plain(of))


def test_empty_table_and_no_task_with_all_values(spark):
    df = spark.createDataFrame([], "v double")
    assert exact_quantiles(df, [], "v", [0.5]).collect() == [([None],)]
    big = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("v"))
    got = exact_quantiles(big, [], "v", [0.5, 0.9], few=100).first()[0]
    assert got == big.agg(F.percentile("v", F.array(F.lit(0.5), F.lit(0.9)))).first()[0]
