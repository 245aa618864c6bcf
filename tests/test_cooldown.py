import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tramline.queries.feeds import rocksdb
from tramline.streaming import streams as R

KINDS = "entity string, ts timestamp, on boolean"


def batches_of(rows, size):
    """Rows in order of time but shuffled within ``size``, in batches of that many."""
    rnd = random.Random(4)
    return [rnd.sample(rows[i : i + size], len(rows[i : i + size])) for i in range(0, len(rows), size)]


def run(spark, path, batches, seconds, delay, beat=10**6):
    """Each batch as a file, one file a trigger."""
    out = f"{path}/out"
    ts = lambda s: pd.Timestamp(s, unit="s", tz="UTC")
    last = max(t for b in batches for _, t, _ in b) + beat
    for n, batch in enumerate([*batches, [("beat", last, False)], [("beat", last + beat, False)]]):
        spark.createDataFrame(pd.DataFrame({"entity": [e for e, _, _ in batch], "ts": [ts(t) for _, t, _ in batch], "on": [o for _, _, o in batch]}), KINDS).coalesce(1).write.mode("append").parquet(f"{path}/in")
        with rocksdb(spark):
            R.run_available(R.cooldown_stream(spark.readStream.schema(KINDS).parquet(f"{path}/in"), "entity", "ts", "on", seconds, delay), out)
    return spark.read.parquet(out).where("entity <> 'beat'")


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    return sorted(((rnd.choice("abc"), rnd.randrange(2000), rnd.random() < 0.4) for _ in range(300)), key=lambda r: r[1])


def test_stream_equals_batch_with_rows_out_of_order_across_batches(spark, tmp_path, rows):
    batches = batches_of(rows, 60)
    # each batch hands two of its rows to the next one
    moved = [b[2:] + (batches[i - 1][:2] if i else []) for i, b in enumerate(batches)] + [batches[-1][:2]]
    out = run(spark, str(tmp_path), moved, 90, "20 minutes")
    want = R.cooldown_batch(spark.createDataFrame(rows, "entity string, ts long, on boolean"), "entity", "ts", "on", 90)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))
    # nothing is left in the state once all is silent
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/out-checkpoint")
    assert state.where("key.entity <> 'beat'").count() == 0
    last = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/out-checkpoint")
    assert last.where("key.entity <> 'beat'").count() == 0
