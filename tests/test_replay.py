import os
import uuid

import pytest
from pyspark.sql import functions as F

from tramline.sources import replay as L


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def rows(spark, begin, end, topic="bike.stock"):
    r = spark.range(begin, end)
    return r.select(F.lit(topic).alias("topic"), (F.col("id") % 3).cast("int").alias("partition"), F.col("id").cast("string").alias("key"), F.concat(F.lit("v"), "id").alias("value"), F.timestamp_seconds("id").alias("timestamp"))


def run(stream, path, each=None):
    w = stream.writeStream.option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    q = (w.foreachBatch(each) if each else w.format("parquet").option("path", path)).start()
    q.awaitTermination()


def keys(df):
    return sorted(int(r.key) for r in df.collect())


def test_offsets_have_no_gap_and_rows_come_back(spark, root):
    L.append_log(rows(spark, 0, 1000), root)
    L.append_log(rows(spark, 1000, 1500), root)
    out = L.read_log(spark, root)
    assert keys(out) == list(range(1500))
    per = out.groupBy("partition").agg(F.min("offset"), F.max("offset"), F.countDistinct("offset"), F.count("offset")).collect()
    assert sorted(tuple(r) for r in per) == [(p, 0, 499, 500, 500) for p in range(3)]
    assert {(r.key, r.value, r.timestamp.timestamp()) for r in out.where("key = '1234'").collect()} == {("1234", "v1234", 1234.0)}
    # a later append lies behind an earlier one
    early = out.groupBy("partition").agg(F.max(F.when(F.col("key").cast("int") < 1000, F.col("offset"))).alias("a"), F.min(F.when(F.col("key").cast("int") >= 1000, F.col("offset"))).alias("b"))
    assert all(r.a < r.b for r in early.collect())
    assert L.bounds(root) == {f"bike.stock/{p}": (0, 500) for p in range(3)}


def test_a_stopped_stream_goes_on_without_loss_or_repeat(spark, root, tmp_path):
    path = str(tmp_path / "out")
    L.append_log(rows(spark, 0, 100), root)
    run(L.stream_log(spark, root, ["bike.stock"], group="g"), path)
    assert keys(spark.read.parquet(path)) == list(range(100))
    # a partition and a topic that the stream has not seen, and nothing new at the last run
    L.append_log(rows(spark, 100, 250).withColumn("partition", F.col("partition") + 1), root)
    L.append_log(rows(spark, 900, 950, "weather"), root)
    for _ in range(2):
        run(L.stream_log(spark, root, ["bike.stock"], group="g"), path)
        assert keys(spark.read.parquet(path)) == list(range(250))
    # a new query replays from the earliest offset
    again = str(tmp_path / "again")
    run(L.stream_log(spark, root), again)
    assert keys(spark.read.parquet(again)) == sorted([*range(250), *range(900, 950)])


def test_a_batch_that_failed_is_read_again(spark, root, tmp_path):
    path, tries = str(tmp_path / "out"), []

    def each(df, batch):
        tries.append((batch, keys(df)))
        if len(tries) == 1:
            raise RuntimeError("the sink is down")
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    L.append_log(rows(spark, 0, 40), root)
    with pytest.raises(Exception, match="the sink is down"):
        run(L.stream_log(spark, root, group="g"), path, each)
    assert L.committed(root, "g") == {}
    L.append_log(rows(spark, 40, 60), root)
    # with this trigger a run is one batch: first the one that failed, with the same rows, then what came meanwhile
    for _ in range(2):
        run(L.stream_log(spark, root, group="g"), path, each)
    assert tries[1] == tries[0] and tries[2][1] == list(range(40, 60))
    assert keys(spark.read.parquet(path)) == list(range(60))


def test_groups(spark, root, tmp_path):
    L.append_log(rows(spark, 0, 30), root)
    run(L.stream_log(spark, root, group="g"), str(tmp_path / "a"))
    L.append_log(rows(spark, 30, 60), root)
    run(L.stream_log(spark, root, group="g"), str(tmp_path / "a"))
    L.append_log(rows(spark, 60, 90), root)
    # offsets are committed once the next batch is planned, so a group is behind its query, never ahead of it
    lag = L.group_lag(spark, root, "g").collect()
    assert {(r.partition, r.end_offset) for r in lag} == {(p, 30) for p in range(3)} and all(0 < r.lag <= 30 and r.next_offset + r.lag == 30 for r in lag)
    new = str(tmp_path / "new")
    run(L.stream_log(spark, root, starting="group", group="g"), new)
    begin = {r.partition: r.next_offset for r in lag}
    assert {(r.partition, r[1]) for r in spark.read.parquet(new).groupBy("partition").agg(F.min("offset")).collect()} == set(begin.items())
    latest = str(tmp_path / "latest")
    run(L.stream_log(spark, root, starting="latest"), latest)
    L.append_log(rows(spark, 90, 96), root)
    run(L.stream_log(spark, root, starting="latest"), latest)
    assert keys(spark.read.parquet(latest)) == list(range(90, 96))


def test_a_large_partition_is_many_tasks(spark, root, monkeypatch):
    monkeypatch.setattr(L, "TASK_ROWS", 7)
    L.append_log(rows(spark, 0, 90).withColumn("partition", F.lit(0)).coalesce(1), root)
    parts = L.ranges(root, [], {}, {"bike.stock/0": 90})
    assert len(parts) == 13 and sum(p.end - p.begin for p in parts) == 90
    assert [b.column("offset").to_pylist() for b in L.rows_of(root, parts[2])] == [list(range(14, 21))]


def test_what_is_gone_is_an_error(spark, root):
    L.append_log(rows(spark, 0, 30), root)
    L.append_log(rows(spark, 30, 60), root)
    path = L.segments(root)["bike.stock/0"][0][2]
    os.remove(path)
    first = L.segments(root)["bike.stock/0"][0][0]
    with pytest.raises(ValueError, match="gone"):
        L.ranges(root, [], {"bike.stock/0": 0}, {"bike.stock/0": 20})
    assert L.bounds(root)["bike.stock/0"] == (first, 20)


def test_rows_without_a_place_stop_the_append(spark, root):
    with pytest.raises(Exception, match="no place"):
        L.append_log(rows(spark, 0, 5).withColumn("topic", F.lit(None).cast("string")), root)
    assert L.bounds(root) == {}
