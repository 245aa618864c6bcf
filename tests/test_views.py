import uuid

import pytest
from pyspark.sql import functions as F

from tramline.sources import view as V
from tramline.streaming import streams as R

KINDS = "station_id long, date string, at long, stock int"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def files(spark, root):
    return set(V.read_view(spark, root).inputFiles())


def test_only_the_days_of_a_batch_are_written(spark, root):
    each = R.keep_history(root, ["station_id", "date"], "at", "date")
    each(spark.createDataFrame([(k, f"2024-01-0{d}", 1, k) for k in range(5) for d in range(1, 5)], KINDS), 0)
    before = files(spark, root)
    each(spark.createDataFrame([(1, "2024-01-02", 2, 77), (2, "2024-01-02", 0, 88), (9, "2024-01-05", 1, 9)], KINDS), 1)
    after = files(spark, root)
    # older rows lose, newer ones win, new days come in
    want = {(k, f"2024-01-0{d}"): (1, k) for k in range(5) for d in range(1, 5)} | {(1, "2024-01-02"): (2, 77), (9, "2024-01-05"): (1, 9)}
    assert {r[:2]: r[2:] for r in rows(V.read_view(spark, root))} == want
    assert {f for f in before if "2024-01-02" not in f} == before & after and len(before & after) >= 3
    assert rows(V.read_view(spark, root, ["2024-01-05"])) == [(9, "2024-01-05", 1, 9)]


def test_a_batch_that_runs_twice_changes_nothing(spark, root):
    each = R.keep_latest(root, "station_id", "at", buckets=4)
    batch = spark.createDataFrame([(k, "2024-01-01", 1, k) for k in range(9)], KINDS)
    each(batch, 0)
    each(spark.createDataFrame([(1, "2024-01-01", 1, 50)], KINDS), 1)
    before, m = files(spark, root), V.current(spark, root)
    each(batch, 0)
    each(spark.createDataFrame([(1, "2024-01-01", 1, 60)], KINDS), 1)
    assert files(spark, root) == before and V.current(spark, root) == m
    assert (1, "2024-01-01", 1, 50) in rows(V.read_view(spark, root))


def test_a_killed_merge_leaves_the_old_view(spark, root, monkeypatch):
    each = R.keep_history(root, ["station_id", "date"], "at", "date")
    each(spark.createDataFrame([(1, "2024-01-01", 1, 5)], KINDS), 0)
    old = rows(V.read_view(spark, root))
    batch = spark.createDataFrame([(1, "2024-01-01", 2, 6), (2, "2024-01-02", 2, 6)], KINDS)
    with monkeypatch.context() as m:

        def killed(*_):
            raise KeyboardInterrupt

        m.setattr(V.Folder, "write", killed)
        with pytest.raises(KeyboardInterrupt):
            each(batch, 1)
    assert rows(V.read_view(spark, root)) == old and V.current(spark, root).batches == {"": 0}
    each(batch, 1)
    assert rows(V.read_view(spark, root)) == [(1, "2024-01-01", 2, 6), (2, "2024-01-02", 2, 6)]


def test_two_merges_at_once_and_rows_elsewhere(spark, root):
    df = spark.createDataFrame([(1, "2024-01-01", 1, 5)], KINDS)
    V.merge_into(root, df, F.col("date"), lambda s, n: n)

    def meanwhile(stored, new):
        V.merge_into(root, df, F.col("date"), lambda s, n: n)
        return new

    with pytest.raises(RuntimeError, match="another merge"):
        V.merge_into(root, df, F.col("date"), meanwhile)
    with pytest.raises(ValueError, match="outside"):
        V.merge_into(root, df, F.col("date"), lambda s, n: n.withColumn("date", F.lit("2030-01-01")))
    with pytest.raises(ValueError, match="no partition"):
        V.merge_into(root, df.withColumn("date", F.lit(None).cast("string")), F.col("date"), lambda s, n: n)
    assert rows(V.read_view(spark, root)) == rows(df)


def test_names_of_partitions_and_vacuum(spark, root):
    odd = ["a b", "x/y", "50%", "d=1", ""]
    df = spark.createDataFrame([(k, p, 1, k) for k, p in enumerate(odd[:4])], KINDS)
    for n in range(4):
        V.merge_into(root, df.where(F.col("station_id") >= n), F.col("date"), lambda s, new: new, n)
    assert rows(V.read_view(spark, root)) == rows(df)
    V.vacuum(spark, root, keep=1)
    assert rows(V.read_view(spark, root)) == rows(df)
    folder = V.Folder(spark, root)
    assert len(folder.names("_manifests")) == 1 and folder.names("data") == ["v1", "v2", "v3", "v4"]
    V.merge_into(root, df, F.col("date"), lambda s, new: new, 9)
    V.vacuum(spark, root, keep=1)
    assert folder.names("data") == ["v5"] and rows(V.read_view(spark, root)) == rows(df)


def test_rows_that_vanish_and_an_empty_view(spark, root):
    df = spark.createDataFrame([(1, "2024-01-01", 1, 5)], KINDS)
    V.merge_into(root, df, F.col("date"), lambda s, n: n)
    V.merge_into(root, df, F.col("date"), lambda s, n: n.limit(0))
    assert rows(V.read_view(spark, root)) == [] and V.read_view(spark, root).schema == df.schema
    with pytest.raises(ValueError, match="no view"):
        V.read_view(spark, f"{root}-none")


def test_newest_issue_in_batches(spark, root):
    data = [(k, f"2024-01-0{d}", h, k * 100 + d * 10 + h) for k in range(6) for d in (1, 2, 3) for h in range(3) if (k + d + h) % 4]
    df = spark.createDataFrame(data, "series long, issued string, valid int, tie int")
    each = R.keep_latest_issue(root, ["series"], "issued", "valid", "tie", buckets=3)
    for n, d in enumerate((2, 1, 3)):
        each(df.where(F.col("issued") == f"2024-01-0{d}"), n)
    newest = {}
    for k, d, h, t in data:
        newest.setdefault(k, {}).setdefault(d, []).append((k, d, h, t))
    want = sorted(r for days in newest.values() for r in days[max(days)])
    assert rows(V.read_view(spark, root).select("series", "issued", "valid", "tie")) == want


def test_windows_that_change_take_their_own_place(spark, root, tmp_path):
    """A stream in update mode over three batches: the view is that of all rows, and days that a batch leaves alone keep their files."""
    kinds = "e int, ts timestamp, v int, id int"
    data = [(i % 3, i * 977 % 200_000, i, i) for i in range(120)]
    frame = lambda rows: spark.createDataFrame(rows, "e int, s long, v int, id int").select("e", F.timestamp_seconds("s").alias("ts"), "v", "id")
    stream = lambda: spark.readStream.schema(kinds).parquet(str(tmp_path / "in"))
    kept = []
    # the last batch has rows of the third day alone
    for part in ([r for r in data if r[3] < 40], [r for r in data if 40 <= r[3] and r[1] < 172_800], [r for r in data if 40 <= r[3] and r[1] >= 172_800]):
        frame(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        R.run_available(R.tumbling_last(stream(), "e", "ts", "v", "id", delay="30 days"), root, "update", R.keep_changed(root, ["e", "start"], F.to_date("start")))
        kept.append(set(V.read_view(spark, root).inputFiles()))
    want = R.tumbling_last(frame(data), "e", "ts", "v", "id")
    assert rows(V.read_view(spark, root)) == rows(want)
    assert {f for f in kept[1] if "1970-01-03" not in f} <= kept[2] and len(kept[1] & kept[2]) > 0


def test_a_stream_that_goes_on_and_a_new_one(spark, root, tmp_path):
    """A query counts its batches on after a stop; one with a checkpoint of its own begins at 0 and is heard all the same."""
    def run(name, rows):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        stream = spark.readStream.schema(KINDS).parquet(str(tmp_path / name))
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / f"{name}-checkpoint")).trigger(availableNow=True)
        q.foreachBatch(R.keep_latest(root, "station_id", "at", buckets=2)).start().awaitTermination()

    run("a", [(1, "d", 1, 10)])
    run("a", [(2, "d", 1, 20)])
    run("b", [(3, "d", 1, 30), (1, "d", 2, 11)])
    run("a", [(4, "d", 1, 40)])
    assert [r[0::3] for r in rows(V.read_view(spark, root))] == [(1, 11), (2, 20), (3, 30), (4, 40)]
    assert sorted(V.current(spark, root).batches.values()) == [0, 2]
