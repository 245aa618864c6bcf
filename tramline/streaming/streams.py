"""Live feeds as Structured Streaming: each stream has the same result as its batch twin over what has come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from tramline.functions import scalars as S
from tramline.functions import timefn as T
from tramline.sources.io import parse_envelope
from tramline.sources.view import merge_into


def run_available(stream: DataFrame, path: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None):
    """Runs a stream over all that is there and waits. Append writes Parquet with exactly-once files; the other modes,
    and ``each``, go through batches that overwrite the table (each batch holds the whole result)."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True)
    if each is None and mode == "append":
        q = w.format("parquet").option("path", path).start()
    else:
        q = w.foreachBatch(each or (lambda df, _: df.write.mode("overwrite").parquet(path))).start()
    q.awaitTermination()
    return q


def quarantine(stream: DataFrame, good_path: str, bad_path: str, raw: str = "value") -> Callable[[DataFrame, int], None]:
    """A batch function: good envelopes to one table, poison messages with their reason to another; no message stops
    the feed. Batches are written under their id, so a batch that runs again replaces itself."""

    def each(df: DataFrame, batch: int) -> None:
        df = df.persist()
        good, bad = parse_envelope(df, raw)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch}")
        bad.write.mode("overwrite").parquet(f"{bad_path}/batch={batch}")
        df.unpersist()

    return each


def dedup_events(stream: DataFrame, at: str, key: str = "event_id", delay: str = "1 hour") -> DataFrame:
    """The first of the events of one id within the delay; state is dropped behind the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def latest_stock(stream: DataFrame, entity: str, at: str, values: list[str], tie: str) -> DataFrame:
    """The newest row of each entity (update or complete mode); older ones that come late change nothing."""
    newest = F.max_by(F.struct(at, *values), F.struct(at, tie)).alias("_v")
    return stream.groupBy(entity).agg(newest).select(entity, F.col("_v")[at].alias(at), *[F.col("_v")[v].alias(v) for v in values])


def within_ttl(latest: DataFrame, at: str, ttl: str = "30 minutes") -> DataFrame:
    newest = latest.agg(F.max(at).alias("_n"))
    return latest.crossJoin(F.broadcast(newest)).where(F.col(at) >= F.col("_n") - F.expr(f"INTERVAL {ttl}")).drop("_n")


def merge_latest_issue(stored: DataFrame | None, batch: DataFrame, series: list[str], issued: str, valid: str, tie: str) -> DataFrame:
    """The stored view with a batch merged in: of each series all horizons of the newest issue, the newest row of each."""
    from tramline.operators.stock import latest_issue

    return latest_issue(batch if stored is None else stored.unionByName(batch), series, issued, valid, tie)


def paired_observation(rows: DataFrame, place: list[str], at: str, category: str, value: str, pair: tuple[str, str]) -> DataFrame:
    """For each place the newest time that has both measures, and those."""
    wide = rows.groupBy(*place, at).pivot(category, list(pair)).agg(F.max(value)).where(F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull())
    return wide.groupBy(*place).agg(F.max_by(F.struct(at, *pair), at).alias("_v")).select(*place, F.col("_v")[at].alias(at), *[F.col("_v")[p].alias(p) for p in pair])


def arrival_board(rows: DataFrame, station: str = "station", run: str = "poll_run_at", train: str = "train_no", tie: str = "received_at") -> DataFrame:
    """Per station the trains of the newest poll run: older runs are dropped, rows of an equal run merge, a train stands
    once (its last row). Also right over a stored board joined with a batch."""
    newest = rows.withColumn("_m", F.max(run).over(Window.partitionBy(station))).where(F.col(run) == F.col("_m")).drop("_m")
    w = Window.partitionBy(station, train).orderBy(F.col(tie).desc())
    return newest.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def tumbling_last(stream: DataFrame, entity: str, at: str, value: str, tie: str, width: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Last value of each entity and window, and how many rows it has."""
    return stream.withWatermark(at, delay).groupBy(entity, F.window(at, width).alias("w")).agg(F.max_by(value, F.struct(at, tie)).alias(value), F.count(F.lit(1)).alias("n")).select(entity, F.col("w.start").alias("start"), value, "n")


def session_runs(stream: DataFrame, entity: str, at: str, gap: str = "20 minutes", delay: str = "1 hour") -> DataFrame:
    """Runs of rows with no gap over ``gap``: begin, end of the last row's gap, rows."""
    return stream.withWatermark(at, delay).groupBy(entity, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(entity, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def feed_status(rows: DataFrame, at: str, now: Column, begin: int, end: int, stale_seconds: int = 180) -> DataFrame:
    """ok, outside (of the operating window) or stale, by the newest event."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.max(at))
    status = F.when(~T.in_operating_window(T.minute_of_day(now), begin, end), "outside").when(age <= stale_seconds, "ok").otherwise("stale")
    return rows.agg(status.alias("status"), age.alias("age_seconds"))


def consumer_status(rows: DataFrame, ok: Column, topic: str = "topic", partition: str = "partition", offset: str = "offset") -> DataFrame:
    """Saved and failed rows and the next offset by topic and partition."""
    return rows.groupBy(topic, partition).agg(F.count_if(ok).alias("saved"), F.count_if(~ok).alias("failed"), (F.max(offset) + 1).alias("next_offset"))


def history_upsert(stored: DataFrame | None, batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Per key the last row of the stored days and the batch."""
    rows = batch if stored is None else stored.unionByName(batch)
    w = Window.partitionBy(*keys).orderBy(F.col(at).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_history(root: str, keys: list[str], at: str, day: str) -> Callable[[DataFrame, int], None]:
    """A batch function that puts rows into the stored history at ``root``, by ``history_upsert``: only the days of the batch are read and
    written again, whole or not at all, and a batch that runs twice changes nothing. ``keys`` hold the day."""

    def each(batch: DataFrame, number: int) -> None:
        merge_into(root, batch, F.col(day), lambda stored, new: history_upsert(stored, new, keys, at), number)

    return each


def keep_latest_issue(root: str, series: list[str], issued: str, valid: str, tie: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """The same for the view of newest issues (``merge_latest_issue``), by ``buckets`` buckets of the series."""

    def each(batch: DataFrame, number: int) -> None:
        part = F.pmod(F.xxhash64(*series), F.lit(buckets))
        merge_into(root, batch, part, lambda stored, new: merge_latest_issue(stored, new, series, issued, valid, tie), number)

    return each


def keep_latest(root: str, entity: str, at: str, tie: str | None = None, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """The same for the newest row of each entity; of equal times the row of the higher ``tie``, else the one that came last."""

    def each(batch: DataFrame, number: int) -> None:
        def merge(stored: DataFrame | None, new: DataFrame) -> DataFrame:
            rows = new.withColumn("_new", F.lit(1))
            rows = rows if stored is None else stored.withColumn("_new", F.lit(0)).unionByName(rows)
            w = Window.partitionBy(entity).orderBy(F.col(at).desc(), *([F.col(tie).desc()] if tie else []), F.col("_new").desc())
            return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")

        merge_into(root, batch, F.pmod(F.xxhash64(entity), F.lit(buckets)), merge, number)

    return each


def keep_changed(root: str, keys: list[str], part: Column) -> Callable[[DataFrame, int], None]:
    """A batch function for update mode: the rows of a batch take the place of stored rows of equal ``keys``; only the partitions
    of ``part`` that changed are written again."""

    def each(batch: DataFrame, number: int) -> None:
        merge_into(root, batch, part, lambda stored, new: new if stored is None else stored.join(new.select(*keys), keys, "left_anti").unionByName(new), number)

    return each


COOLED = "entity string, ts long, fired boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Cooldown(StatefulProcessor):
    """Rows wait in the state until the watermark has passed them and are then read in order of time, so a row that comes
    late, but within the delay, is where it belongs. A timer wakes an entity at its earliest waiting row; once it is
    silent for ``seconds`` after its last firing, nothing that comes can hang on it and its state goes.

    Calls to the state are what an entity costs: the rows of a batch are one entry, and no timer is looked for or taken
    back, since one that finds nothing due changes nothing."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last long")
        self.waiting = handle.getListState("waiting", "ts array<bigint>, on array<boolean>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ts, on = zip(*((r["ts"], r["on"]) for r in rows), strict=True)
        self.waiting.appendValue((list(ts), list(on)))
        self.handle.registerTimer(1000 * min(ts))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted((t, on) for pack in self.waiting.get() for t, on in zip(*pack, strict=True)) if self.waiting.exists() else []
        due = [r for r in rows if 1000 * r[0] <= now]
        before = self.last.get()
        last = before = before[0] if before is not None else None
        fired = []
        for t, on in due:
            fire = on and (last is None or t - last >= self.seconds)
            last = t if fire else last
            fired.append(fire)
        rest = rows[len(due) :]
        if due and rest:
            self.waiting.put([tuple(list(c) for c in zip(*rest, strict=True))])
        elif due:
            self.waiting.clear()
        over = last is None or 1000 * (last + self.seconds) <= now
        if not over and last != before:
            self.last.update((last,))
        elif over and before is not None:
            self.last.clear()
        if rest:
            self.handle.registerTimer(1000 * rest[0][0])
        elif not over:
            self.handle.registerTimer(1000 * (last + self.seconds))
        return (Row(entity=key[0], ts=t, fired=fire) for (t, _), fire in zip(due, fired, strict=True))

    def close(self) -> None:
        pass


def cooldown_stream(stream: DataFrame, entity: str, at: str, trigger: str, seconds: int = 600, delay: str = "10 minutes") -> DataFrame:
    """Triggers of each entity that fire: after one, others are silent for ``seconds``; what ``cooldown_batch`` gives for the same
    rows, in whatever order and batches they come within ``delay``. Rows come out once the watermark has passed them, those behind
    it are dropped. ``at`` is a timestamp, read in whole seconds; rows without one or without an entity have no place in the order and go.

    Start it with ``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``."""
    keyed = stream.where(F.col(at).isNotNull() & F.col(entity).isNotNull()).withWatermark(at, delay)
    keyed = keyed.select(F.col(entity).cast("string").alias("entity"), F.col(at).alias("_at"), F.unix_timestamp(at).alias("ts"), F.coalesce(F.col(trigger), F.lit(False)).alias("on"))
    return keyed.groupBy("entity").transformWithState(Cooldown(seconds), COOLED, "append", "EventTime")


def cooldown_batch(df: DataFrame, entity: str, ts: str, trigger: str, seconds: int = 600) -> DataFrame:
    """The batch twin: which readings fire, with ``seconds`` at least between the firings of an entity.

    Only readings that trigger can fire. One that comes ``seconds`` or more after the trigger before it always does, so
    triggers fall into runs that do not hang on one another, and an entity is not one group. Runs begin where a bucket of
    ``seconds`` lies far enough behind the last one with a trigger, so only buckets are ordered by entity. The runs are
    then read in order of time, with the last firing as the only state. A reading without a time never fires."""
    width = max(seconds, 1)
    rows = df.select(F.col(entity).cast("string").alias("entity"), F.col(ts).cast("long").alias("ts"), F.coalesce(F.col(trigger), F.lit(False)).alias("_on"))
    can = F.col("_on") & F.col("ts").isNotNull()
    hot = rows.where(can).select("entity", "ts", F.floor(F.col("ts") / width).alias("_b"))
    w = Window.partitionBy("entity").orderBy("_b")
    buckets = hot.groupBy("entity", "_b").agg(F.min("ts").alias("_low"), F.max("ts").alias("_high"))
    buckets = buckets.withColumn("_new", F.coalesce(F.col("_low") - F.lag("_high").over(w) >= width, F.lit(True)).cast("long"))
    runs = buckets.select(F.col("entity").alias("_e"), F.col("_b").alias("_c"), F.sum("_new").over(w).alias("_run"))
    dealt = hot.join(runs, F.col("entity").eqNullSafe(F.col("_e")) & (F.col("_b") == F.col("_c"))).select("entity", "_run", "ts")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = None, None
        for pdf in batches:
            fires = []
            for run, t in zip(zip(pdf["entity"], pdf["_run"], strict=True), pdf["ts"], strict=True):
                if run != here:
                    here, last = run, None
                fire = last is None or t - last >= seconds
                last = t if fire else last
                fires.append(fire)
            yield pd.DataFrame({"entity": pdf["entity"], "ts": pdf["ts"], "fired": fires})

    walked = dealt.repartition("entity", "_run").sortWithinPartitions("entity", "_run", "ts").mapInPandas(walk, COOLED)
    return walked.union(rows.where(~can).select("entity", "ts", F.lit(False).alias("fired")))


def batch_latency(rows: DataFrame, produced: str, received: str, keys: list[str]) -> DataFrame:
    """Latency of a batch in milliseconds; negative ones do not count."""
    from tramline.operators.network import latency_stats

    ms = lambda c: F.unix_millis(F.col(c))
    return latency_stats(rows.withColumn("latency", ms(received) - ms(produced)), keys, "latency")


def keep_latency(root: str, keys: list[str], day: str, produced: str, received: str) -> Callable[[DataFrame, int], None]:
    """A batch function that merges a batch's latencies (ms) into the stored partials of its days, one row a day and key."""
    from tramline.operators import network as N

    def each(batch: DataFrame, number: int) -> None:
        ms = lambda c: F.unix_millis(F.col(c))
        of = [day, *keys]
        partials = N.latency_partials(batch.withColumn("_latency", ms(received) - ms(produced)), of, "_latency")
        merge_into(root, partials, F.col(day), lambda stored, new: new if stored is None else N.merged_latency(stored.unionByName(new), of), number)

    return each


def file_stream(spark: SparkSession, folder: str, name: str, at: str = "ts") -> DataFrame:
    """A table of a folder as a stream; a time without zone becomes an instant, as watermarks need."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return s.withColumn(at, F.col(at).cast("timestamp"))


def eta(rows: DataFrame) -> DataFrame:
    """Arrival rows with their expected time (null where it cannot be)."""
    return rows.withColumn("eta", S.arrival_eta(F.col("seconds"), F.col("generated_at"), F.col("received_at"), F.col("message_station"), F.col("station")))
