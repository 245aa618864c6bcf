"""Readers and writers: event envelopes, snapshots, CSV and JSON files, partitioned outputs."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.functions import scalars as S
from tramline.functions import timefn as T

#: The keys of an event envelope and of a bike-stock payload.
ENVELOPE = ("event_id", "source", "entity_id", "source_generated_at", "ingested_at", "poll_run_at", "payload")
STOCK = ("stationId", "stationName", "rackTotCnt", "parkingBikeTotCnt", "shared", "stationLatitude", "stationLongitude")
#: Columns of a source that are 0 by its specification where they are blank.
ZERO_WEATHER = ("rain", "snow")


def read_snapshots(spark: SparkSession, root: str, day: str | None = None) -> DataFrame:
    """The event log under ``root`` (dt=, hh=), one day of it if given: other partitions are not listed into the scan."""
    df = spark.read.parquet(root)
    return df if day is None else df.where(F.col("dt") == day)


def read_mixed_schema(spark: SparkSession, root: str) -> DataFrame:
    """station_id, stock, racks, collected_at from a folder of envelope and flat files.

    Rows whose entity differs from the payload's id go, a blank entity takes it, rows without stock go."""
    df = spark.read.option("mergeSchema", "true").parquet(root)
    have = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    p = lambda k: F.get_json_object(have("payload_json"), f"$.{k}")
    boxed = have("payload_json").isNotNull()
    entity = S.optional_str(have("entity_id"))
    wrong = boxed & entity.isNotNull() & p("stationId").isNotNull() & (entity != p("stationId"))
    out = df.where(~F.coalesce(wrong, F.lit(False))).select(
        F.when(boxed, F.coalesce(entity, p("stationId"))).otherwise(have("stationId")).alias("station_id"),
        F.when(boxed, p("parkingBikeTotCnt")).otherwise(have("parkingBikeTotCnt")).try_cast("int").alias("stock"),
        F.when(boxed, p("rackTotCnt")).otherwise(have("rackTotCnt")).try_cast("double").alias("racks"),
        F.when(boxed, have("ingested_at")).otherwise(have("collected_at")).alias("collected_at"),
    )
    return out.where("station_id IS NOT NULL AND stock IS NOT NULL")


def parse_envelope(df: DataFrame, raw: str = "value") -> tuple[DataFrame, DataFrame]:
    """Envelopes of JSON strings, and what is none with a reason (broken_json, missing_key, blank_id, bad_time).

    All keys must be there, ids not blank, times ISO; a time without zone is of the session's zone."""
    m = F.from_json(F.col(raw), "map<string,string>")
    at = lambda k: F.try_to_timestamp(F.try_element_at(F.col("_m"), F.lit(k)))
    v = lambda k: F.try_element_at(F.col("_m"), F.lit(k))
    keys = F.size(F.array_intersect(F.map_keys("_m"), F.array(*map(F.lit, ENVELOPE)))) == len(ENVELOPE)
    blank = F.lit(False)
    for k in ("event_id", "source", "entity_id"):
        blank = blank | F.coalesce(F.trim(v(k)) == "", F.lit(True))
    times = [at(k) for k in ("source_generated_at", "ingested_at", "poll_run_at")]
    bad_time = times[0].isNull() | times[1].isNull() | times[2].isNull()
    reason = F.when(F.col("_m").isNull() | (F.size("_m") == 0), "broken_json").when(~keys, "missing_key").when(blank, "blank_id").when(bad_time, "bad_time")
    tagged = df.withColumn("_m", m).withColumn("reason", reason)
    good = tagged.where("reason IS NULL").select(v("event_id").alias("event_id"), v("source").alias("source"), v("entity_id").alias("entity_id"), *[t.alias(k) for t, k in zip(times, ("source_generated_at", "ingested_at", "poll_run_at"), strict=True)], v("payload").alias("payload_json"))
    return good, tagged.where("reason IS NOT NULL").select(raw, "reason")


def stock_payload(env: DataFrame, strict: bool = True) -> DataFrame:
    """Bike stock of envelopes. ``strict`` needs all payload keys and an id that is the entity's; else a stock is enough."""
    m = env.withColumn("_m", F.from_json("payload_json", "map<string,string>"))
    v = lambda k: F.try_element_at(F.col("_m"), F.lit(k))
    if strict:
        m = m.where((F.size(F.array_intersect(F.map_keys("_m"), F.array(*map(F.lit, STOCK)))) == len(STOCK)) & (v("stationId") == F.col("entity_id")))
    out = m.select(v("stationId").alias("station_id"), v("stationName").alias("name"), v("parkingBikeTotCnt").try_cast("int").alias("stock"), v("rackTotCnt").try_cast("double").alias("racks"), F.col("ingested_at").alias("collected_at"), F.lit("bike.stock").alias("source"))
    return out if strict else out.where("stock IS NOT NULL")


def weather_payload(env: DataFrame) -> DataFrame:
    """Observed or forecast values by which value key the payload has; neither or both is none. The time collected is
    the poll's, else the ingest's."""
    names = ("baseDate", "baseTime", "fcstDate", "fcstTime", "category", "nx", "ny", "obsrValue", "fcstValue")
    # one parse a payload, and of times one each
    rows = env.select(F.coalesce("poll_run_at", "ingested_at").alias("collected_at"), F.json_tuple("payload_json", *names).alias(*names))
    observed = F.col("obsrValue").isNotNull()
    rows = rows.where(observed != F.col("fcstValue").isNotNull()).withColumn("base_time", T.weather_time(F.col("baseDate"), F.col("baseTime")))
    valid = F.when(observed, F.col("base_time")).otherwise(T.weather_time(F.col("fcstDate"), F.col("fcstTime")))
    return rows.select(F.when(observed, "observed").otherwise("forecast").alias("source"), "base_time", valid.alias("valid_time"), F.col("nx").try_cast("int").alias("nx"), F.col("ny").try_cast("int").alias("ny"), "category", S.weather_value(F.coalesce("obsrValue", "fcstValue")).alias("value"), "collected_at")


def weather_pivot(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One row for each source, times and place, a column a category: the value collected last."""
    keys = ["source", "base_time", "valid_time", "nx", "ny"]
    of = lambda k, c: F.when(F.col("category") == k, F.col(c))
    # what is of another category has no time in a category's column, so it is not its last; rows without a key have no place
    last = [F.max_by(of(k, "value"), of(k, "collected_at")).alias(k) for k in categories]
    return rows.dropna(subset=keys).groupBy(*keys).agg(*last, F.max("collected_at").alias("collected_at"))


def arrival_payload(env: DataFrame) -> DataFrame:
    """Subway arrivals: station, line, train, seconds to go, message and times."""
    v = lambda k: F.get_json_object("payload_json", f"$.{k}")
    return env.select(F.col("entity_id").alias("station"), v("subwayId").alias("line"), v("updnLine").alias("direction"), v("btrainNo").alias("train_no"), v("barvlDt").try_cast("int").alias("seconds"), v("arvlMsg2").alias("message"), v("arvlMsg3").alias("message_station"), F.col("poll_run_at"), F.try_to_timestamp(v("recptnDt")).alias("generated_at"), F.col("ingested_at").alias("received_at"))


def kafka_source(spark: SparkSession, servers: str, topics: Sequence[str], options: Mapping[str, str] | None = None) -> DataFrame:
    """Several topics as one stream from the earliest offset; offsets are kept by the query's checkpoint."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest")
    return r.options(**(options or {})).load().select(F.col("value").cast("string"), "topic", "partition", "offset")


def read_rental_csv(spark: SparkSession, groups: Mapping[str, Sequence[str]], encoding: str = "UTF-8") -> DataFrame:
    """Headered CSV files by path pattern and their column names (files of one width a pattern); a trailing blank column
    is dropped, and the tables are put together by name."""
    out = None
    for path, names in groups.items():
        df = spark.read.option("header", "true").option("encoding", encoding).csv(path)
        df = df.select(*df.columns[: len(names)]).toDF(*names)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_json_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Files that are each a JSON array of objects."""
    return spark.read.option("multiLine", "true").json(path)


def read_hourly_weather(spark: SparkSession, path: str, schema: str, zero: Sequence[str] = ZERO_WEATHER) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path).fillna(0.0, list(zero))


def read_hourly_stock(spark: SparkSession, path: str, schema: str, columns: Sequence[str], first: Column, last: Column, date: str = "date") -> DataFrame:
    """The named columns of the days in [first, last]."""
    return spark.read.option("header", "true").schema(schema).csv(path).select(*columns).where(F.col(date).between(first, last))


def with_partitions(df: DataFrame) -> DataFrame:
    """dt and hh of the poll, else of the ingest."""
    at = F.coalesce("poll_run_at", "ingested_at")
    return df.withColumns({"dt": F.date_format(at, "yyyy-MM-dd"), "hh": F.date_format(at, "HH")})


def write_event_log(stream: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, object] | None = None):
    """Starts the log: Parquet under topic, day and hour; files appear once a batch is committed."""
    return with_partitions(stream).writeStream.format("parquet").partitionBy("topic", "dt", "hh").option("checkpointLocation", checkpoint).option("path", path).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def overwrite_day(df: DataFrame, path: str, partition: str = "dt") -> None:
    """Replaces the days that ``df`` has; the others stay, and running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def link_export(df: DataFrame, slot: str = "time_slot_30min") -> DataFrame:
    """Link rows with the slot as a number 0-47."""
    return df.withColumn("slot", (F.substring(slot, 1, 2).cast("int") * 2 + F.floor(F.substring(slot, 4, 2).cast("int") / 30)).cast("int")).drop(slot)


def write_link_export(df: DataFrame, path: str, slot: str = "time_slot_30min") -> None:
    """CSV with a header, and beside it one line of JSON with rows and columns."""
    out = link_export(df, slot)
    out.write.mode("overwrite").option("header", "true").csv(path)
    rows = df.sparkSession.read.option("header", "true").csv(path).count()
    df.sparkSession.createDataFrame([(json.dumps({"rows": rows, "columns": out.columns}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-meta")
