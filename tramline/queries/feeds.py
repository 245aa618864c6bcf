"""Queries of sources and streams: streams run over what is there and give what their batch twins give."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators import stock as S
from tramline.queries.base import query, read, v_stock
from tramline.scratch import new_folder
from tramline.sources import io, replay, view
from tramline.streaming import streams as R


def place(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def events(spark: SparkSession, d: str) -> DataFrame:
    return R.file_stream(spark, d, "events.parquet")


def envelopes(df: DataFrame) -> DataFrame:
    """Events as envelope JSON, with every seventh broken in one of four ways."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    payload = F.to_json(F.struct(F.col("user_id").cast("string").alias("stationId"), F.lit("n").alias("stationName"), F.lit("100").alias("rackTotCnt"), F.floor("value").cast("string").alias("parkingBikeTotCnt"), F.lit("0").alias("shared"), F.lit("37.5").alias("stationLatitude"), F.lit("127.0").alias("stationLongitude")))
    k = F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 4)
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.when(k == 1, " ").otherwise("bike").alias("source"), F.col("user_id").cast("string").alias("entity_id"), F.when(k == 2, "yesterday").otherwise(at).alias("source_generated_at"), at.alias("ingested_at"), F.when(F.coalesce(k, F.lit(0)) != 3, at).alias("poll_run_at"), payload.alias("payload")))
    return df.select("event_id", F.when(k == 0, F.lit("{broken")).otherwise(good).alias("value"), F.lit("bike.stock").alias("topic"), (F.col("event_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"))


BAD = "event_id % 7 = 0"


@query(f"SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS entity_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE NOT ({BAD})")
def src03_parse_envelope(spark, d):
    good, _ = io.parse_envelope(envelopes(read(spark, d, "events")))
    return good.select("event_id", "entity_id", F.unix_timestamp("ingested_at").alias("at"))


@query(f"SELECT CASE event_id % 4 WHEN 0 THEN 'broken_json' WHEN 1 THEN 'blank_id' WHEN 2 THEN 'bad_time' ELSE 'missing_key' END AS reason, count(*) AS n FROM events WHERE {BAD} GROUP BY 1")
def src03_quarantined(spark, d):
    return io.parse_envelope(envelopes(read(spark, d, "events")))[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT user_id::VARCHAR AS station_id, CAST(floor(value) AS INTEGER) AS stock, 100.0::DOUBLE AS racks, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE NOT ({BAD})")
def src04_stock_payload(spark, d):
    good, _ = io.parse_envelope(envelopes(read(spark, d, "events")))
    return io.stock_payload(good).select("station_id", "stock", "racks", F.unix_timestamp("collected_at").alias("at"))


@query("SELECT station_id, stock FROM v_stock WHERE date = DATE '2024-01-03'")
def src01_read_snapshots(spark, d):
    root = place(spark)
    v_stock(spark, d).select("station_id", "stock", F.col("date").cast("string").alias("dt")).repartition("dt").write.partitionBy("dt").parquet(root)
    return io.read_snapshots(spark, root, "2024-01-03").select("station_id", "stock")


@query("SELECT CAST(date AS VARCHAR) AS dt, count(*) AS n, CAST(sum(CASE WHEN date = DATE '2024-01-03' THEN -1 ELSE stock END) AS BIGINT) AS total FROM v_stock GROUP BY 1")
def snk02_overwrite_day(spark, d):
    root = place(spark)
    s = v_stock(spark, d).select("station_id", "stock", F.col("date").cast("string").alias("dt")).repartition("dt")
    io.overwrite_day(s, root)
    for _ in range(2):
        io.overwrite_day(s.where("dt = '2024-01-03'").withColumn("stock", F.lit(-1)), root)
    out = spark.read.parquet(root).groupBy(F.col("dt").cast("string").alias("dt")).agg(F.count(F.lit(1)).alias("n"), F.sum("stock").alias("total"))
    return out


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS dt, CAST(hour(ts) AS INTEGER) AS hh, count(*) AS n FROM events WHERE NOT ({BAD}) GROUP BY 1, 2")
def snk01_event_log(spark, d):
    path = place(spark)
    raw = envelopes(events(spark, d))
    good, _ = io.parse_envelope(raw)
    io.write_event_log(good.withColumn("topic", F.lit("bike.stock")), path, f"{path}-checkpoint", {"availableNow": True}).awaitTermination()
    return spark.read.parquet(path).groupBy(F.col("dt").cast("string").alias("dt"), F.col("hh").cast("int").alias("hh")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def str01_ingest(spark, d):
    path = place(spark)
    R.run_available(events(spark, d), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query(f"SELECT 'good' AS kind, count(*) AS n FROM events WHERE NOT ({BAD}) UNION ALL SELECT 'bad', count(*) FROM events WHERE {BAD}")
def str02_quarantine(spark, d):
    path = place(spark)
    raw = envelopes(events(spark, d)).select("value")
    R.run_available(raw, path, each=R.quarantine(raw, f"{path}/good", f"{path}/bad"))
    n = lambda kind: spark.read.parquet(f"{path}/{kind}").agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n("good").union(n("bad"))


@query("SELECT event_id, user_id FROM events")
def str03_dedup_events(spark, d):
    path = place(spark)
    twice = events(spark, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    R.run_available(R.dedup_events(twice, "ts").select("event_id", "user_id"), path)
    return spark.read.parquet(path)


@query("SELECT user_id, arg_max(value, event_id) AS value FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY 1")
def str04_latest_stock(spark, d):
    path = place(spark)
    R.run_available(R.latest_stock(events(spark, d), "user_id", "ts", ["value"], "event_id"), path, "update", R.keep_latest(path, "user_id", "ts"))
    return view.read_view(spark, path).select("user_id", "value")


@query("SELECT event_id, station_id, horizon FROM (SELECT *, event_id % 4 AS horizon FROM v_stock QUALIFY date = max(date) OVER (PARTITION BY station_id)) QUALIFY row_number() OVER (PARTITION BY station_id, horizon ORDER BY event_id DESC) = 1")
def str05_latest_weather(spark, d):
    s = v_stock(spark, d).select("event_id", "station_id", (F.col("event_id") % 4).alias("horizon"), "date")
    path = place(spark)
    each = R.keep_latest_issue(path, ["station_id"], "date", "horizon", "event_id")
    # the second batch runs twice
    for number, part in ((0, 0), (1, 2), (1, 2), (2, 1)):
        each(s.where(F.col("event_id") % 3 == part), number)
    return view.read_view(spark, path).select("event_id", "station_id", "horizon")


@query("SELECT user_id, max(day) AS day, arg_max(v, day) AS view, arg_max(c, day) AS click FROM (SELECT user_id, CAST(ts AS DATE) AS day, max(value) FILTER (WHERE event_type = 'view') AS v, max(value) FILTER (WHERE event_type = 'click') AS c FROM events GROUP BY 1, 2) WHERE v IS NOT NULL AND c IS NOT NULL GROUP BY 1")
def str06_paired_observation(spark, d):
    e = read(spark, d, "events").withColumn("day", F.col("ts").cast("date"))
    return R.paired_observation(e, ["user_id"], "day", "event_type", "value", ("view", "click"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, CAST(ts AS DATE) AS run FROM events QUALIFY run = max(run) OVER (PARTITION BY user_id)) QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def str07_arrival_board(spark, d):
    e = read(spark, d, "events").withColumn("run", F.col("ts").cast("date"))
    board = R.arrival_board(e.where("event_id % 2 = 0"), "user_id", "run", "event_type", "event_id")
    # a second batch meets the stored board
    return R.arrival_board(board.unionByName(e.where("event_id % 2 = 1")), "user_id", "run", "event_type", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT user_id, CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS start, arg_max(value, event_id) AS value, count(*) AS n FROM events GROUP BY 1, 2")
def str08_tumbling(spark, d):
    path = place(spark)
    windows = R.tumbling_last(events(spark, d), "user_id", "ts", "value", "event_id")
    R.run_available(windows, path, "update", R.keep_changed(path, ["user_id", "start"], F.to_date("start")))
    return view.read_view(spark, path).withColumn("start", F.unix_timestamp("start"))


@query("WITH s AS (SELECT *, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 20 MINUTE AS INTEGER), 1) AS new FROM events), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM s) SELECT user_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n FROM r GROUP BY user_id, run")
def str09_sessions(spark, d):
    path = place(spark)
    R.run_available(R.session_runs(events(spark, d), "user_id", "ts"), path, "complete")
    return spark.read.parquet(path).select("user_id", F.unix_timestamp("start").alias("start"), "n")


@query("SELECT CASE WHEN epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) <= 180 THEN 'ok' ELSE 'stale' END AS status, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) AS BIGINT) AS age_seconds FROM events")
def str10_feed_status(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return R.feed_status(e, "ts", F.lit("2024-01-31 00:00:00").cast("timestamp"), 330, 60)


@query("WITH l AS (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) - 20000 AS v FROM events) SELECT event_type, min(v) AS least, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS most, count(*) AS n FROM l WHERE v >= 0 GROUP BY 1")
def str11_latency(spark, d):
    e = read(spark, d, "events").select("event_type", F.timestamp_millis(F.col("event_id")).alias("produced"), F.timestamp_millis(F.col("event_id") + F.floor(F.col("value") * 1000) - 20000).alias("received"))
    return R.batch_latency(e, "produced", "received", ["event_type"])


#: Each partial's p50 and p95 against all latencies: the share of rows below and up to it must hold the wanted one, within the sketch's error.
@query("SELECT event_type, count(*) AS n, min(v) AS least, max(v) AS most, true AS p50_right, true AS p95_right FROM (SELECT event_type, CAST(floor(value * 1000) AS BIGINT) - 20000 AS v FROM events) WHERE v >= 0 GROUP BY 1")
def str11_latency_partials(spark, d):
    from tramline.operators.network import SKETCH_ERROR, latency_from_partials

    path = place(spark)
    ms = F.floor(F.col("value") * 1000) - 20000
    e = read(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("date").alias("day"), F.timestamp_millis(F.col("event_id")).alias("produced"), F.timestamp_millis(F.col("event_id") + ms).alias("received"))
    each = R.keep_latency(path, ["event_type"], "day", "produced", "received")
    for number in range(3):
        each(e.where(F.col("event_id") % 3 == number), number)
    stats = latency_from_partials(view.read_view(spark, path), ["event_type"])
    rows = e.select("event_type", (F.unix_millis("received") - F.unix_millis("produced")).alias("v")).where("v >= 0")
    at = lambda p, op: F.count_if(op(F.col("v"), F.col(p))) / F.count(F.lit(1))
    shares = rows.join(stats, "event_type").groupBy("event_type").agg(*[at(p, op).alias(f"{p}_{name}") for p in ("p50", "p95") for name, op in (("under", lambda a, b: a < b), ("upto", lambda a, b: a <= b))])
    right = lambda p, share: (F.col(f"{p}_under") <= share + SKETCH_ERROR) & (F.col(f"{p}_upto") >= share - SKETCH_ERROR)
    return stats.join(shares, "event_type").select("event_type", "n", "least", "most", right("p50", 0.5).alias("p50_right"), right("p95", 0.95).alias("p95_right"))


def readings(df: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return df.select("user_id", ts.alias("ts"), F.unix_timestamp(ts).alias("sec"), (F.col("value") > 10).alias("hot"))


@contextmanager
def rocksdb(spark: SparkSession):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, R.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def fired(df: DataFrame) -> DataFrame:
    return df.groupBy("entity").agg(F.count_if("fired").alias("fired"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("fired"), F.col("ts"))).alias("at"))


TWIN = """WITH RECURSIVE r AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec, value > 10 AS hot, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), value > 10) AS i FROM events),
    f(user_id, i, sec, last, fire) AS (SELECT user_id, i, sec, CASE WHEN hot THEN sec END, hot FROM r WHERE i = 1
    UNION ALL SELECT r.user_id, r.i, r.sec, CASE WHEN r.hot AND (f.last IS NULL OR r.sec - f.last >= 86400) THEN r.sec ELSE f.last END, r.hot AND (f.last IS NULL OR r.sec - f.last >= 86400) FROM f JOIN r ON r.user_id = f.user_id AND r.i = f.i + 1)
    SELECT CAST(user_id AS VARCHAR) AS entity, CAST(count_if(fire) AS BIGINT) AS fired, count(*) AS n, CAST(sum(CASE WHEN fire THEN sec END) AS BIGINT) AS at FROM f GROUP BY 1"""


@query(TWIN)
def str12_cooldown(spark, d):
    path = place(spark)
    e = readings(read(spark, d, "events"))
    # a row of no entity, long after all, takes the watermark past them
    beat = e.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("bigint").alias("user_id"), (F.col("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts"), F.lit(0).cast("bigint").alias("sec"), F.lit(False).alias("hot"))
    e.write.parquet(f"{path}/in/rows")
    beat.where("ts IS NOT NULL").write.parquet(f"{path}/in/beat")
    with rocksdb(spark):
        stream = spark.readStream.schema(e.schema).parquet(f"{path}/in/*")
        R.run_available(R.cooldown_stream(stream, "user_id", "ts", "hot", 86400), f"{path}/out")
    return fired(spark.read.parquet(f"{path}/out").where("entity <> '-1'"))


@query(TWIN)
def str12_cooldown_batch(spark, d):
    return fired(R.cooldown_batch(readings(read(spark, d, "events")), "user_id", "sec", "hot", 86400))


@query("SELECT station_id, date, arg_max(stock, event_id) AS stock FROM v_stock GROUP BY 1, 2")
def str13_history_upsert(spark, d):
    s = v_stock(spark, d).select("station_id", "date", "event_id", "stock")
    path = place(spark)
    each = R.keep_history(path, ["station_id", "date"], "event_id", "date")
    # the second batch runs twice
    for number, half in ((0, 1), (1, 0), (1, 0)):
        each(s.where(F.col("event_id") % 2 == half), number)
    return view.read_view(spark, path).drop("event_id")


@query("SELECT 'bike.stock' AS topic, CAST(event_id % 3 AS INTEGER) AS partition, CAST(count_if(event_id % 7 <> 0) AS BIGINT) AS saved, CAST(count_if(event_id % 7 = 0) AS BIGINT) AS failed, max(event_id) + 1 AS next_offset FROM events GROUP BY 1, 2")
def str14_consumer_status(spark, d):
    return R.consumer_status(envelopes(read(spark, d, "events")), F.col("event_id") % 7 != 0)


@query("SELECT 'bike.stock' AS topic, CAST(event_id % 3 AS INTEGER) AS partition, 0::BIGINT AS first_offset, count(*) AS next_offset, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS keys, 0::BIGINT AS lag FROM events GROUP BY 2")
def src07_replay(spark, d):
    root, path = place(spark), place(spark)
    e = read(spark, d, "events")
    rows = envelopes(e).join(e.select("event_id", F.col("ts").cast("timestamp").alias("timestamp")), "event_id").withColumn("key", F.col("event_id").cast("string"))
    # the stream stops between two appends and goes on behind its checkpoint
    for half in (0, 1):
        replay.append_log(rows.where(F.floor(F.col("event_id") / 3) % 2 == half), root)
        R.run_available(replay.stream_log(spark, root, ["bike.stock"], group="log"), path)
    out = spark.read.parquet(path).groupBy("topic", "partition").agg(F.min("offset").alias("first_offset"), (F.max("offset") + 1).alias("next_offset"), F.countDistinct("offset").alias("n"), F.sum(F.col("key").cast("long")).alias("keys"))
    end = replay.read_log(spark, root).groupBy("topic", "partition").agg((F.max("offset") + 1).alias("end"))
    return out.join(end, ["topic", "partition"]).withColumn("lag", F.col("end") - F.col("next_offset")).drop("end")


@query("SELECT station_id, date, slot, stock FROM (SELECT station_id, date, CAST((hour(collected_at) * 60 + minute(collected_at)) // 30 AS INTEGER) AS slot, count(*) AS stock FROM v_stock GROUP BY ALL)")
def snk03_link_export(spark, d):
    s = v_stock(spark, d).groupBy("station_id", "date", F.concat(F.date_format("collected_at", "HH"), F.lit(":"), F.lpad((F.floor(F.minute("collected_at") / 30) * 30).cast("string"), 2, "0")).alias("time_slot_30min")).agg(F.count(F.lit(1)).alias("stock"))
    return io.link_export(s).select("station_id", "date", "slot", "stock")


@query("SELECT station_id, date, CAST(sum(stock) AS BIGINT) AS stock_sum FROM v_stock WHERE stock >= 0 GROUP BY 1, 2")
def str13_daily_from_valid(spark, d):
    return S.valid_stock(v_stock(spark, d)).groupBy("station_id", "date").agg(F.sum("stock").alias("stock_sum"))


WEATHER = "SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 'observed' ELSE 'forecast' END AS source, event_type, floor(value) AS v, user_id % 5 AS nx, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'error'"


def weather_envelopes(spark, d):
    e = read(spark, d, "events")
    seen = F.col("event_type").isin("view", "click")
    day = F.date_format("ts", "yyyyMMdd")
    v = F.floor("value").cast("string")
    body = F.to_json(F.struct(day.alias("baseDate"), F.lit("600").alias("baseTime"), F.when(~seen, day).alias("fcstDate"), F.when(~seen, "900").alias("fcstTime"), F.upper(F.substring("event_type", 1, 3)).alias("category"), (F.col("user_id") % 5).cast("string").alias("nx"), F.lit("1").alias("ny"), F.when(seen, v).alias("obsrValue"), F.when(~seen & (F.col("event_type") != "error"), v).alias("fcstValue")))
    return e.select(body.alias("payload_json"), F.timestamp_seconds(F.col("event_id")).alias("poll_run_at"), F.current_timestamp().alias("ingested_at"))


@query(f"SELECT source, upper(substr(event_type, 1, 3)) AS category, CAST(nx AS INTEGER) AS nx, CAST(epoch(day) + CASE source WHEN 'observed' THEN 6 ELSE 9 END * 3600 AS BIGINT) AS valid_time, v::DOUBLE AS value FROM ({WEATHER})")
def src05_weather_payload(spark, d):
    return io.weather_payload(weather_envelopes(spark, d)).select("source", "category", "nx", F.unix_timestamp("valid_time").alias("valid_time"), "value")


PIVOT = f"SELECT source, CAST(nx AS INTEGER) AS nx, CAST(epoch(day) + CASE source WHEN 'observed' THEN 6 ELSE 9 END * 3600 AS BIGINT) AS valid_time, " + ", ".join(f"arg_max(v::DOUBLE, event_id) FILTER (WHERE event_type = '{k}') AS \"{k[:3].upper()}\"" for k in ("view", "click", "purchase", "signup")) + f", max(event_id) AS collected FROM ({WEATHER}) GROUP BY 1, 2, 3"


@query(PIVOT)
def agg07_weather_pivot(spark, d):
    wide = io.weather_pivot(io.weather_payload(weather_envelopes(spark, d)), ["VIE", "CLI", "PUR", "SIG"])
    return wide.select("source", "nx", F.unix_timestamp("valid_time").alias("valid_time"), "VIE", "CLI", "PUR", "SIG", F.unix_timestamp("collected_at").alias("collected"))


@query(PIVOT)
def p3_weather_features(spark, d):
    from tramline.plans.jobs import weather_features

    wide, _ = weather_features(weather_envelopes(spark, d), ["VIE", "CLI", "PUR", "SIG"], {"VIE": (0, 500)})
    return wide.select("source", "nx", F.unix_timestamp("valid_time").alias("valid_time"), "VIE", "CLI", "PUR", "SIG", F.unix_timestamp("collected_at").alias("collected"))


@query("SELECT event_id, CAST(event_id % 90 AS INTEGER) AS seconds, event_type AS message, CAST(floor(epoch(ts)) AS BIGINT) AS generated FROM events")
def src06_arrival_payload(spark, d):
    e = read(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("btrainNo"), (F.col("event_id") % 90).cast("string").alias("barvlDt"), F.col("event_type").alias("arvlMsg2"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("recptnDt")))
    env = e.select(F.col("user_id").cast("string").alias("entity_id"), body.alias("payload_json"), F.col("ts").alias("poll_run_at"), F.col("ts").alias("ingested_at"))
    return io.arrival_payload(env).select(F.col("train_no").cast("long").alias("event_id"), "seconds", "message", F.unix_timestamp("generated_at").alias("generated"))


@query("SELECT p.point_id, CASE WHEN lon < 127.0 THEN CASE WHEN lat < 37.55 THEN 'sw' ELSE 'nw' END ELSE CASE WHEN lat < 37.55 THEN 'se' ELSE 'ne' END END AS area, CASE WHEN lon < 126.81 OR lat >= 37.69 THEN 'nearest' ELSE 'within' END AS method FROM v_point p")
def joi13_point_in_polygon(spark, d):
    from tramline.operators.events import point_in_polygon
    from tramline.queries.base import v_point

    box = lambda a, b, x, y: [(a, b), (x, b), (x, y), (a, y)]
    rings = [("sw", box(126.81, 37.0, 127.0, 37.55)), ("nw", box(126.81, 37.55, 127.0, 37.69)), ("se", box(127.0, 37.0, 128.0, 37.55)), ("ne", box(127.0, 37.55, 128.0, 37.69))]
    areas = spark.createDataFrame(rings, "area string, ring array<struct<x:double,y:double>>")
    return point_in_polygon(v_point(spark, d).select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y")), areas, "point_id", "area")


#: A crooked quadrilateral around each station, of a size of its own.
CORNERS = ((-0.0011, -0.0007), (0.0013, -0.0009), (0.0008, 0.0012), (-0.0006, 0.0010))
RINGS = "SELECT station_no AS area, " + ", ".join(f"lon + ({x}) * r AS x{i}, lat + ({y}) * r AS y{i}" for i, (x, y) in enumerate(CORNERS)) + " FROM (SELECT *, 0.7::DOUBLE + (station_no % 7) * 0.3 + station_no * 0.0001 AS r FROM v_station)"
EDGES = " UNION ALL ".join(f"SELECT area, x{i} AS ax, y{i} AS ay, x{(i + 1) % 4} AS ex, y{(i + 1) % 4} AS ey FROM ring" for i in range(4))
NEAREST = f"""WITH ring AS ({RINGS}), edge AS ({EDGES}), pe AS (SELECT point_id, p.lon AS x, p.lat AS y, area, ax, ay, ex, ey, ex - ax AS dx, ey - ay AS dy FROM v_point p, edge),
    dist AS (SELECT *, greatest(0, least(1, coalesce(((x - ax) * dx + (y - ay) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM pe),
    ins AS (SELECT point_id, min(area) AS area FROM (SELECT point_id, area FROM pe GROUP BY 1, 2 HAVING count_if((ay > y) <> (ey > y) AND x < dx * (y - ay) / nullif(dy, 0) + ax) % 2 = 1) GROUP BY 1),
    near AS (SELECT point_id, arg_min(area, (sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2), area)) AS area, min(sqrt((x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2)) AS d FROM dist GROUP BY 1)"""


def rings(spark, d):
    from tramline.queries.base import v_station

    r = F.lit(0.7) + F.col("station_no") % 7 * 0.3 + F.col("station_no") * 0.0001
    corner = lambda x, y: F.struct((F.col("lon") + x * r).alias("x"), (F.col("lat") + y * r).alias("y"))
    return v_station(spark, d).select(F.col("station_no").alias("area"), F.array(*[corner(x, y) for x, y in CORNERS]).alias("ring"))


def map_points(spark, d):
    from tramline.queries.base import v_point

    return v_point(spark, d).select("point_id", F.col("lon").alias("x"), F.col("lat").alias("y"))


@query(f"{NEAREST} SELECT n.point_id, coalesce(ins.area, n.area) AS area, CASE WHEN ins.area IS NULL THEN 'nearest' ELSE 'within' END AS method FROM near n LEFT JOIN ins ON ins.point_id = n.point_id")
def joi13_station_areas(spark, d):
    from tramline.operators.events import point_in_polygon

    return point_in_polygon(map_points(spark, d), rings(spark, d), "point_id", "area")


@query(f"{NEAREST} SELECT point_id, area, round(d, 9) AS distance FROM near")
def joi13_nearest_boundary(spark, d):
    from tramline.operators.events import nearest_boundary

    return nearest_boundary(map_points(spark, d), rings(spark, d), "point_id", "area").withColumn("distance", F.round("distance", 9))


@query("SELECT CAST(user_id AS VARCHAR) AS station_id, CAST(floor(value) AS INTEGER) AS stock, 100.0::DOUBLE AS racks FROM events WHERE event_id % 2 = 0 OR event_id % 10 <> 5")
def src02_read_mixed_schema(spark, d):
    root = place(spark)
    e = read(spark, d, "events")
    names = {"stationId": F.col("user_id").cast("string"), "parkingBikeTotCnt": F.floor("value").cast("string"), "rackTotCnt": F.lit("100")}
    e.where("event_id % 2 = 0").select(*[v.alias(k) for k, v in names.items()], F.col("ts").cast("string").alias("collected_at")).write.parquet(root)
    body = F.to_json(F.struct(*[v.alias(k) for k, v in names.items()]))
    # of the envelopes one in five names another entity, and one in five none
    k = F.col("event_id") % 10
    entity = F.when(k == 5, "other").when(k == 7, " ").otherwise(F.col("user_id").cast("string"))
    e.where("event_id % 2 = 1").select(entity.alias("entity_id"), body.alias("payload_json"), F.col("ts").cast("string").alias("ingested_at")).write.mode("append").parquet(root)
    return io.read_mixed_schema(spark, root).select("station_id", "stock", "racks")


@query("SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS station, CASE WHEN event_id % 2 = 1 THEN event_type END AS kind FROM events")
def src08_read_rental_csv(spark, d):
    root = place(spark)
    e = read(spark, d, "events")
    # the first layout ends in a blank column
    e.where("event_id % 2 = 0").select(F.col("event_id").alias("a"), F.col("user_id").alias("b"), F.lit(None).cast("string").alias(" ")).write.option("header", "true").csv(f"{root}/two")
    e.where("event_id % 2 = 1").select(F.col("event_id").alias("a"), F.col("user_id").alias("b"), F.col("event_type").alias("c")).write.option("header", "true").csv(f"{root}/three")
    return io.read_rental_csv(spark, {f"{root}/two": ["id", "station"], f"{root}/three": ["id", "station", "kind"]})


@query("SELECT event_id, event_type FROM events")
def src09_read_json_arrays(spark, d):
    root = place(spark)
    groups = read(spark, d, "events").groupBy((F.col("event_id") % 7).alias("file")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("rows"))
    # a file of one line, an array, for each group
    groups.select("file", F.to_json("rows").alias("value")).repartition("file").write.partitionBy("file").text(root)
    return io.read_json_arrays(spark, root).select("event_id", "event_type")


@query("SELECT event_id, value AS temp, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE 1.5 END AS rain FROM events")
def src11_read_hourly_weather(spark, d):
    root = place(spark)
    read(spark, d, "events").select("event_id", F.col("value").alias("temp"), F.when(F.col("event_id") % 3 != 0, 1.5).alias("rain")).write.option("header", "true").csv(root)
    return io.read_hourly_weather(spark, root, "event_id long, temp double, rain double", ["rain"])


@query("SELECT station_id, date, stock FROM v_stock WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def src12_read_hourly_stock(spark, d):
    root = place(spark)
    v_stock(spark, d).select("station_id", "date", "stock", F.lit("x").alias("more")).write.option("header", "true").csv(root)
    day = lambda x: F.lit(x).cast("date")
    return io.read_hourly_stock(spark, root, "station_id long, date date, stock int, more string", ["station_id", "date", "stock"], day("2024-01-05"), day("2024-01-20"))
