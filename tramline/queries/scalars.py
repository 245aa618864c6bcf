"""Queries of the scalar, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import scalars as S
from tramline.functions import timefn as T
from tramline.queries.base import query, read, rounded, v_festival, v_panel, v_point, v_station

MOD = "hour(ts) * 60 + minute(ts)"


def events(spark, d):
    return read(spark, d, "events")


@query("SELECT p.date, max(CASE WHEN dayofweek(p.date) = 6 THEN 1 WHEN dayofweek(p.date) = 0 OR coalesce(h.is_holiday, false) THEN 2 ELSE 0 END) AS dow_type, max(CASE WHEN dayofweek(p.date) = 6 THEN 'saturday' WHEN dayofweek(p.date) = 0 THEN 'sunday' WHEN coalesce(h.is_holiday, false) THEN 'holiday' ELSE 'weekday' END) AS day_type, max(CASE WHEN dayofweek(p.date) = 6 THEN 'saturday' WHEN dayofweek(p.date) = 0 OR coalesce(h.is_holiday, false) THEN 'sunday' ELSE 'weekday' END) AS folded FROM v_panel p LEFT JOIN v_holiday h ON h.date = p.date GROUP BY 1")
def fun01_fun02_day_types(spark, d):
    from tramline.queries.base import v_holiday

    p = v_panel(spark, d).select("date").distinct().join(v_holiday(spark, d), "date", "left")
    kind = T.day_type(F.col("date"), F.col("is_holiday"))
    return p.select("date", T.dow_type(F.col("date"), F.col("is_holiday")).alias("dow_type"), kind.alias("day_type"), T.folded_day_type(kind).alias("folded"))


@query(f"SELECT event_id, CAST((dayofweek(ts) + 6) % 7 AS INTEGER) AS dow, CAST(({MOD}) // 5 AS INTEGER) AS slot_5m, CAST(({MOD}) // 30 AS INTEGER) AS slot_30m, CAST((({MOD}) // 5) // 6 AS INTEGER) AS from_5m, CAST((hour(ts) * 100 + minute(ts)) // 100 * 12 + minute(ts) // 5 AS INTEGER) AS from_hhmm FROM events")
def fun03_fun04_slots(spark, d):
    ts = F.col("ts")
    return events(spark, d).select("event_id", T.mon0_dow(ts).alias("dow"), T.slot_5m(ts).alias("slot_5m"), T.slot_30m(ts).alias("slot_30m"), T.slot_5m_to_30m(T.slot_5m(ts)).alias("from_5m"), T.hhmm_to_slot_5m(F.hour(ts) * 100 + F.minute(ts)).alias("from_hhmm"))


@query("SELECT event_id, CAST(epoch(time_bucket(INTERVAL 5 MINUTE, ts)) AS BIGINT) AS slot_start FROM events")
def fun05_floor_5min(spark, d):
    return events(spark, d).select("event_id", F.unix_timestamp(T.floor_5min(F.col("ts"))).alias("slot_start"))


@query("SELECT event_id, CASE WHEN hour(ts) <= 3 THEN '24~' WHEN hour(ts) <= 5 THEN '~06' ELSE printf('%02d-%02d', hour(ts), hour(ts) + 1) END AS slot FROM events")
def fun06_service_slot(spark, d):
    return events(spark, d).select("event_id", T.service_slot(F.hour("ts")).alias("slot"))


@query(f"SELECT event_id, CAST(CASE WHEN {MOD} >= 240 THEN {MOD} ELSE {MOD} + 1440 END AS INTEGER) AS minutes, printf('%02d:%02d', hour(ts), minute(ts) // 30 * 30) AS slot30, printf('%02d:%02d', hour(ts), minute(ts) // 5 * 5) AS bin5 FROM events")
def fun07_service_minutes(spark, d):
    m = T.service_minutes(T.parse_minutes(F.date_format("ts", "HH:mm:ss")))
    return events(spark, d).select("event_id", m.alias("minutes"), T.minutes_to_slot30(m).alias("slot30"), T.minutes_to_bin5(m).alias("bin5"))


@query("SELECT event_id, slot30, CASE WHEN h <= 3 THEN '24~' WHEN h <= 5 THEN '~06' ELSE printf('%02d-%02d', h, h + 1) END AS bucket FROM (SELECT event_id, hour(ts) AS h, unnest([printf('%02d:00', hour(ts)), printf('%02d:30', hour(ts))]) AS slot30 FROM events)")
def fun08_hour_bucket(spark, d):
    halves = events(spark, d).select("event_id", F.explode(T.half_hours(F.hour("ts"))).alias("slot30"))
    return halves.withColumn("bucket", T.hour_bucket(F.col("slot30")))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(epoch(date_trunc('minute', ts)) AS BIGINT) END AS at FROM events")
def fun09_weather_time(spark, d):
    hhmm = F.when(F.col("event_id") % 7 == 0, "99x").otherwise((F.hour("ts") * 100 + F.minute("ts")).cast("string"))
    return events(spark, d).select("event_id", F.unix_timestamp(T.weather_time(F.date_format("ts", "yyyyMMdd"), hhmm)).alias("at"))


@query("SELECT event_id, round(sin(hour(ts) * (2 * 3.141592653589793 / 24)), 6) AS sin_h, round(cos(hour(ts) * (2 * 3.141592653589793 / 24)), 6) AS cos_h FROM events")
def fun10_cyclic(spark, d):
    s, c = T.cyclic(F.hour("ts"), 24)
    return rounded(events(spark, d).select("event_id", s.alias("sin_h"), c.alias("cos_h")))


@query("SELECT event_id, CAST(hour(ts + INTERVAL 30 MINUTE) AS INTEGER) AS hour, CAST((dayofweek(ts + INTERVAL 30 MINUTE) + 6) % 7 AS INTEGER) AS dow, CAST(ts + INTERVAL 30 MINUTE AS DATE) AS date FROM events")
def fun11_target_time(spark, d):
    t = T.target_time(F.col("ts"))
    return events(spark, d).select("event_id", F.hour(t).alias("hour"), T.mon0_dow(t).alias("dow"), t.cast("date").alias("date"))


@query(f"SELECT event_id, ({MOD} >= 330 OR {MOD} < 60) AS open, CAST(epoch(CASE WHEN {MOD} >= 330 OR {MOD} < 60 THEN date_trunc('second', ts) ELSE date_trunc('day', ts) + INTERVAL 60 MINUTE END) AS BIGINT) AS last_open FROM events")
def fun12_operating_window(spark, d):
    ts = F.col("ts").cast("timestamp")
    return events(spark, d).select("event_id", T.in_operating_window(T.minute_of_day(ts), 330, 60).alias("open"), F.unix_timestamp(T.last_open(ts, 330, 60)).alias("last_open"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN value ELSE NULL END AS v FROM events")
def fun13_weather_value(spark, d):
    k = F.col("event_id") % 4
    raw = F.when(k == 0, "강수없음").when(k == 1, " ").when(k == 2, F.col("value").cast("string")).otherwise("?")
    return events(spark, d).select("event_id", S.weather_value(raw).alias("v"))


@query("SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS label, CAST(s_suppkey AS INTEGER) AS number, 'x' || s_name AS name FROM supplier")
def fun14_fun15_labels(spark, d):
    s = read(spark, d, "supplier")
    number, name = S.split_number_prefix(F.concat(F.col("s_suppkey").cast("string"), F.lit(". x"), F.col("s_name")))
    return s.select("s_suppkey", S.digits_label(F.col("s_name")).alias("label"), number.alias("number"), name.alias("name")).withColumn("label", F.when(F.col("s_suppkey") == 0, "0").otherwise(F.col("label")))


@query("SELECT event_id, CAST((hour(ts) % 24) * 2 + minute(ts) // 30 AS INTEGER) AS slot FROM events")
def fun16_time_column_slot(spark, d):
    return events(spark, d).select("event_id", S.time_column_slot(F.concat(F.hour("ts").cast("string"), F.lit("시"), F.minute("ts").cast("string"), F.lit("분"))).alias("slot"))


@query("""SELECT event_id, sha256('events|' || CAST(user_id AS VARCHAR) || '|' || CAST(event_id AS VARCHAR) || '|' || sha256('{"k":"' || json_extract_string(props, '$.k') || '"}')) AS id FROM events""")
def fun17_event_id(spark, d):
    return events(spark, d).select("event_id", S.event_id(F.lit("events"), F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("props")).alias("id"))


@query("""SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS payload FROM events""")
def arr04_payload_json(spark, d):
    return events(spark, d).select("event_id", S.canonical_json(F.col("props")).alias("payload"))


HAV = "2 * 6371.0 * asin(sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))"


@query(f"SELECT p.point_id, round({HAV.format(a='p', b='s')}, 6) AS km FROM v_point p JOIN v_station s ON s.station_no = p.point_id % 50")
def fun18_haversine(spark, d):
    s = v_station(spark, d).select("station_no", F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    p = v_point(spark, d)
    return rounded(p.join(s, F.col("point_id") % 50 == F.col("station_no")).select("point_id", S.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")).alias("km")))


@query("SELECT event_id, value / nullif(user_id % 3, 0) AS ratio, nullif(CAST(user_id % 4 AS DOUBLE), 0) AS f, CAST(floor(value) AS INTEGER) AS i, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS s FROM events")
def fun19_optional(spark, d):
    blank = F.when(F.col("event_type") == "error", "  ").otherwise(F.concat(F.lit(" "), "event_type"))
    return events(spark, d).select("event_id", S.safe_ratio(F.col("value"), F.col("user_id") % 3).alias("ratio"), S.optional_float((F.col("user_id") % 4).cast("string")).alias("f"), S.optional_int(F.col("value").cast("string")).alias("i"), S.optional_str(blank).alias("s"))


@query("SELECT event_id, CASE WHEN v IS NULL THEN NULL ELSE CAST(v >= 34 AS INTEGER) + CAST(v >= 70 AS INTEGER) + CAST(v >= 130 AS INTEGER) END AS grade FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE floor(value) END AS v FROM events)")
def fun20_grade(spark, d):
    v = F.when(F.col("event_id") % 11 != 0, F.floor("value"))
    return events(spark, d).select("event_id", S.grade(v, [34, 70, 130]).alias("grade"))


@query("SELECT event_id, round(greatest(least((20.0 - value) / 10, 1), 0), 6) AS w FROM events")
def fun21_mix_weight(spark, d):
    return rounded(events(spark, d).select("event_id", S.mix_weight(F.col("value"), 10, 20).alias("w")))


@query("SELECT event_id, CAST(CASE WHEN value <= 7.5 THEN 5 WHEN value <= 12.5 THEN 10 WHEN value <= 22.5 THEN 15 ELSE 30 END AS INTEGER) AS horizon FROM events")
def fun24_nearest_horizon(spark, d):
    return events(spark, d).select("event_id", S.nearest_horizon(F.col("value")).alias("horizon"))


@query("SELECT event_id, CAST(CASE event_id % 6 WHEN 1 THEN 70 WHEN 2 THEN 100 WHEN 3 THEN 130 WHEN 4 THEN 170 END AS DOUBLE) AS level, CASE WHEN value <= 30 THEN 'fresh' WHEN value <= 60 THEN 'stale' ELSE 'gone' END AS age FROM events")
def fun26_fun27_levels(spark, d):
    return events(spark, d).select("event_id", S.bus_level((F.col("event_id") % 6).cast("int")).alias("level"), S.freshness(F.col("value"), 30, 60).alias("age"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN 'hub' ELSE s_name END AS name FROM supplier")
def fun28_station_name(spark, d):
    raw = F.concat(F.when(F.col("s_suppkey") % 5 == 0, F.lit("old hub")).otherwise(F.col("s_name")), F.lit("역(2호선)"))
    return read(spark, d, "supplier").select("s_suppkey", S.station_name(raw, {"old hub": "hub"}).alias("name"))


@query("SELECT user_id, CAST(first(k ORDER BY event_id) AS INTEGER) AS headway FROM (SELECT user_id, event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 AS k FROM events) WHERE k <> 0 GROUP BY 1")
def fun29_headway(spark, d):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    raw = F.when(k == 0, F.when(F.col("event_id") % 2 == 0, "0").otherwise("  ")).otherwise(k.cast("string"))
    rows = events(spark, d).select("user_id", "event_id", S.headway_minutes(raw).alias("h")).where("h IS NOT NULL")
    return rows.groupBy("user_id").agg(F.min_by("h", "event_id").alias("headway"))


@query("SELECT id, unnest(generate_series(greatest(begin_date, DATE '1998-01-01'), least(end_date, DATE '1998-12-31'), INTERVAL 1 DAY))::DATE AS date FROM v_festival WHERE begin_date <= DATE '1998-12-31' AND end_date >= DATE '1998-01-01'")
def arr02_explode_days(spark, d):
    from tramline.operators.events import explode_days

    return explode_days(v_festival(spark, d), "begin_date", "end_date", F.lit("1998-01-01").cast("date"), F.lit("1998-12-31").cast("date")).select("id", "date")


@query("SELECT id, CAST(date_diff('day', begin_date, end_date) + 1 AS INTEGER) AS days, date_diff('day', begin_date, end_date) + 1 <= 0 AS reversed FROM (SELECT id, CASE WHEN id % 9 = 0 THEN end_date + 3 ELSE begin_date END AS begin_date, end_date FROM v_festival)")
def arr06_duration_days(spark, d):
    from tramline.operators.events import duration_days

    f = v_festival(spark, d).withColumn("begin_date", F.when(F.col("id") % 9 == 0, F.date_add("end_date", 3)).otherwise(F.col("begin_date")))
    return duration_days(f, "begin_date", "end_date").select("id", "days", "reversed")


CDF = "CASE WHEN {z} >= 0 THEN 1 - {u} ELSE {u} END"
UPPER = "(exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * ({t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))))"


def cdf_sql(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    return f"({CDF.format(z=z, u=UPPER.format(z=z, t=t))})"


RISK = "SELECT event_id, floor(value)::DOUBLE AS q50, greatest((floor(value / 2) + 4) / 2.5631031, 0.1) AS sd FROM events"


@query(f"SELECT event_id, round({cdf_sql('((0.5 - q50) / sd)')}, 5) AS p_empty, round(1 - {cdf_sql('((39.5 - q50) / sd)')}, 5) AS p_full FROM (SELECT event_id, q50, sd::DOUBLE AS sd FROM ({RISK}))")
def fun23_empty_full_risk(spark, d):
    half = F.floor(F.col("value") / 2)
    e, f = S.empty_full_risk(F.lit(0.0), F.floor("value").cast("double"), (half + 4).cast("double"), F.lit(40.0))
    return events(spark, d).select("event_id", F.round(e, 5).alias("p_empty"), F.round(f, 5).alias("p_full"))


@query(f"SELECT event_id, round(CAST(user_id AS DOUBLE) * (w * h / 2 + (1 - w) * h * {cdf_sql('(h - 4.0)')} / 2), 4) AS people FROM (SELECT event_id, user_id, value AS h, greatest(least((15.0 - value) / 10, 1), 0)::DOUBLE AS w FROM events)")
def fun22_platform_accumulation(spark, d):
    return events(spark, d).select("event_id", F.round(S.platform_accumulation(F.col("user_id").cast("double"), F.col("value"), mu=4.0), 4).alias("people"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 AND floor(value) > 0 THEN CASE WHEN floor(value) * 40 <= 1800 THEN CAST(floor(epoch(ts)) + floor(value) * 40 AS BIGINT) END WHEN user_id % 2 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS eta FROM events")
def fun25_arrival_eta(spark, d):
    seconds = F.when(F.col("event_id") % 3 != 0, F.floor("value") * 40).otherwise(F.lit(0))
    ts = F.col("ts").cast("timestamp")
    return events(spark, d).select("event_id", F.unix_timestamp(S.arrival_eta(seconds, ts, ts, F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"), F.lit("a"))).alias("eta"))
