"""Queries of the stock operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import timefn as T
from tramline.operators import stock as S
from tramline.queries.base import query, read, rounded, v_anchor, v_panel, v_rental, v_stock

SLOTS = "CASE WHEN dayofweek(collected_at) = 6 THEN 1 WHEN dayofweek(collected_at) = 0 THEN 2 ELSE 0 END AS dow_type, CAST((hour(collected_at) * 60 + minute(collected_at)) // 30 AS INTEGER) AS time_slot"


def slotted(spark, d):
    return v_stock(spark, d).select("*", T.dow_type(F.col("date")).alias("dow_type"), T.slot_30m(F.col("collected_at")).alias("time_slot"))


@query("SELECT event_id, station_id, collected_at, stock, racks, CASE WHEN racks > 0 THEN stock / racks END AS ratio, date, CAST(hour(collected_at) AS INTEGER) AS hour, CAST(minute(collected_at) AS INTEGER) AS minute FROM v_stock")
def prj01_normalize_stock(spark, d):
    raw = v_stock(spark, d).select("event_id", F.col("station_id").alias("stationId"), "collected_at", F.col("stock").cast("string").alias("parkingBikeTotCnt"), F.col("racks").cast("string").alias("rackTotCnt"))
    return S.normalize_stock(raw, {"stationId": "station_id", "parkingBikeTotCnt": "stock", "rackTotCnt": "racks"})


@query("SELECT event_id, station_id, stock FROM v_stock WHERE stock >= 0 AND racks > 0 AND date = DATE '2024-01-05'")
def prj02_valid_stock(spark, d):
    return S.valid_stock(v_stock(spark, d), F.lit("2024-01-05").cast("date")).select("event_id", "station_id", "stock")


@query("SELECT event_id, station_id, horizon_min, stock FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 5 ELSE 10 END AS horizon_min FROM v_stock) WHERE horizon_min = 5 AND stock IS NOT NULL")
def prj03_one_horizon(spark, d):
    df = v_stock(spark, d).withColumn("horizon_min", F.when(F.col("event_id") % 3 == 0, 5).otherwise(10))
    return S.one_horizon(df, "horizon_min", 5, "stock").select("event_id", "station_id", "horizon_min", "stock")


@query("SELECT event_id, CAST(stock + ret AS DOUBLE) AS future_stock, (stock + ret) / racks AS future_ratio, stock + ret <= 0 AS is_empty, stock + ret >= racks AS is_full FROM (SELECT *, event_id % 41 - 20 AS ret FROM v_stock)")
def prj08_stock_labels(spark, d):
    df = v_stock(spark, d).withColumn("flow", (F.col("event_id") % 41 - 20).cast("double"))
    return S.stock_labels(df, "stock", "flow", "racks").select("event_id", "future_stock", "future_ratio", "is_empty", "is_full")


DEDUP = "SELECT * FROM v_stock QUALIFY row_number() OVER (PARTITION BY station_id, CAST(floor(epoch(collected_at) / 300) AS BIGINT) ORDER BY collected_at DESC, event_id DESC) = 1"


@query(f"SELECT event_id, station_id, collected_at, stock FROM ({DEDUP})")
def win01_dedup_slot(spark, d):
    return S.dedup_slot(v_stock(spark, d), "station_id", "collected_at", "event_id").select("event_id", "station_id", "collected_at", "stock")


@query("SELECT event_id, station_id, stock FROM (SELECT * FROM v_stock QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY collected_at DESC, event_id DESC) = 1) WHERE collected_at >= (SELECT max(collected_at) FROM v_stock) - INTERVAL 12 HOUR")
def win02_latest_by_key(spark, d):
    return S.latest_by_key(v_stock(spark, d), "station_id", "collected_at", "event_id", "12 hours").select("event_id", "station_id", "stock")


@query("SELECT event_id, station_id, horizon, date FROM (SELECT *, event_id % 4 AS horizon FROM v_stock QUALIFY date = max(date) OVER (PARTITION BY station_id)) QUALIFY row_number() OVER (PARTITION BY station_id, horizon ORDER BY event_id DESC) = 1")
def win03_latest_issue(spark, d):
    df = v_stock(spark, d).withColumn("horizon", F.col("event_id") % 4)
    return S.latest_issue(df, ["station_id"], "date", "horizon", "event_id").select("event_id", "station_id", "horizon", "date")


@query("SELECT station_id, dow_type, time_slot, round(exp_bikes, 6) AS exp_bikes, round(p_empty, 6) AS p_empty, round(p_full, 6) AS p_full, n FROM v_profile")
def agg01_stock_profile(spark, d):
    return rounded(S.stock_profile(slotted(spark, d)))


AGG02 = f"SELECT station_id, CAST((dayofweek(collected_at) + 6) % 7 AS INTEGER) AS dow, CAST(hour(collected_at) AS INTEGER) AS hour, round(avg(stock), 6) AS mean_stock, round(stddev_samp(stock), 6) AS sd_stock, round(avg(stock / racks), 6) AS mean_ratio, count(*) AS n FROM ({DEDUP}) GROUP BY 1, 2, 3"


@query(AGG02)
def agg02_realtime_profile(spark, d):
    return rounded(S.realtime_profile(v_stock(spark, d), "station_id", "collected_at", "stock", "racks", "event_id"))


@query(f"SELECT station_id, date, time_slot, CAST(sum(stock) AS BIGINT) AS stock_sum, count(*) AS n, CAST(count_if(stock <= 0) AS BIGINT) AS empty_sum, CAST(count_if(stock >= racks) AS BIGINT) AS full_sum FROM (SELECT *, {SLOTS} FROM v_stock) GROUP BY ALL")
def agg03_daily_partial(spark, d):
    return S.daily_partial(slotted(spark, d), "station_id", "date", "time_slot", "stock", "racks")


@query(f"SELECT station_id, time_slot, round(avg(stock), 6) AS exp_bikes, round(avg(CAST(stock <= 0 AS INTEGER)), 6) AS p_empty, round(avg(CAST(stock >= racks AS INTEGER)), 6) AS p_full, count(*) AS n FROM (SELECT *, {SLOTS} FROM v_stock) WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-01-28' GROUP BY ALL")
def agg03_window_profile(spark, d):
    part = S.daily_partial(slotted(spark, d), "station_id", "date", "time_slot", "stock", "racks")
    return rounded(S.window_profile(part, "station_id", "date", "time_slot", F.lit("2024-01-28").cast("date")))


BLEND = "CASE WHEN a.{v} IS NULL THEN b.{v} WHEN b.n >= 2 THEN (a.{v} * 48 + b.{v} * b.n) / (48 + b.n) ELSE a.{v} END"


@query(
    f"""WITH cells AS (SELECT *, {SLOTS}, date <= DATE '2024-01-15' AS old FROM v_stock),
    prof AS (SELECT old, station_id, dow_type, time_slot, avg(stock) AS exp_bikes, avg(CAST(stock <= 0 AS INTEGER)) AS p_empty, avg(CAST(stock >= racks AS INTEGER)) AS p_full, count(*) AS n FROM cells GROUP BY ALL)
    SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(a.dow_type, b.dow_type) AS dow_type, coalesce(a.time_slot, b.time_slot) AS time_slot,
    {', '.join(f"round({BLEND.format(v=v)}, 6) AS {v}" for v in S.VALUES)}
    FROM (SELECT * FROM prof WHERE old) a FULL JOIN (SELECT * FROM prof WHERE NOT old) b ON a.station_id = b.station_id AND a.dow_type = b.dow_type AND a.time_slot = b.time_slot"""
)
def joi15_blend_profile(spark, d):
    s = slotted(spark, d)
    old = F.col("date") <= "2024-01-15"
    return rounded(S.blend_profile(S.stock_profile(s.where(old)), S.stock_profile(s.where(~old)), ["station_id", "dow_type", "time_slot"], least=2))


joi04_complete_grid_sql = """SELECT g.station_id, g.dow_type, g.time_slot,
    round(coalesce(p.exp_bikes, s.exp_bikes, o.exp_bikes), 6) AS exp_bikes, round(coalesce(p.p_empty, s.p_empty, o.p_empty), 6) AS p_empty, round(coalesce(p.p_full, s.p_full, o.p_full), 6) AS p_full,
    CASE WHEN p.station_id IS NOT NULL THEN 'observed' WHEN s.station_id IS NOT NULL THEN 'station_slot' ELSE 'station' END AS source
    FROM (SELECT station_id, CAST(dow_type AS INTEGER) AS dow_type, CAST(time_slot AS INTEGER) AS time_slot FROM (SELECT DISTINCT station_id FROM v_profile), range(3) t(dow_type), range(48) u(time_slot)) g
    LEFT JOIN v_profile p ON g.station_id = p.station_id AND g.dow_type = p.dow_type AND g.time_slot = p.time_slot
    LEFT JOIN (SELECT station_id, time_slot, avg(exp_bikes) AS exp_bikes, avg(p_empty) AS p_empty, avg(p_full) AS p_full FROM v_profile GROUP BY ALL) s ON g.station_id = s.station_id AND g.time_slot = s.time_slot
    LEFT JOIN (SELECT station_id, avg(exp_bikes) AS exp_bikes, avg(p_empty) AS p_empty, avg(p_full) AS p_full FROM v_profile GROUP BY ALL) o ON g.station_id = o.station_id"""


@query(joi04_complete_grid_sql)
def joi04_complete_grid(spark, d):
    return rounded(S.complete_grid(S.stock_profile(slotted(spark, d))))


@query("SELECT p.station_no, p.date, p.slot, coalesce(h.is_holiday, false) AS is_holiday FROM v_panel p LEFT JOIN v_holiday h ON p.date = h.date")
def joi01_attach_holidays(spark, d):
    from tramline.queries.base import v_holiday

    return S.attach_holidays(v_panel(spark, d), v_holiday(spark, d)).select("station_no", "date", "slot", "is_holiday")


FLOW = """SELECT coalesce(a.station_id, b.station_id) AS station_id, coalesce(a.date, b.date) AS date, coalesce(a.slot, b.slot) AS slot, coalesce(a.rent, 0) AS rent, coalesce(b.ret, 0) AS ret, coalesce(b.ret, 0) - coalesce(a.rent, 0) AS net_flow
    FROM (SELECT station_id, CAST(ts AS DATE) AS date, CAST((hour(ts) * 60 + minute(ts)) // 5 AS INTEGER) AS slot, CAST(sum(cnt) AS BIGINT) AS rent FROM v_rental WHERE kind = 'rent' GROUP BY ALL) a
    FULL JOIN (SELECT station_id, CAST(ts AS DATE) AS date, CAST((hour(ts) * 60 + minute(ts)) // 5 AS INTEGER) AS slot, CAST(sum(cnt) AS BIGINT) AS ret FROM v_rental WHERE kind = 'return' GROUP BY ALL) b
    ON a.station_id = b.station_id AND a.date = b.date AND a.slot = b.slot"""


def flows(spark, d):
    r = v_rental(spark, d).select("station_id", "kind", "cnt", F.col("ts").cast("date").alias("date"), T.slot_5m(F.col("ts")).alias("slot"))
    return S.net_flow(r.where("kind = 'rent'"), r.where("kind = 'return'"), ["station_id", "date", "slot"])


@query(FLOW)
def joi14_net_flow(spark, d):
    return flows(spark, d)


HIST = f"SELECT *, CASE WHEN dayofweek(date) = 6 THEN 1 WHEN dayofweek(date) = 0 THEN 2 ELSE 0 END AS dow_type, CAST(slot // 72 AS INTEGER) AS time_slot, CAST(station_id % 2 AS INTEGER) * 5 + 5 AS horizon FROM ({FLOW})"
HIST_AGG = "round(avg(net_flow), 6) AS mean_flow, round(stddev_samp(net_flow), 6) AS sd_flow, round(avg(rent), 6) AS mean_rent, round(avg(ret), 6) AS mean_return, count(*) AS n"
HIST_SQL = f"""SELECT station_id, horizon, dow_type, time_slot, {HIST_AGG}, CASE WHEN grouping_id(station_id, horizon, dow_type, time_slot) = 0 THEN 0 WHEN grouping_id(station_id, horizon, dow_type, time_slot) = 3 THEN 1 ELSE 2 END AS grain
    FROM ({HIST}) GROUP BY GROUPING SETS ((station_id, horizon, dow_type, time_slot), (station_id, horizon), ())"""


def history(spark, d):
    return flows(spark, d).select("*", T.dow_type(F.col("date")).alias("dow_type"), F.floor(F.col("slot") / 72).cast("int").alias("time_slot"), (F.col("station_id") % 2 * 5 + 5).cast("int").alias("horizon"))


@query(HIST_SQL)
def agg08_historical_profile(spark, d):
    return rounded(S.historical_profile(history(spark, d)))


@query(
    f"""WITH prof AS (SELECT * FROM ({HIST_SQL}) WHERE n >= 3), asked AS (SELECT user_id AS station_id, CAST(user_id % 2 AS INTEGER) * 5 + 5 AS horizon, CAST(event_id % 3 AS INTEGER) AS dow_type, CAST(event_id % 4 AS INTEGER) AS time_slot, event_id FROM events)
    SELECT event_id, coalesce(a.mean_flow, b.mean_flow, c.mean_flow) AS mean_flow, CASE WHEN a.mean_flow IS NOT NULL THEN 0 WHEN b.mean_flow IS NOT NULL THEN 1 ELSE 2 END AS level
    FROM asked q LEFT JOIN prof a ON a.grain = 0 AND a.station_id = q.station_id AND a.horizon = q.horizon AND a.dow_type = q.dow_type AND a.time_slot = q.time_slot
    LEFT JOIN prof b ON b.grain = 1 AND b.station_id = q.station_id AND b.horizon = q.horizon CROSS JOIN (SELECT mean_flow FROM prof WHERE grain = 2) c"""
)
def joi03_profile_with_fallback(spark, d):
    asked = read(spark, d, "events").select("event_id", F.col("user_id").alias("station_id"), (F.col("user_id") % 2 * 5 + 5).cast("int").alias("horizon"), (F.col("event_id") % 3).cast("int").alias("dow_type"), (F.col("event_id") % 4).cast("int").alias("time_slot"))
    prof = rounded(S.historical_profile(history(spark, d))).where("n >= 3")
    grains = [["station_id", "horizon", "dow_type", "time_slot"], ["station_id", "horizon"], []]
    return S.profile_with_fallback(asked, prof, grains, "mean_flow").select("event_id", "mean_flow", "level")


@query("SELECT station_no, slot, round(avg(boarding), 6) AS mean, round(coalesce(stddev_samp(boarding), (SELECT stddev_samp(boarding) FROM v_panel)), 6) AS sd FROM v_panel GROUP BY 1, 2")
def agg10_target_profile(spark, d):
    return rounded(S.target_profile(v_panel(spark, d), ["station_no", "slot"], "boarding"))


@query(f"SELECT station_id, date, time_slot, round(avg(stock), 6) AS mean FROM (SELECT *, {SLOTS} FROM v_stock) WHERE date BETWEEN DATE '2024-01-13' AND DATE '2024-01-20' GROUP BY ALL")
def agg09_lag_lookup(spark, d):
    return rounded(S.lag_lookup(slotted(spark, d), "station_id", "date", "time_slot", "stock", F.lit("2024-01-20").cast("date")))


@query("SELECT station_id, mode_racks AS rack_count FROM (SELECT station_id, CAST(event_id % 5 * 5 + 10 AS INTEGER) AS mode_racks, count(*) AS n FROM v_stock GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY n DESC, mode_racks) = 1")
def agg12_mode_rack_count(spark, d):
    return S.mode_rack_count(v_stock(spark, d).withColumn("rack_count", (F.col("event_id") % 5 * 5 + 10).cast("int")), "station_id", "rack_count")


@query(
    """SELECT l.event_id, r.value AS anchor_value, (CAST(epoch(date_trunc('second', l.ts)) AS BIGINT) - CAST(epoch(date_trunc('second', r.ts)) AS BIGINT)) / 60 AS minutes_since
    FROM (SELECT * FROM events WHERE event_type = 'click') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND l.ts >= r.ts"""
)
def joi08_asof_backward(spark, d):
    e = read(spark, d, "events")
    left = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return S.asof_backward(left, v_anchor(spark, d), "user_id", "ts", ["value"], "anchor_id").select("event_id", "anchor_value", "minutes_since")


@query(
    """SELECT event_id, CAST(coalesce(sum(cnt) FILTER (WHERE kind = 'rent') OVER w, 0) AS BIGINT) AS rent_next_60, CAST(coalesce(sum(cnt) FILTER (WHERE kind = 'return') OVER w, 0) AS BIGINT) AS ret_next_60
    FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM v_rental) WINDOW w AS (PARTITION BY station_id ORDER BY sec RANGE BETWEEN 1 FOLLOWING AND 3600 FOLLOWING)"""
)
def win13_forward_sum(spark, d):
    r = v_rental(spark, d).select("event_id", "station_id", "ts", F.when(F.col("kind") == "rent", F.col("cnt")).otherwise(0).alias("rent"), F.when(F.col("kind") == "return", F.col("cnt")).otherwise(0).alias("ret"))
    return S.forward_sum(r, "station_id", "ts", ["rent", "ret"], 60).select("event_id", "rent_next_60", "ret_next_60")


@query("SELECT event_id, CAST(coalesce(sum(cnt) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 FOLLOWING), 0) AS BIGINT) AS cnt_next_30 FROM v_rental")
def win13_forward_rows(spark, d):
    return S.forward_sum(v_rental(spark, d), "station_id", "ts", ["cnt"], 30, frame="rows_compat").select("event_id", "cnt_next_30")


OLD, NEW = "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier WHERE s_suppkey % 3 <> 0", "SELECT s_suppkey AS id, upper(s_name) AS name, -s_acctbal AS balance FROM supplier WHERE s_suppkey % 2 = 0"


def versions(spark, d):
    s = read(spark, d, "supplier")
    old = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return old, s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("id"), F.upper("s_name").alias("name"), (-F.col("s_acctbal")).alias("balance"))


@query(f"SELECT * FROM ({NEW}) UNION ALL SELECT * FROM ({OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({NEW}) n WHERE n.id = o.id)")
def snk04_upsert(spark, d):
    return S.upsert(*versions(spark, d), ["id"])


@query(f"SELECT o.id, coalesce(n.name, o.name) AS name, coalesce(n.balance, o.balance) AS balance FROM ({OLD}) o LEFT JOIN ({NEW}) n ON n.id = o.id")
def snk04_update_only(spark, d):
    return S.upsert(*versions(spark, d), ["id"], update_only=True)


@query("SELECT station_no, date, slot, boarding FROM v_panel WHERE year(date) <> 1997 UNION ALL SELECT station_no, date, slot, -boarding FROM v_panel WHERE year(date) = 1997 AND month(date) = 3 UNION ALL SELECT station_no, date, slot, boarding FROM v_panel WHERE year(date) = 1997 AND month(date) <> 3")
def snk05_replace_dates(spark, d):
    p = v_panel(spark, d).drop("alighting")
    new = p.where("year(date) = 1997 AND month(date) = 3").withColumn("boarding", -F.col("boarding"))
    return S.replace_dates(p, new).select("station_no", "date", "slot", "boarding")


@query(f"SELECT * FROM ({NEW}) UNION ALL SELECT * FROM ({OLD}) WHERE id % 2 <> 0")
def set06_dedup_union(spark, d):
    return S.dedup_union(versions(spark, d), ["id"])


@query("SELECT station_no, CAST(date + to_years(4 * CAST(copy AS INTEGER)) AS DATE) AS date, slot, boarding, CAST(copy AS INTEGER) AS copy FROM v_panel, range(3) t(copy)")
def set05_amplify(spark, d):
    return S.amplify(v_panel(spark, d).drop("alighting"), 3, "date")


@query("SELECT p_name AS name, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_name FROM part)")
def ml04_station_index(spark, d):
    return S.station_index(read(spark, d, "part").select(F.col("p_name").alias("name")), "name")


@query("SELECT s_suppkey, n_name AS name, code FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN (SELECT n_name AS nm, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT n_name FROM nation)) ON nm = n_name")
def ml04_encode_station(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    rows = read(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "name")
    return S.encode_station(rows, S.station_index(n, "name"), "name").select("s_suppkey", "name", "code")


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'only_right' WHEN b.id IS NULL THEN 'only_left' ELSE 'matched' END AS status FROM (SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0) b ON a.id = b.id")
def joi31_station_master_merge(spark, d):
    a = read(spark, d, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id"))
    b = read(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return S.station_status(a, b, "id")
