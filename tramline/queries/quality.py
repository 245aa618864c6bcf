"""Queries of the data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import crowding as C
from tramline.operators import network as N
from tramline.operators import panel as P
from tramline.operators import quality as Q
from tramline.queries.base import query, read, rounded, v_dow, v_game, v_panel, v_station, v_stock
from tramline.queries.crowding import LINE, line_month
from tramline.queries.panel import KEY


@query("WITH c AS (SELECT station_id, CAST(floor(epoch(collected_at) / 300) AS BIGINT) AS slot, count(*) AS n, count_if(stock < 0) AS neg, count_if(racks IS NULL) AS nulls FROM v_stock GROUP BY 1, 2) SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(sum(nulls) AS BIGINT) AS nulls, CAST(sum(neg) AS BIGINT) AS negatives, CAST(count_if(n > 1) AS BIGINT) AS duplicate_keys, CASE WHEN sum(n) < 100 THEN 'few_rows' WHEN sum(nulls) > 0 THEN 'nulls' WHEN sum(neg) > 0 THEN 'negatives' WHEN count_if(n > 1) > 0 THEN 'duplicates' ELSE 'ok' END AS verdict FROM c")
def dq01_stock_table(spark, d):
    s = v_stock(spark, d).withColumn("slot", F.floor(F.unix_timestamp(F.col("collected_at").cast("timestamp")) / 300))
    return Q.table_check(s, ["station_id", "slot"], ["station_id", "stock", "racks"], ["stock", "racks"], 100)


@query("SELECT CAST(len(list_filter(['view', 'click', 'storm'], lambda x: NOT list_contains(list(DISTINCT event_type), x))) AS INTEGER) AS missing_sources, count(value) AS n_value, CAST(count_if(NOT value BETWEEN 0 AND 300) AS BIGINT) AS out_value, 'missing_source' AS verdict FROM events")
def dq02_weather_table(spark, d):
    return Q.range_check(read(spark, d, "events").withColumnRenamed("event_type", "source"), {"value": (0, 300)}, ["view", "click", "storm"])


@query("SELECT count(*) AS rows, 0::BIGINT AS nulls, CAST(count_if(boarding < 10) AS BIGINT) AS negatives, 0::BIGINT AS duplicate_keys, CASE WHEN count_if(boarding < 10) > 0 THEN 'negatives' ELSE 'ok' END AS verdict FROM v_panel")
def dq03_crowd_table(spark, d):
    return Q.table_check(v_panel(spark, d).withColumn("boarding", F.col("boarding") - 10), ["station_no", "date", "slot"], ["boarding"], ["boarding"])


@query("SELECT event_type, round((epoch(TIMESTAMP '2024-02-01') - floor(epoch(max(ts)))) / 60, 4) AS age_minutes, CAST(count_if((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 60 > 20000) AS BIGINT) AS stale_rows, count(*) AS n FROM events GROUP BY 1")
def dq04_freshness(spark, d):
    return rounded(Q.freshness_check(read(spark, d, "events"), ["event_type"], "ts", F.lit("2024-02-01").cast("timestamp_ntz"), 20000), 4)


@query("WITH h AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-31 20:00:00', TIMESTAMP '2024-01-10 00:00:00', INTERVAL 1 HOUR)) AS hour) SELECT CAST(epoch(h.hour) AS BIGINT) AS hour, count(DISTINCT e.user_id) AS runs, count(DISTINCT e.user_id) >= 12 AS complete FROM h LEFT JOIN events e ON date_trunc('hour', e.ts) = h.hour GROUP BY 1")
def dq05_hourly_completeness(spark, d):
    t = lambda x: F.lit(x).cast("timestamp")
    out = Q.hourly_completeness(read(spark, d, "events"), "ts", F.col("user_id"), t("2023-12-31 20:00:00"), t("2024-01-10 00:00:00"), 12)
    return out.withColumn("hour", F.unix_timestamp("hour"))


@query("SELECT unnest(list_filter([CASE WHEN length(name) > 17 THEN 'name_length' END, CASE WHEN NOT lat BETWEEN 37.4 AND 37.6 THEN 'lat' END, CASE WHEN NOT lon BETWEEN 126.8 AND 127.1 THEN 'lon' END], lambda x: x IS NOT NULL)) AS rule, CAST(station_no AS VARCHAR) AS key FROM v_station")
def dq06_master_tables(spark, d):
    s = v_station(spark, d)
    return Q.rule_violations(s, {"name_length": F.length("name") <= 17, "lat": F.col("lat").between(37.4, 37.6), "lon": F.col("lon").between(126.8, 127.1)}, "station_no")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq13_duplicate_inventory(spark, d):
    return Q.duplicate_keys(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT rule, key FROM (SELECT unnest(list_filter([CASE WHEN NOT l_discount BETWEEN 0 AND 0.08 THEN 'range' END, CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'enum' END], lambda x: x IS NOT NULL)) AS rule, CAST(l_orderkey AS VARCHAR) AS key FROM lineitem) UNION ALL SELECT DISTINCT 'unknown', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)")
def dq07_predictions(spark, d):
    i = read(spark, d, "lineitem")
    bad = Q.rule_violations(i, {"range": F.col("l_discount").between(0, 0.08), "enum": F.col("l_returnflag").isin("A", "N")}, "l_orderkey")
    known = read(spark, d, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return bad.union(Q.unknown_refs(i, known, "l_orderkey").select(F.lit("unknown"), F.col("l_orderkey").cast("string")))


@query("WITH e AS (SELECT o_custkey % 120 AS f, o_orderkey % 120 AS t, o_totalprice > 5000 AS ok FROM orders) SELECT f AS from_id, t AS to_id, unnest(list_filter([CASE WHEN f = t THEN 'self_loop' END, CASE WHEN NOT ok THEN 'bad_time' END, CASE WHEN f NOT IN (SELECT station_no FROM v_station) THEN 'unknown_from' END, CASE WHEN t NOT IN (SELECT station_no FROM v_station) THEN 'unknown_to' END], lambda x: x IS NOT NULL)) AS finding FROM e")
def dq08_edges(spark, d):
    e = read(spark, d, "orders").select((F.col("o_custkey") % 120).alias("from_id"), (F.col("o_orderkey") % 120).alias("to_id"), (F.col("o_totalprice") - 5000).alias("seconds"))
    return Q.edge_check(e, v_station(spark, d))


CHAIN = "SELECT DISTINCT c_custkey % 10 AS line, c_custkey AS a, c_custkey + 10 AS b FROM customer WHERE c_mktsegment <> 'BUILDING'"


@query(f"WITH RECURSIVE e AS ({CHAIN}), b AS (SELECT line, a, b FROM e UNION SELECT line, b, a FROM e), r(line, a, b) AS (SELECT line, a, a FROM b UNION SELECT r.line, r.a, b.b FROM r JOIN b ON b.line = r.line AND b.a = r.b), c AS (SELECT line, a, min(b) AS label FROM r GROUP BY 1, 2) SELECT line, count(DISTINCT label) AS components, count(*) AS stations FROM c GROUP BY 1")
def dq09_line_connectivity(spark, d):
    # lines break where a customer's segment says so
    o = read(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    e = o.select((F.col("c_custkey") % 10).alias("line"), F.col("c_custkey").alias("a"), (F.col("c_custkey") + 10).alias("b")).distinct()
    return Q.components_per_line(N.connected(e, ["line"], "a", "b"))


@query("SELECT station_no, round(sum(boarding), 4) AS before, round(sum(boarding), 4) AS after, true AS kept FROM v_panel GROUP BY 1")
def dq10_mass_conservation(spark, d):
    p = v_panel(spark, d)
    return rounded(Q.mass_check(p, P.reshape_service_day(p, ["station_no", "date"], "slot", "boarding"), ["station_no"], "boarding", "boarding"), 4)


@query("SELECT station_no, slot, round(avg(alighting) - 40, 6) AS error FROM v_panel GROUP BY 1, 2 HAVING abs(avg(alighting) - 40) > 1")
def dq11_calibration_identity(spark, d):
    snap = v_panel(spark, d).select(*KEY).distinct().withColumn("target", F.lit(40.0))
    return rounded(Q.calibration_identity(v_panel(spark, d), snap, KEY, "alighting", "target", 1.0))


@query(f"WITH l AS ({LINE}) SELECT line, m::INTEGER AS m, 0.0::DOUBLE AS up_left, 0.0::DOUBLE AS down_left FROM l GROUP BY 1, 2")
def dq12_terminal_residual(spark, d):
    return rounded(Q.terminal_residual(C.linear_loads(line_month(spark, d), ["line", "m"]), ["line", "m"], "seq"), 3)


@query("SELECT place, min(date) AS first, max(date) AS last, min(date) <= (SELECT min(date) FROM v_panel) AND max(date) >= (SELECT max(date) FROM v_panel) AS covers FROM v_game GROUP BY 1")
def dq14_source_coverage(spark, d):
    return Q.coverage(v_game(spark, d), v_panel(spark, d), "place")


@query("SELECT CASE WHEN event_id % 4 = 0 THEN 'unknown_code' ELSE 'bad_value' END AS reason, count(*) AS n FROM events WHERE event_id % 4 = 0 OR event_type = 'error' GROUP BY 1")
def dq15_load_predictions(spark, d):
    raw = read(spark, d, "events").select((F.col("event_id") % 4).cast("string").alias("code"), F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    codes = spark.range(1, 4).select(F.col("id").cast("string").alias("code"), F.col("id").alias("station_no"))
    return Q.load_predictions(raw, codes, "code", {"value": "double"}, ["value"])[1]


def two_runs(spark, d):
    p = v_panel(spark, d)
    moved = p.where("slot <> 3").withColumn("boarding", F.col("boarding") + F.when(F.col("slot") == 2, 5).otherwise(0)).unionByName(p.where("slot = 1").withColumn("slot", F.lit(9)))
    return p, moved


@query("SELECT count_if(slot <> 3)::BIGINT AS both, count_if(slot = 3)::BIGINT AS left_only, count_if(slot = 1)::BIGINT AS right_only, 5.0::DOUBLE AS max_error_boarding FROM v_panel")
def dq16_compare_frames(spark, d):
    return Q.compare_frames(*two_runs(spark, d), ["station_no", "date", "slot"], ["boarding"])


@query("SELECT CASE slot WHEN 3 THEN 'left' WHEN 2 THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM v_panel GROUP BY 1 UNION ALL SELECT 'right', count(*) FROM v_panel WHERE slot = 1")
def dq17_table_diff(spark, d):
    return Q.table_diff(*two_runs(spark, d), ["station_no", "date", "slot"], ["boarding", "alighting"])


@query("WITH m AS (SELECT boarding AS x, boarding + CASE WHEN slot = 2 THEN 5 ELSE 0 END AS y, slot FROM v_panel WHERE slot <> 3) SELECT round(avg(abs(y - x)), 6) AS mean, quantile_cont(abs(y - x), 0.5) AS median, quantile_cont(abs(y - x), 0.95) AS p95, max(abs(y - x)) AS largest, round(avg(CAST((x >= 30) <> (y >= 30) AS INTEGER)), 6) AS grade_changed, 1.0::DOUBLE AS status_same FROM m")
def dq18_drift(spark, d):
    a, b = (t.withColumn("status", F.lit("ok")) for t in two_runs(spark, d))
    return rounded(Q.drift(a, b, ["station_no", "date", "slot"], "boarding", (F.col("boarding") >= 30).cast("int"), "status"))


PART = "SELECT count(*) AS {p}_rows, min(date) AS {p}_first, max(date) AS {p}_last, round(avg(boarding - 25), 6) AS {p}_mean, round(avg(CAST(boarding > 25 AS INTEGER)), 6) AS {p}_up, count(DISTINCT slot) AS {p}_horizons FROM v_panel WHERE {w}"


@query(f"SELECT *, true AS same_schema, train_last < test_first AS split_clean, 'alighting' AS leaks FROM ({PART.format(p='train', w=chr(100) + 'ate < DATE ' + chr(39) + '1999-01-01' + chr(39) + ' AND station_no % 7 <> 0')}), ({PART.format(p='test', w=chr(100) + 'ate >= DATE ' + chr(39) + '1999-01-01' + chr(39))}), (SELECT count(DISTINCT station_no) AS new_stations FROM v_panel WHERE date >= DATE '1999-01-01' AND station_no % 7 = 0)")
def dq19_dataset_report(spark, d):
    p = v_panel(spark, d).withColumn("y", F.col("boarding") - 25)
    return rounded(Q.dataset_report(p.where("date < DATE '1999-01-01' AND station_no % 7 <> 0"), p.where("date >= DATE '1999-01-01'"), "station_no", "date", "slot", "y", ["alighting", "future"]))
