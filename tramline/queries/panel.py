"""Queries of the panel operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions import timefn as T
from tramline.operators import panel as P
from tramline.queries.base import parts, query, read, rounded, v_dow, v_long, v_panel, v_pred, v_station, v_stock

KEY = ["station_no", "slot"]


@query("SELECT 'train' AS part, count(*) AS n, round(sum(boarding), 4) AS total FROM v_panel WHERE date < DATE '1999-01-01' UNION ALL SELECT 'test', count(*), round(sum(boarding), 4) FROM v_panel WHERE date >= DATE '1999-01-01'")
def prj04_time_split(spark, d):
    parts = P.time_split(v_panel(spark, d), F.lit("1999-01-01").cast("date"))
    a, b = (x.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("boarding"), 4).alias("total")) for x in parts)
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


@query("SELECT 'same_year' AS variant, count(*) AS n FROM v_panel WHERE year(date) = 1998 UNION ALL SELECT 'near', count(*) FROM v_panel WHERE abs(date_diff('day', DATE '1998-06-15', date)) <= 28 UNION ALL SELECT 'all', count(*) FROM v_panel")
def prj05_fit_window(spark, d):
    p, at = v_panel(spark, d), F.lit("1998-06-15").cast("date")
    out = None
    for v in ("same_year", "near", "all"):
        one = P.fit_window(p, v, at).agg(F.count(F.lit(1)).alias("n")).withColumn("variant", F.lit(v))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT id, place FROM v_game WHERE place IN ('1-URGENT', '5-LOW')")
def prj06_in_set(spark, d):
    from tramline.queries.base import v_game

    return v_game(spark, d).where(F.col("place").isin("1-URGENT", "5-LOW")).select("id", "place")


@query("SELECT station_no, lat BETWEEN 37.45 AND 37.6 AND lon BETWEEN 126.9 AND 127.1 AS inside FROM v_station")
def prj07_bounding_box(spark, d):
    return v_station(spark, d).select("station_no", (F.col("lat").between(37.45, 37.6) & F.col("lon").between(126.9, 127.1)).alias("inside"))


@query("SELECT station_no, date, slot, round(lookup, 6) AS boarding_lookup FROM v_pred")
def joi02_lookup_join(spark, d):
    p = v_dow(spark, d)
    return rounded(P.lookup_join(p, P.lookup_means(p, [*KEY, "dow_type"], ["boarding"]), [*KEY, "dow_type"]).select("station_no", "date", "slot", "boarding_lookup"))


@query("SELECT station_no, date, slot, round(boarding - lookup, 6) AS boarding_residual FROM v_pred")
def prj09_residual_cols(spark, d):
    p = v_dow(spark, d)
    out = P.lookup_join(p, P.lookup_means(p, [*KEY, "dow_type"], ["boarding"]), [*KEY, "dow_type"])
    return rounded(P.residual_cols(out, ["boarding"]).select("station_no", "date", "slot", "boarding_residual"))


LAGS = "SELECT p.station_no, p.date, p.slot, p.boarding, a.boarding AS boarding_lag1d, b.boarding AS boarding_lag7d FROM v_panel p LEFT JOIN v_panel a ON a.station_no = p.station_no AND a.slot = p.slot AND a.date = p.date - 1 LEFT JOIN v_panel b ON b.station_no = p.station_no AND b.slot = p.slot AND b.date = p.date - 7"


@query(LAGS)
def joi05_day_lags(spark, d):
    return P.day_lags(v_panel(spark, d), KEY, ["boarding"])


@query("SELECT p.station_no, p.date, p.slot, a.boarding AS boarding_prev FROM v_panel p LEFT JOIN v_panel a ON a.station_no = p.station_no AND a.date = p.date AND a.slot = p.slot - 1")
def joi06_slot_lag(spark, d):
    return P.slot_lag(v_panel(spark, d), ["station_no", "date"], "slot", ["boarding"]).select("station_no", "date", "slot", "boarding_prev")


@query("SELECT station_no, date, slot, CASE WHEN date_diff('day', lag(date) OVER w, date) <= 14 THEN lag(boarding) OVER w END AS boarding_same_type FROM v_dow WINDOW w AS (PARTITION BY station_no, slot, dow_type ORDER BY date)")
def win04_same_day_type_lag(spark, d):
    return P.same_day_type_lag(v_dow(spark, d), [*KEY, "dow_type"], "boarding").select("station_no", "date", "slot", "boarding_same_type")


WEATHER = "SELECT CAST(l_shipdate AS DATE) AS date, l_linenumber + 19 AS hour, max(l_tax) AS temp FROM lineitem GROUP BY 1, 2 UNION ALL SELECT CAST(l_shipdate AS DATE), l_linenumber - 1, max(l_discount) FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2"


def weather(spark, d):
    i = read(spark, d, "lineitem")
    date = F.col("l_shipdate").cast("date").alias("date")
    a = i.groupBy(date, (F.col("l_linenumber") + 19).alias("hour")).agg(F.max("l_tax").alias("temp")).where("hour < 24")
    return a.union(i.where("l_linenumber <= 2").groupBy(date, (F.col("l_linenumber") - 1).alias("hour")).agg(F.max("l_discount").alias("temp")))


@query(f"WITH w AS (SELECT * FROM ({WEATHER}) WHERE hour < 24) SELECT p.station_no, p.date, p.slot, w.temp FROM v_panel p LEFT JOIN w ON w.date = p.date + CAST((p.slot + 18) // 24 AS INTEGER) AND w.hour = (p.slot + 18) % 24")
def joi07_attach_weather(spark, d):
    return P.attach_weather(v_panel(spark, d), weather(spark, d), F.col("slot") + 18).select("station_no", "date", "slot", "temp")


@query("SELECT station_no, slot, round(sum(w * boarding) / nullif(sum(w), 0), 6) AS boarding FROM (SELECT *, CASE WHEN year(date) = 1998 THEN 2.0 WHEN year(date) = 1997 THEN 0.5 ELSE 1.0 END AS w FROM v_panel WHERE boarding > 10) GROUP BY 1, 2")
def agg04_weighted_mean(spark, d):
    df = v_panel(spark, d).withColumn("boarding", F.when(F.col("boarding") > 10, F.col("boarding")))
    return rounded(P.weighted_mean(df, KEY, "boarding", P.year_weight(F.col("date"), {1998: 2.0, 1997: 0.5})))


@query("SELECT year(date) AS year, CAST(count(*) AS BIGINT) AS n, CASE WHEN year(date) = 1998 THEN 2.0 WHEN year(date) = 1997 THEN 0.5 ELSE 1.0 END::DOUBLE AS weight FROM v_panel GROUP BY ALL", "prj16_year_weight")
def prj16(spark, d):
    return v_panel(spark, d).groupBy(F.year("date").cast("long").alias("year"), P.year_weight(F.col("date"), {1998: 2.0, 1997: 0.5}).alias("weight")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT station_no, slot, round(avg(boarding), 6) AS mean, round(stddev_samp(boarding), 6) AS sd, count(boarding) AS n, round(quantile_cont(boarding, 0.5), 6) AS p50, round(quantile_cont(boarding, 0.9), 6) AS p90 FROM v_panel GROUP BY 1, 2")
def agg05_ratio_agg(spark, d):
    return rounded(P.ratio_quantiles(v_panel(spark, d), KEY, "boarding"))


@query("SELECT station_no, date, slot, boarding, alighting FROM v_panel")
def agg06_pivot_direction(spark, d):
    return P.pivot_direction(v_long(spark, d), ["station_no", "date", "slot"])


@query("SELECT id, printf('%02d', h) AS hour, v AS passengers FROM (SELECT s_suppkey AS id, 5 AS h, s_acctbal AS v FROM supplier UNION ALL SELECT s_suppkey, 17, -s_acctbal FROM supplier)")
def src10_unpivot_hours(spark, d):
    wide = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("5시"), (-F.col("s_acctbal")).alias("hour_17"))
    return P.unpivot_hours(wide, ["id"], ["5시", "hour_17"])


@query("SELECT station_no, CASE WHEN h <= 4 THEN date - 1 ELSE date END AS date, CASE WHEN h <= 4 THEN '24~' WHEN h <= 5 THEN '~06' ELSE printf('%02d-%02d', h, h + 1) END AS slot, sum(boarding) AS boarding FROM (SELECT *, CAST(slot AS BIGINT) AS h FROM v_panel) GROUP BY 1, 2, 3")
def win23_reshape_service_day(spark, d):
    return P.reshape_service_day(v_panel(spark, d), ["station_no", "date"], "slot", "boarding")


@query("SELECT station_no, date, slot, round(boarding - avg(boarding) OVER (PARTITION BY station_no, slot), 6) AS boarding_demeaned FROM v_panel")
def win15_demean(spark, d):
    return rounded(P.demean(v_panel(spark, d), KEY, "boarding").select("station_no", "date", "slot", "boarding_demeaned"))


@query("SELECT station_no, date, slot, CASE WHEN count(boarding) OVER w = 7 THEN round(avg(boarding) OVER w, 6) END AS boarding_smooth FROM v_panel WINDOW w AS (PARTITION BY station_no, slot ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def win22_centered_moving_avg(spark, d):
    return rounded(P.centered_moving_avg(v_panel(spark, d), KEY, "date", "boarding").select("station_no", "date", "slot", "boarding_smooth"))


@query("SELECT station_no, slot, dow_type, round(avg(boarding), 6) AS mean, count(boarding) AS n FROM v_dow GROUP BY ALL")
def agg16_raw_hourly_mean(spark, d):
    return rounded(P.raw_hourly_mean(v_dow(spark, d), [*KEY, "dow_type"], "boarding"))


@query("WITH snap AS (SELECT station_no, slot, max(boarding) AS share FROM v_panel WHERE year(date) = 1998 GROUP BY ALL), m AS (SELECT station_no, slot, avg(boarding) AS mean FROM v_panel WHERE slot > 1 GROUP BY ALL) SELECT station_no, slot, share, round(mean, 6) AS mean, round(share / nullif(mean, 0), 6) AS ratio, mean IS NOT NULL AS matched FROM snap LEFT JOIN m USING (station_no, slot)")
def agg17_calibration_ratio(spark, d):
    p = v_panel(spark, d)
    snap = p.where("year(date) = 1998").groupBy(*KEY).agg(F.max("boarding").alias("share"))
    return rounded(P.calibration_ratio(snap, P.raw_hourly_mean(p.where("slot > 1"), KEY, "boarding"), KEY, "share"))


HALF = "SELECT station_no, slot // 2 AS hour, slot, direction, avg(passengers) AS ratio FROM v_long GROUP BY ALL"


@query(f"WITH h AS ({HALF}), s AS (SELECT *, ratio / nullif(sum(ratio) OVER (PARTITION BY station_no, direction, hour), 0) AS s FROM h), m AS (SELECT station_no, hour, slot, avg(s) AS m FROM s GROUP BY ALL) SELECT station_no, hour::BIGINT AS hour, slot, round(m / nullif(sum(m) OVER (PARTITION BY station_no, hour), 0), 6) AS share FROM m")
def agg18_half_hour_shares(spark, d):
    h = v_long(spark, d).groupBy("station_no", F.floor(F.col("slot") / 2).alias("hour"), "slot", "direction").agg(F.avg("passengers").alias("ratio"))
    return rounded(P.half_hour_shares(h, ["station_no", "direction"], "hour", "slot", "ratio"))


@query("SELECT l_suppkey AS station_no, 'boarding' AS direction, sum(l_quantity) AS passengers FROM lineitem GROUP BY 1 UNION ALL SELECT l_suppkey, 'alighting', round(sum(l_extendedprice), 4) FROM lineitem GROUP BY 1")
def agg19_ridership_sum_long(spark, d):
    i = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("station_no"), F.col("l_quantity").alias("boarding"), F.col("l_extendedprice").alias("alighting"))
    return rounded(P.ridership_sum_long(i, ["station_no"], ["boarding", "alighting"]), 4)


BREAK = "SELECT station_no, n, round(sqrt(sse / n), 6) AS rmse, round(n / sum(n) OVER (), 9) AS row_share, round(sse / sum(sse) OVER (), 9) AS error_share, round((sse / sum(sse) OVER ()) / (n / sum(n) OVER ()), 6) AS skew FROM (SELECT station_no, count(*) AS n, sum((boarding - lookup) ** 2) AS sse FROM v_pred GROUP BY 1)"


def breakdown(spark, d):
    return P.residual_breakdown(v_pred(spark, d), ["station_no"], F.col("boarding") - F.col("lookup")).withColumns({"rmse": F.round("rmse", 6), "row_share": F.round("row_share", 9), "error_share": F.round("error_share", 9), "skew": F.round("skew", 6)})


@query(BREAK)
def agg20_residual_breakdown(spark, d):
    return breakdown(spark, d)


@query(f"SELECT * FROM ({BREAK}) ORDER BY skew DESC, station_no LIMIT 10")
def top05_top_skew_stations(spark, d):
    return P.top_skew(breakdown(spark, d), 10, "station_no")


@query("SELECT p_size AS id, list_sort(list(DISTINCT p_type)) AS names FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def agg21_name_inventory(spark, d):
    return P.name_inventory(read(spark, d, "part").select(F.col("p_size").alias("id"), "p_type"), "id", "p_type")


@query("SELECT o_orderpriority AS place, count_if(o_orderstatus = 'O')::BIGINT AS \"O\", count_if(o_orderstatus = 'P')::BIGINT AS \"P\", count_if(o_orderstatus = 'F')::BIGINT AS \"F\" FROM orders GROUP BY 1")
def agg22_crosstab(spark, d):
    return P.crosstab(read(spark, d, "orders").withColumnRenamed("o_orderpriority", "place"), "place", "o_orderstatus", ["O", "P", "F"])


@query("SELECT station_no, " + ", ".join(f"round(avg(boarding) FILTER (WHERE slot = {s}), 6) AS slot_{s}" for s in range(1, 8)) + " FROM v_panel GROUP BY 1")
def agg23_static_profile_pivot(spark, d):
    return rounded(P.static_profile(v_panel(spark, d), "station_no", "slot", "boarding", range(1, 8)))


@query("WITH p AS (SELECT * FROM v_panel) SELECT a.station_no, a.date, b.slot FROM (SELECT DISTINCT station_no, date FROM p) a, (SELECT DISTINCT slot FROM p) b WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.station_no = a.station_no AND p.date = a.date AND p.slot = b.slot)")
def agg23_missing_cells(spark, d):
    return P.missing_cells(v_panel(spark, d), ["station_no", "date"], "slot")


@query("SELECT station_no, year, total, round((total - prev) / nullif(prev, 0), 6) AS change FROM (SELECT *, CASE WHEN lag(year) OVER w = year - 1 THEN lag(total) OVER w END AS prev FROM (SELECT station_no, CAST(year(date) AS INTEGER) AS year, sum(boarding) AS total FROM v_panel GROUP BY 1, 2) WINDOW w AS (PARTITION BY station_no ORDER BY year))")
def agg24_yoy_change(spark, d):
    return rounded(P.yoy_change(v_panel(spark, d).withColumn("year", F.year("date")), ["station_no"], "year", "boarding"))


@query("SELECT CAST(hour(collected_at) AS INTEGER) AS hour, count(stock) AS n, round(avg(stock), 6) AS mean, round(stddev_samp(stock), 6) AS sd, min(stock) AS least, max(stock) AS most, median(stock) AS median, round(avg(CAST(stock = 0 AS INTEGER)), 6) AS p_zero, round(avg(CAST(stock <= 2 AS INTEGER)), 6) AS p_two FROM v_stock GROUP BY 1")
def agg25_inventory_distribution(spark, d):
    return rounded(P.inventory_distribution(v_stock(spark, d).withColumn("hour", F.hour("collected_at")), "hour", "stock"))


@query("SELECT CAST((dayofweek(date) + 6) % 7 AS INTEGER) AS dow, " + ", ".join(f"round(avg(stock) FILTER (WHERE hour(collected_at) = {h}), 6) AS h{h}" for h in range(24)) + " FROM v_stock GROUP BY 1")
def agg26_dow_hour_heatmap(spark, d):
    return rounded(P.heatmap(v_stock(spark, d), T.mon0_dow(F.col("date")), F.hour("collected_at"), "stock", range(24)))


@query("SELECT CASE WHEN alighting < 20 THEN 'low' WHEN alighting < 60 THEN 'mid' ELSE 'high' END AS bin, round(avg(boarding), 6) AS mean, median(boarding) AS median, count(boarding) AS n FROM v_panel GROUP BY 1")
def agg27_weather_bins(spark, d):
    x = F.col("alighting")
    return rounded(P.binned(v_panel(spark, d), F.when(x < 20, "low").when(x < 60, "mid").otherwise("high"), "boarding"))


@query("WITH e AS (SELECT quantile_cont(alighting, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM v_panel) SELECT CAST(len(list_filter(q, lambda t: alighting > t)) AS INTEGER) AS bin, round(avg(alighting), 6) AS x_mean, round(avg(boarding), 6) AS y_mean, count(*) AS n FROM v_panel, e GROUP BY 1")
def agg27_weather_deciles(spark, d):
    return rounded(P.decile_bins(v_panel(spark, d), "alighting", "boarding"))


@query("SELECT round(corr(boarding, alighting), 6) AS raw, round(corr(b, a), 6) AS demeaned FROM (SELECT *, boarding - avg(boarding) OVER (PARTITION BY slot) AS b, alighting - avg(alighting) OVER (PARTITION BY slot) AS a FROM v_panel)")
def agg27_demeaned_correlation(spark, d):
    p = P.demean(P.demean(v_panel(spark, d), ["slot"], "boarding"), ["slot"], "alighting")
    return rounded(p.agg(F.corr("boarding", "alighting").alias("raw"), F.corr("boarding_demeaned", "alighting_demeaned").alias("demeaned")))


@query("SELECT station_no, round(median(boarding), 6) AS median, round((quantile_cont(boarding, 0.75) - quantile_cont(boarding, 0.25)) / nullif(median(boarding), 0), 6) AS dispersion FROM v_panel GROUP BY 1")
def agg31_dispersion(spark, d):
    return rounded(P.dispersion(v_panel(spark, d), ["station_no"], "boarding"))


@query("WITH p AS (SELECT line, station_no, boarding FROM v_panel JOIN v_station USING (station_no)), l AS (SELECT line, median(boarding) AS line_median FROM p GROUP BY 1) SELECT line, station_no, station_median, line_median, station_median - line_median AS deviation FROM (SELECT line, station_no, median(boarding) AS station_median FROM p GROUP BY 1, 2) JOIN l USING (line)")
def agg31_median_deviation(spark, d):
    p = v_panel(spark, d).join(v_station(spark, d).select("station_no", "line"), "station_no")
    return P.median_deviation(p, "line", "station_no", "boarding")


@query("WITH r AS (SELECT boarding, alighting, rank() OVER (ORDER BY boarding) + (count(*) OVER (PARTITION BY boarding) - 1) / 2.0 AS rx, rank() OVER (ORDER BY alighting) + (count(*) OVER (PARTITION BY alighting) - 1) / 2.0 AS ry FROM v_panel) SELECT round(corr(boarding, alighting), 6) AS pearson, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r")
def agg32_pearson_spearman(spark, d):
    return rounded(P.pearson_spearman(v_panel(spark, d), "boarding", "alighting"))


@query("SELECT station_no, slot, round(greatest(coalesce(stddev_pop(boarding), 1), 1), 6) AS scale FROM v_panel GROUP BY 1, 2")
def agg40_scale_table(spark, d):
    return rounded(P.scale_table(v_panel(spark, d), KEY, "boarding"))


@query("WITH t AS (SELECT line, station_no, sum(boarding) FILTER (WHERE year(date) = 1997) AS before, sum(boarding) FILTER (WHERE year(date) = 1998) AS after FROM v_panel JOIN v_station USING (station_no) GROUP BY 1, 2), b AS (SELECT *, coalesce(abs(after / nullif(before, 0) - 1) > 0.05, true) AS broken FROM t) SELECT *, CASE WHEN bool_and(broken) OVER (PARTITION BY line) THEN 'all' WHEN bool_or(broken) OVER (PARTITION BY line) THEN 'some' ELSE 'none' END AS line_class FROM b")
def agg41_source_discontinuity(spark, d):
    p = v_panel(spark, d).join(v_station(spark, d).select("station_no", "line"), "station_no")
    return P.discontinuity(p, "line", "station_no", "date", "boarding", 1997, 1998, 0.05)


@query("WITH a AS (SELECT station_no, slot, avg(boarding) AS v FROM v_panel WHERE year(date) = 1997 GROUP BY ALL), b AS (SELECT station_no, slot, avg(boarding) AS v FROM v_panel WHERE year(date) = 1998 GROUP BY ALL), m AS (SELECT abs(b.v - a.v) / nullif(abs(a.v), 0) AS m FROM a JOIN b USING (station_no, slot)) SELECT round(quantile_cont(m, 0.5), 6) AS median, round(quantile_cont(m, 0.9), 6) AS p90, round(max(m), 6) AS largest, round(avg(CAST(m > 0.05 AS INTEGER)), 6) AS share_over, count(m) AS n FROM m")
def agg42_ratio_change(spark, d):
    p = v_panel(spark, d)
    a, b = (p.where(F.year("date") == y).groupBy(*KEY).agg(F.avg("boarding").alias("v")) for y in (1997, 1998))
    return rounded(P.ratio_change(a, b, KEY, "v"))


@query("WITH w AS (SELECT station_no, slot, avg(boarding) FILTER (WHERE dow_type = 1) AS a, avg(boarding) FILTER (WHERE dow_type = 2) AS b FROM v_dow GROUP BY ALL) SELECT round(corr(a, b), 6) AS corr, round(avg(abs(a - b)), 6) AS gap, count(*) AS n FROM w WHERE a IS NOT NULL AND b IS NOT NULL")
def agg43_day_type_gap(spark, d):
    return rounded(P.day_type_gap(v_dow(spark, d), KEY, "dow_type", "boarding", 1, 2))


KINDS = "CASE WHEN h.is_holiday THEN 'holiday' WHEN dayofweek(p.date) = 6 THEN 'saturday' WHEN dayofweek(p.date) = 0 THEN 'sunday' ELSE 'weekday' END"


@query(f"WITH k AS (SELECT p.*, {KINDS} AS kind FROM v_panel p LEFT JOIN v_holiday h ON h.date = p.date), m AS (SELECT station_no, slot, kind, avg(boarding) AS v FROM k GROUP BY ALL), g AS (SELECT b.kind AS day_type, corr(a.v, b.v) AS corr, avg(abs(a.v - b.v)) AS gap, count(*) AS n FROM m a JOIN m b ON a.station_no = b.station_no AND a.slot = b.slot AND a.kind = 'holiday' AND b.kind <> 'holiday' GROUP BY 1) SELECT day_type, round(corr, 6) AS corr, round(gap, 6) AS gap, n, row_number() OVER (ORDER BY gap, day_type) = 1 AS nearest FROM g")
def agg43_holiday_similarity(spark, d):
    from tramline.queries.base import v_holiday

    p = v_panel(spark, d).join(v_holiday(spark, d), "date", "left")
    kind = F.when(F.col("is_holiday"), "holiday").when(F.dayofweek("date") == 7, "saturday").when(F.dayofweek("date") == 1, "sunday").otherwise("weekday")
    return rounded(P.holiday_similarity(p.withColumn("kind", kind), KEY, "kind", "boarding", "holiday", ["weekday", "saturday", "sunday"]))


@query("WITH s AS (SELECT station_no, stddev_samp(boarding) AS sd, avg(CAST(boarding <= 20 AS INTEGER)) AS low_rate FROM v_panel GROUP BY 1) SELECT station_no, round(sd, 6) AS sd, round(low_rate, 6) AS low_rate, sd >= (SELECT quantile_cont(sd, 0.9) FROM s) AS sd_high, low_rate >= (SELECT quantile_cont(low_rate, 0.9) FROM s) AS low_high FROM s")
def agg44_station_outlier_flags(spark, d):
    return rounded(P.outlier_flags(v_panel(spark, d), "station_no", "boarding"))


@query("WITH o AS (SELECT DISTINCT station_no, date, slot % 2 AS games, slot AS fests FROM v_panel) SELECT station_no, date, round((games - (SELECT avg(games) FROM o)) / coalesce(nullif((SELECT stddev_pop(games) FROM o), 0), 1), 6) AS games, round((fests - (SELECT avg(fests) FROM o)) / coalesce(nullif((SELECT stddev_pop(fests) FROM o), 0), 1), 6) AS fests FROM o")
def agg45_zscore_events(spark, d):
    p = v_panel(spark, d).select("station_no", "date", (F.col("slot") % 2).alias("games"), F.col("slot").alias("fests"))
    return rounded(P.zscore(p, "station_no", "date", ["games", "fests"]))


@query(f"SELECT station_no, date, slot, boarding, CAST(NULL AS DOUBLE) AS boarding_lag1d, boarding_lag7d FROM ({LAGS})")
def prj14_mask_lags(spark, d):
    return P.mask_lags(P.day_lags(v_panel(spark, d), KEY, ["boarding"]), ["boarding_lag1"])


@query(f"WITH l AS ({LAGS}) SELECT station_no, date, slot, boarding, CASE WHEN year(date) % 2 = 0 THEN NULL ELSE boarding_lag1d END AS boarding_lag1d, boarding_lag7d, CASE WHEN year(date) % 2 = 0 THEN 'no_d1' ELSE 'all' END AS scenario FROM l UNION ALL SELECT *, 'none' FROM l")
def prj15_mask_by_date(spark, d):
    p = P.day_lags(v_panel(spark, d), KEY, ["boarding"])
    s = v_panel(spark, d).select("date").distinct().withColumn("scenario", F.when(F.year("date") % 2 == 0, "no_d1").otherwise("all"))
    return P.mask_by_date(p, s, {"no_d1": ["boarding_lag1"], "all": []}, stack=True)


@query(f"SELECT station_no, date, slot, boarding_lag7d, CAST(NULL AS DOUBLE) AS live_stock FROM ({LAGS})")
def prj13_feature_matrix(spark, d):
    return P.feature_matrix(P.day_lags(v_panel(spark, d), KEY, ["boarding"]), ["station_no", "date", "slot", "boarding_lag7d", "live_stock"], ["live_stock"])


@query("WITH s AS (SELECT DISTINCT station_no, date FROM v_panel) SELECT p.station_no, p.date, CASE WHEN a.date IS NOT NULL AND b.date IS NOT NULL THEN 'full' WHEN a.date IS NOT NULL THEN 'd1_only' WHEN b.date IS NOT NULL THEN 'd7_only' ELSE 'no_lag' END AS route FROM s p LEFT JOIN s a ON a.station_no = p.station_no AND a.date = p.date - 1 LEFT JOIN s b ON b.station_no = p.station_no AND b.date = p.date - 7")
def prj17_route_by_availability(spark, d):
    p = v_panel(spark, d)
    return P.route_by_availability(p.select("station_no", "date").distinct(), p, "station_no", "date", parts(spark, d))


RULES = [("any", None, None), ("line3", 3, None), ("line3-seq2", 3, 2), ("seq1", None, 1)]


@query("WITH r(rule, l, s) AS (VALUES ('any', NULL, NULL), ('line3', 3, NULL), ('line3-seq2', 3, 2), ('seq1', NULL, 1)) SELECT station_no, rule FROM v_station, r WHERE (l IS NULL OR l = line) AND (s IS NULL OR s = seq) QUALIFY row_number() OVER (PARTITION BY station_no ORDER BY CAST(l IS NOT NULL AS INTEGER) + CAST(s IS NOT NULL AS INTEGER) DESC, rule DESC) = 1")
def prj17_most_specific_rule(spark, d):
    rules = spark.createDataFrame(RULES, "rule string, line int, seq int")
    return P.most_specific(v_station(spark, d), rules, ["line", "seq"], "station_no").select("station_no", "rule")


@query("WITH g AS (SELECT l_suppkey AS station_no, CAST(l_shipdate AS DATE) AS date, l_linenumber AS slot, l_quantity FROM lineitem), bad AS (SELECT DISTINCT station_no, date FROM (SELECT station_no, date, slot FROM g GROUP BY ALL HAVING count(*) > 1)) SELECT station_no, date, slot, l_quantity FROM g WHERE (station_no, date) NOT IN (SELECT (station_no, date) FROM bad)")
def joi18_drop_conflicts(spark, d):
    g = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("station_no"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_linenumber").alias("slot"), "l_quantity")
    return P.drop_conflicts(g, ["station_no", "date"], "slot")


@query("SELECT a.station_no, b.station_no AS other FROM v_station a JOIN v_station b ON a.station_no % 40 = b.station_no % 40 AND a.station_no <> b.station_no")
def joi21_transfer_map(spark, d):
    return P.transfer_map(v_station(spark, d).withColumn("name", F.concat(F.lit("S"), F.col("station_no") % 40)))


NEIGHBORS = "SELECT DISTINCT a.line, a.station_no, b.station_no AS other FROM v_station a JOIN v_station b ON a.line = b.line AND abs(a.seq - b.seq) = 1"
RING = "SELECT DISTINCT a.line, a.station_no, b.station_no AS other FROM v_station a JOIN v_station b ON a.line = b.line JOIN (SELECT line, max(seq) AS n FROM v_station GROUP BY 1) c ON c.line = a.line WHERE abs(a.seq - b.seq) = 1 OR (a.line % 2 = 0 AND n > 2 AND abs(a.seq - b.seq) = n - 1)"


def topology(spark, d):
    s = v_station(spark, d).groupBy("line").agg(F.array_sort(F.collect_list(F.struct("seq", "station_no"))).alias("_s"))
    return s.select("line", F.col("_s")["station_no"].alias("stations"), (F.col("line") % 2 == 0).alias("circular"))


@query(RING)
def win19_segment_neighbors(spark, d):
    return P.segment_neighbors(topology(spark, d))


@query(f"WITH n AS ({NEIGHBORS}) SELECT p.station_no, p.date, p.slot, round(avg(q.boarding), 6) AS boarding_near FROM v_panel p LEFT JOIN n ON n.station_no = p.station_no LEFT JOIN v_panel q ON q.station_no = n.other AND q.date = p.date AND q.slot = p.slot GROUP BY ALL")
def joi22_neighbor_features(spark, d):
    n = P.segment_neighbors(topology(spark, d).withColumn("circular", F.lit(False)))
    return rounded(P.neighbor_features(v_panel(spark, d), n, ["boarding"], parts=2 * parts(spark, d)).select("station_no", "date", "slot", "boarding_near"))


@query(f"WITH n AS ({NEIGHBORS}), s AS (SELECT station_no, slot, greatest(coalesce(stddev_pop(boarding), 1), 1) AS scale FROM v_panel GROUP BY 1, 2) SELECT a.station_no, a.slot, round(avg(b.scale), 6) AS scale_near FROM s a LEFT JOIN n ON n.station_no = a.station_no LEFT JOIN s b ON b.station_no = n.other AND b.slot = a.slot GROUP BY 1, 2")
def joi33_neighbor_scale(spark, d):
    n = P.segment_neighbors(topology(spark, d).withColumn("circular", F.lit(False)))
    return rounded(P.neighbor_features(P.scale_table(v_panel(spark, d), KEY, "boarding"), n, ["scale"], ["slot"]).select("station_no", "slot", "scale_near"))


@query("SELECT station_no, slot, DATE '1998-09-01' AS date FROM v_station, (SELECT DISTINCT slot FROM v_panel)")
def joi20_target_skeleton(spark, d):
    return P.target_skeleton(v_station(spark, d).select("station_no"), v_panel(spark, d).select("slot").distinct(), F.lit("1998-09-01").cast("date"))


@query("WITH pop AS (SELECT c_nationkey AS area, CAST(c_custkey % 5 AS INTEGER) AS hour, round(sum(c_acctbal), 4) AS population FROM customer GROUP BY ALL) SELECT s.station_no, s.line AS area, h.hour, pop.population FROM v_station s CROSS JOIN (SELECT CAST(range AS INTEGER) AS hour FROM range(6)) h LEFT JOIN pop ON pop.area = s.line AND pop.hour = h.hour")
def joi25_attach_population(spark, d):
    c = read(spark, d, "customer").withColumn("date", F.lit("2024-01-01").cast("date"))
    pop = c.groupBy(F.col("c_nationkey").alias("area"), (F.col("c_custkey") % 5).cast("int").alias("hour"), "date").agg(F.round(F.sum("c_acctbal"), 4).alias("population"))
    s = v_station(spark, d)
    rows = s.select("station_no").crossJoin(spark.range(6).select(F.col("id").cast("int").alias("hour"))).withColumn("date", F.lit("2024-01-01").cast("date"))
    return P.attach_population(rows, s.select("station_no", F.col("line").alias("area")), pop).select("station_no", "area", "hour", "population")


@query("SELECT n_regionkey AS area, CAST(c_custkey % 24 AS INTEGER) AS hour, round(sum(c_acctbal), 4) AS population FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def agg11_population_by_area_hour(spark, d):
    c = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.col("n_regionkey").alias("area"), (F.col("c_custkey") % 24).cast("int").alias("hour")).agg(F.round(F.sum("c_acctbal"), 4).alias("population"))


@query("SELECT p.station_no, p.date, p.slot, coalesce(e.n_games, 0) AS n_games, e.attendance FROM v_panel p LEFT JOIN (SELECT date, count(*) AS n_games, max(attendance) AS attendance FROM v_game GROUP BY 1) e ON e.date = p.date AND e.n_games > 7")
def joi27_attach_events(spark, d):
    from tramline.queries.base import v_game

    e = v_game(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n_games"), F.max("attendance").alias("attendance")).where("n_games > 7")
    return P.attach_events(v_panel(spark, d), e, ["date"], ["n_games"]).select("station_no", "date", "slot", "n_games", "attendance")


@query("SELECT station_no, date, slot, boarding FROM v_panel WHERE date <= DATE '2000-06-30' AND station_no % 4 <> 0 UNION ALL SELECT station_no, date, slot, boarding FROM v_panel WHERE date > (SELECT max(date) FROM v_panel WHERE date <= DATE '2000-06-30' AND station_no % 4 <> 0) AND station_no % 4 <> 0 AND date > DATE '2000-01-01'")
def set04_extend_with_recent(spark, d):
    p = v_panel(spark, d).drop("alighting")
    return P.extend_with_recent(p.where("date <= DATE '2000-06-30' AND station_no % 4 <> 0"), p.where("date > DATE '2000-01-01'"))


@query("SELECT c_custkey, coalesce(a.station_no, b.station_no) AS station_no FROM customer LEFT JOIN v_station a ON a.station_no * 3 = c_custkey LEFT JOIN (SELECT line, min(station_no) AS station_no FROM v_station GROUP BY 1) b ON b.line = c_nationkey AND c_custkey % 5 = 0")
def joi19_code_then_name(spark, d):
    return matched_codes(spark, d).select("c_custkey", "station_no")


def matched_codes(spark, d):
    s = v_station(spark, d)
    first = s.groupBy("line").agg(F.min("station_no").alias("station_no")).select((F.col("station_no") * 0 - 1 - F.col("line")).alias("code"), "line", F.lit("0").alias("name"), "station_no")
    master = s.select((F.col("station_no") * 3).alias("code"), (F.lit(-1) - F.col("line")).alias("line"), F.col("station_no").cast("string").alias("name"), "station_no").unionByName(first)
    c = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("code"), F.col("c_nationkey").alias("line"), (F.col("c_custkey") % 5).cast("string").alias("name"))
    return P.code_then_name(c, master, "code", "line", "name")


@query("SELECT CAST(c_nationkey AS INTEGER) AS line, CAST(c_custkey % 5 AS VARCHAR) AS name, count(*) AS rows FROM customer LEFT JOIN v_station a ON a.station_no * 3 = c_custkey LEFT JOIN (SELECT line, min(station_no) AS station_no FROM v_station GROUP BY 1) b ON b.line = c_nationkey AND c_custkey % 5 = 0 WHERE coalesce(a.station_no, b.station_no) IS NULL GROUP BY 1, 2")
def joi19_unmatched_inventory(spark, d):
    return P.unmatched_inventory(matched_codes(spark, d), "line", "name")


@query("SELECT station_no, date FROM v_panel WHERE slot = 1 INTERSECT SELECT station_no, date FROM v_panel WHERE slot = 2")
def set02_intersect_keys(spark, d):
    p = v_panel(spark, d)
    return p.where("slot = 1").select("station_no", "date").intersect(p.where("slot = 2").select("station_no", "date"))


@query("SELECT station_no, date FROM v_panel WHERE slot = 1 EXCEPT SELECT station_no, date FROM v_panel WHERE slot = 2")
def set03_except_keys(spark, d):
    p = v_panel(spark, d)
    return p.where("slot = 1").select("station_no", "date").exceptAll(p.where("slot = 2").select("station_no", "date"))


@query("SELECT s_suppkey AS id, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier UNION ALL SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def set01_union_by_name(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    b = read(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"))
    return a.unionByName(b, allowMissingColumns=True)
