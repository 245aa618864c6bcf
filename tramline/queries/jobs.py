"""Queries of the composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions.timefn import minutes_to_slot30
from tramline.operators import crowding as C
from tramline.operators import panel as P
from tramline.operators import stock as S
from tramline.plans import jobs as J
from tramline.queries import crowding as CR
from tramline.queries import events as EV
from tramline.queries import panel as PN
from tramline.queries import stock as ST
from tramline.queries.base import parts, query, read, rounded, v_anchor, v_dow, v_festival, v_game, v_holiday, v_long, v_point, v_pred, v_rental, v_station, v_stock, v_timetable


#: The profile of the last rows of each slot, under the name that the grid's SQL reads.
CLEAN = f"vr AS (SELECT station_id, dow_type, time_slot, avg(stock) AS exp_bikes, avg(CAST(stock <= 0 AS INTEGER)) AS p_empty, avg(CAST(stock >= racks AS INTEGER)) AS p_full, count(*) AS n FROM (SELECT *, {ST.SLOTS} FROM ({ST.DEDUP})) GROUP BY 1, 2, 3), vq AS (SELECT station_id, dow_type, time_slot, avg(stock + 3) AS exp_bikes, avg(CAST(stock + 3 <= 0 AS INTEGER)) AS p_empty, avg(CAST(stock + 3 >= racks AS INTEGER)) AS p_full FROM (SELECT *, {ST.SLOTS} FROM v_stock WHERE station_id % 3 <> 0) GROUP BY 1, 2, 3), vp AS (SELECT coalesce(q.station_id, r.station_id) AS station_id, coalesce(q.dow_type, r.dow_type) AS dow_type, coalesce(q.time_slot, r.time_slot) AS time_slot, {', '.join(f'CASE WHEN q.{v} IS NULL THEN r.{v} WHEN r.n >= 2 THEN (q.{v} * 4 + r.{v} * r.n) / (4 + r.n) ELSE q.{v} END AS {v}' for v in S.VALUES)} FROM vq q FULL JOIN vr r ON r.station_id = q.station_id AND r.dow_type = q.dow_type AND r.time_slot = q.time_slot)"


@query(f"WITH {CLEAN} SELECT station_id, dow_type, time_slot, round(exp_bikes, 6) AS exp_bikes, source FROM ({ST.joi04_complete_grid_sql.replace('v_profile', 'vp')})")
def p1_stock_refresh(spark, d):
    rows = v_stock(spark, d).select("event_id", "station_id", "collected_at", "stock", "racks")
    # a third of the stations has no prior, and so has a cell that only the refresh saw
    prior = S.stock_profile(ST.slotted(spark, d).withColumn("stock", F.col("stock") + 3)).where("station_id % 3 <> 0")
    return rounded(J.stock_refresh(rows, prior, F.lit("2024-01-31").cast("date"), days=31, weight=4.0, least=2)[0].select("station_id", "dow_type", "time_slot", "exp_bikes", "source"))


@query(ST.AGG02)
def p2_realtime_profile(spark, d):
    raw = v_stock(spark, d).select("event_id", F.col("station_id").alias("stationId"), "collected_at", F.col("stock").cast("string").alias("stockTxt"), F.col("racks").cast("string").alias("rackTotCnt"))
    return rounded(J.realtime_profile(raw, {"stationId": "station_id", "stockTxt": "stock", "rackTotCnt": "racks"}))


#: Rental places are points of the map; those at a station's coordinates are its.
PLACES = "pl AS (SELECT p.point_id AS place_id, min(m.station_no) AS station_id FROM v_point p JOIN v_station m ON round(m.lat, 5) = round(p.lat, 5) AND round(m.lon, 5) = round(p.lon, 5) GROUP BY 1), rr AS (SELECT r.event_id, pl.station_id, ts, kind, cnt FROM v_rental r JOIN pl ON pl.place_id = r.station_id)"
FLOWS = ST.FLOW.replace("CAST(ts AS DATE) AS date, CAST((hour(ts) * 60 + minute(ts)) // 5 AS INTEGER) AS slot", "time_bucket(INTERVAL 5 MINUTE, ts) AS date, 0 AS slot").replace("v_rental", "rr")


def rental_places(spark, d):
    places = v_point(spark, d).select(F.col("point_id").alias("place_id"), (F.col("lat") + F.when(F.col("point_id") % 2 == 1, 0.000002).otherwise(0.0)).alias("lat"), "lon")
    return v_rental(spark, d).withColumnRenamed("station_id", "place_id"), places, v_station(spark, d).select(F.col("station_no").alias("station_id"), "lat", "lon")


@query(f"WITH {PLACES}, f AS ({FLOWS}) SELECT station_id, CAST(epoch(date) AS BIGINT) AS at, net_flow, r.value AS anchor_stock, CAST(coalesce(sum(net_flow) OVER (PARTITION BY station_id ORDER BY CAST(epoch(date) AS BIGINT) RANGE BETWEEN 1 FOLLOWING AND 1800 FOLLOWING), 0) AS BIGINT) AS net_flow_next_30, CAST(coalesce(sum(net_flow) OVER (PARTITION BY station_id ORDER BY CAST(epoch(date) AS BIGINT) RANGE BETWEEN 1 FOLLOWING AND 3600 FOLLOWING), 0) AS BIGINT) AS net_flow_next_60 FROM f ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON r.user_id = f.station_id AND f.date >= r.ts")
def p4_netflow_panel(spark, d):
    rentals, places, master = rental_places(spark, d)
    anchors = v_anchor(spark, d).select(F.col("user_id").alias("station_id"), "ts", F.col("value").alias("stock"), F.col("anchor_id").alias("tie"))
    return J.netflow_panel(rentals, anchors, places=places, master=master).select("station_id", F.unix_timestamp("slot_start").alias("at"), "net_flow", "anchor_stock", "net_flow_next_30", "net_flow_next_60")


@query(f"WITH {PLACES} SELECT station_id AS place_id, count(*) AS n FROM v_rental WHERE station_id NOT IN (SELECT place_id FROM pl) GROUP BY 1")
def p4_unmatched_places(spark, d):
    return J.match_stations(*rental_places(spark, d))[1]


@query(f"WITH w AS (SELECT * FROM ({PN.WEATHER}) WHERE hour < 24), e AS (SELECT date, count(*) AS n_games FROM v_game GROUP BY 1) SELECT p.station_no, p.date, p.slot, boarding, alighting, CASE WHEN dayofweek(p.date) = 6 THEN 'saturday' WHEN dayofweek(p.date) = 0 THEN 'sunday' WHEN h.is_holiday THEN 'holiday' ELSE 'weekday' END AS day_type, w.temp, coalesce(e.n_games, 0) AS n_games FROM v_panel p LEFT JOIN v_holiday h ON h.date = p.date LEFT JOIN w ON w.date = p.date + CAST((p.slot + 18) // 24 AS INTEGER) AND w.hour = (p.slot + 18) % 24 LEFT JOIN e ON e.date = p.date")
def p5_crowd_panel(spark, d):
    games = v_game(spark, d).groupBy("date").agg(F.count(F.lit(1)).alias("n_games"))
    return J.crowd_panel(v_long(spark, d), v_holiday(spark, d), PN.weather(spark, d), games).select("station_no", "date", "slot", "boarding", "alighting", "day_type", "temp", "n_games")


@query(f"WITH r AS (SELECT *, boarding - lookup AS res FROM v_pred), n AS ({PN.NEIGHBORS}), m AS (SELECT n.station_no, q.date, q.slot, avg(q.res) AS near FROM n JOIN r q ON q.station_no = n.other GROUP BY ALL) SELECT r.station_no, r.date, r.slot, round(r.res, 6) AS residual, round(a.res, 6) AS lag1d, round(b.res, 6) AS lag7d, round(c.res, 6) AS prev, round(m.near, 6) AS near FROM r LEFT JOIN r a ON a.station_no = r.station_no AND a.slot = r.slot AND a.date = r.date - 1 LEFT JOIN r b ON b.station_no = r.station_no AND b.slot = r.slot AND b.date = r.date - 7 LEFT JOIN r c ON c.station_no = r.station_no AND c.date = r.date AND c.slot = r.slot - 1 LEFT JOIN m ON m.station_no = r.station_no AND m.date = r.date AND m.slot = r.slot")
def p6_features(spark, d):
    n = P.segment_neighbors(PN.topology(spark, d).withColumn("circular", F.lit(False)))
    out = J.features(v_dow(spark, d), n, parts=6 * parts(spark, d))
    b = "boarding_residual"
    return rounded(out.select("station_no", "date", "slot", F.col(b).alias("residual"), F.col(f"{b}_lag1d").alias("lag1d"), F.col(f"{b}_lag7d").alias("lag7d"), F.col(f"{b}_prev").alias("prev"), F.col(f"{b}_near").alias("near")))


def topo(spark, d):
    return PN.topology(spark, d)


#: Loads of lines from all pairs of stations; lines of an even number are rings.
LOADS = """q AS (SELECT s.line, s.seq, p.station_no, p.date, p.slot + 5 AS hour, model - 5 AS b, alighting, lookup FROM v_pred p JOIN v_station s ON s.station_no = p.station_no),
    c AS (SELECT *, coalesce(CASE WHEN b >= 0 THEN b WHEN b < 0 THEN CASE WHEN lookup >= 0 THEN lookup ELSE 0.0 END END, 0) AS boarding, CASE WHEN b >= 0 THEN 'model' WHEN b < 0 THEN CASE WHEN lookup >= 0 THEN 'lookup' ELSE 'zero' END END AS source, row_number() OVER (PARTITION BY line, date, hour ORDER BY seq) - 1 AS k, count(*) OVER w AS n, sum(alighting) OVER w AS total FROM q WINDOW w AS (PARTITION BY line, date, hour)),
    od AS (SELECT i.line, i.date, i.hour, i.k AS i, j.k AS j, i.n, (j.k - i.k + i.n) % i.n AS up, (i.k - j.k + i.n) % i.n AS down, CASE WHEN i.total - i.alighting > 0 THEN i.boarding / (i.total - i.alighting) ELSE 0 END * j.alighting AS trips FROM c i JOIN c j ON i.line = j.line AND i.date = j.date AND i.hour = j.hour AND i.k <> j.k),
    ld AS (SELECT c.line, c.station_no, c.date, c.hour, any_value(source) AS source,
      coalesce(sum(trips) FILTER (WHERE CASE WHEN c.line % 2 = 0 THEN up <= down AND (c.k - i + c.n) % c.n < up ELSE i <= c.k AND j > c.k END), 0) AS up,
      coalesce(sum(trips) FILTER (WHERE CASE WHEN c.line % 2 = 0 THEN down < up AND (i - c.k + c.n) % c.n < down ELSE i >= c.k AND j < c.k END), 0) AS down
      FROM c LEFT JOIN od ON od.line = c.line AND od.date = c.date AND od.hour = c.hour GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {LOADS}, wy AS (SELECT station_no, date, hour, source, 'up' AS direction, up AS raw FROM ld UNION ALL SELECT station_no, date, hour, source, 'down', down FROM ld),
    hf AS (SELECT *, unnest([printf('%02d:00', hour), printf('%02d:30', hour)]) AS slot30, CASE WHEN station_no % 9 <> 0 THEN (raw + 1) * 0.5 END AS calibrated FROM wy)
    SELECT h.station_no, date, slot30, h.direction, to_station, CAST(round(CAST(calibrated AS DECIMAL(28, 9)), 4) AS DOUBLE) AS calibrated, CASE WHEN calibrated IS NOT NULL THEN CAST((round(calibrated, 9) >= 10)::INTEGER + (round(calibrated, 9) >= 20)::INTEGER + (round(calibrated, 9) >= 40)::INTEGER AS INTEGER) END AS grade,
      CASE WHEN source IS NULL THEN 'no_lookup' WHEN source = 'lookup' THEN 'calibration_fallback' WHEN calibrated IS NULL THEN 'no_calibration' ELSE 'ok' END AS status
    FROM hf h JOIN ({CR.TARGETS}) t ON t.station_no = h.station_no AND t.direction = h.direction""")
def p7_crowding(spark, d):
    from tramline.functions.timefn import half_hours

    p = v_pred(spark, d).join(v_station(spark, d).select("station_no", "line", "seq"), "station_no")
    pred = p.select("line", "seq", "station_no", "date", (F.col("slot") + 5).alias("hour"), (F.col("model") - 5).alias("boarding"), "alighting", "lookup", (F.col("line") % 2 == 0).alias("circular"))
    cal = v_station(spark, d).where("station_no % 9 <> 0").select("station_no", F.explode(F.array(F.lit("up"), F.lit("down"))).alias("direction")).crossJoin(spark.range(6, 13).select(F.explode(half_hours(F.col("id"))).alias("slot30"))).withColumns({"ratio": F.lit(0.5), "offset": F.lit(1.0)})
    out = J.crowding(pred, cal, C.link_targets(topo(spark, d)), [10, 20, 40])[0]
    # halves of the fourth decimal are common, and rounding of binary fractions leaves them to the engine: decimals go up
    return out.select("station_no", "date", "slot30", "direction", "to_station", F.round(F.col("calibrated").cast("decimal(28,9)"), 4).cast("double").alias("calibrated"), "grade", "status")


#: Trains of many stops: 97 numbers over all events. Stations lie on one or two segments, some on none. A stop's load is its
#: share of what the trains of its half hour carry on its segment.
TRAINS = f"""WITH tt AS (SELECT station_no, direction, train_id % 97 AS train_id, arr_min, min(train_id) AS stop FROM v_timetable GROUP BY 1, 2, 3, 4),
    lk AS (SELECT DISTINCT station_no, 'L' || (station_no % 5) AS segment FROM tt WHERE station_no % 11 <> 0 UNION SELECT station_no, 'X' || (station_no % 3) FROM tt WHERE station_no % 11 <> 0 AND station_no % 4 = 0),
    rn AS (SELECT *, sum(CAST(coalesce(new, false) AS INTEGER)) OVER (PARTITION BY direction, train_id ORDER BY arr_min, station_no) AS rn FROM (SELECT *, arr_min - lag(arr_min) OVER (PARTITION BY direction, train_id ORDER BY arr_min, station_no) > 20 AS new FROM tt)),
    pn AS (SELECT station_no, direction, train_id, arr_min, stop, lag(station_no) OVER r AS p, lead(station_no) OVER r AS s FROM rn WINDOW r AS (PARTITION BY direction, train_id, rn ORDER BY arr_min, station_no)),
    ft AS (SELECT pn.*, lk.segment, CAST(a.segment IS NOT NULL AS INTEGER) + CAST(b.segment IS NOT NULL AS INTEGER) AS score FROM pn JOIN lk ON lk.station_no = pn.station_no LEFT JOIN lk a ON a.station_no = pn.p AND a.segment = lk.segment LEFT JOIN lk b ON b.station_no = pn.s AND b.segment = lk.segment),
    ol AS (SELECT * FROM (SELECT *, sum(CAST(score > 0 AS INTEGER)) OVER (PARTITION BY station_no, direction, train_id, arr_min) AS fits FROM ft) QUALIFY row_number() OVER (PARTITION BY station_no, direction, train_id, arr_min ORDER BY CASE WHEN fits = 1 THEN CAST(score > 0 AS INTEGER) ELSE 0 END DESC, score DESC, segment) = 1),
    h AS (SELECT *, coalesce(CAST(arr_min - lag(arr_min) OVER (PARTITION BY station_no, direction, segment ORDER BY arr_min, train_id) AS DOUBLE), 30.0) AS h, printf('%02d:%02d', arr_min // 60, arr_min % 60 // 30 * 30) AS slot30 FROM ol),
    c AS (SELECT *, h / nullif(sum(h) OVER w, 0) AS share, count(DISTINCT train_id) OVER w AS trains FROM h WINDOW w AS (PARTITION BY station_no, direction, segment, slot30)), l AS (SELECT *, (40 + station_no % 20) / 100 * 160.0 * trains * share AS load FROM c),
    f AS (SELECT user_id AS station_no, hour(ts) AS hour, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2), x AS (SELECT station_no, printf('%02d:%02d', hour, k.range * 30) AS slot30, v * CASE k.range WHEN 0 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS flow FROM f, range(2) k WHERE station_no % 9 <> 0),
    z AS (SELECT l.*, flow, sum(load) OVER s AS al, sum(load) OVER d AS dl, sum(share) OVER d AS ds, count(*) OVER d AS k FROM l LEFT JOIN x ON x.station_no = l.station_no AND x.slot30 = l.slot30 WINDOW s AS (PARTITION BY l.station_no, l.slot30), d AS (PARTITION BY l.station_no, l.slot30, direction)),
    r AS (SELECT *, sum(CAST(coalesce(new, false) AS INTEGER)) OVER (PARTITION BY direction, train_id ORDER BY arr_min, station_no, stop) AS run FROM (SELECT *, arr_min - lag(arr_min) OVER (PARTITION BY direction, train_id ORDER BY arr_min, station_no, stop) > 20 AS new FROM z)),
    n AS (SELECT *, lag(station_no) OVER w AS prev, lag(load) OVER w AS q, row_number() OVER w AS i FROM r WINDOW w AS (PARTITION BY direction, train_id, run ORDER BY arr_min, station_no, stop)), g AS ({PN.RING})
    SELECT n.stop, segment, fits <> 1 AND (SELECT count(*) FROM lk WHERE lk.station_no = n.station_no) > 1 AS ambiguous, round(load, 6) AS load, round(flow * CASE WHEN al > 0 THEN dl / al END * CASE WHEN ds > 0 THEN share / ds ELSE 1.0 / k END, 6) AS boarding, CASE WHEN i = 1 THEN 0.0 WHEN g.other IS NOT NULL THEN round(q, 6) END AS arriving, CASE WHEN i = 1 THEN 'first' WHEN g.other IS NOT NULL THEN 'previous' ELSE 'not_adjacent' END AS source FROM n LEFT JOIN (SELECT DISTINCT station_no, other FROM g) g ON g.station_no = n.station_no AND g.other = n.prev"""


@query(TRAINS)
def p8_train_table(spark, d):
    from tramline.functions.timefn import half_hours

    tt = v_timetable(spark, d).groupBy("station_no", "direction", (F.col("train_id") % 97).alias("train"), "arr_min").agg(F.min("train_id").alias("stop")).withColumnRenamed("train", "train_id")
    of = F.array(F.concat(F.lit("L"), (F.col("station_no") % 5).cast("string")), F.when(F.col("station_no") % 4 == 0, F.concat(F.lit("X"), (F.col("station_no") % 3).cast("string"))))
    links = tt.where("station_no % 11 <> 0").select("station_no").distinct().select("station_no", F.explode(F.filter(of, lambda s: s.isNotNull())).alias("segment"))
    slots = C.trains_per_slot(J.one_link(tt, links), ["station_no", "direction", "segment"])
    percent = slots.select("station_no", "direction", "segment", "slot30", (F.lit(40.0) + F.col("station_no") % 20).alias("percent"))
    hourly = read(spark, d, "events").groupBy(F.col("user_id").alias("station_no"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).cast("double").alias("boarding"))
    halves = hourly.where("station_no % 9 <> 0").select("station_no", F.explode(half_hours(F.col("hour"))).alias("slot30")).distinct().withColumn("share", F.when(F.col("slot30").endswith(":00"), 0.6).otherwise(0.4))
    out = J.train_table(tt, percent, P.segment_neighbors(topo(spark, d)), hourly, halves, 160.0, links)
    return rounded(out.select("stop", "segment", "ambiguous", "load", "boarding", "arriving", "source"))


GAMES = "rg AS (SELECT *, list_sort([a, b]) AS pair FROM v_game), lg AS (SELECT *, row_number() OVER (PARTITION BY date, pair ORDER BY id) AS k FROM rg), cg AS (SELECT *, row_number() OVER (PARTITION BY date, pair ORDER BY id) AS k FROM rg WHERE id % 3 <> 0), pg AS (SELECT lg.id, lg.date, lg.place, cg.attendance FROM lg LEFT JOIN cg ON cg.date = lg.date AND cg.pair = lg.pair AND cg.k = lg.k WHERE (lg.date, lg.place) NOT IN (SELECT (date, place) FROM v_game GROUP BY date, place HAVING count(*) > 1))"


@query(f"WITH {GAMES}, v AS (SELECT o_orderpriority AS place, 37.5::DOUBLE + min(o_custkey) * 0.0001 AS lat, 126.95::DOUBLE AS lon FROM orders GROUP BY 1), near AS (SELECT DISTINCT place, station_no FROM (SELECT p.place, s.station_no, {EV.KM} AS km FROM v p, v_station s) WHERE km <= 5), g AS (SELECT station_no, date, count(*) AS n_games, CASE WHEN count(attendance) = count(*) THEN sum(attendance) END AS attendance, count(*) - count(attendance) AS n_missing FROM pg JOIN near USING (place) GROUP BY ALL), f AS (SELECT station_no, date, count(DISTINCT id) AS n_festivals FROM ({EV.DAYS}) JOIN near USING (place) GROUP BY ALL) SELECT coalesce(g.station_no, f.station_no) AS station_no, coalesce(g.date, f.date) AS date, coalesce(n_games, 0) AS n_games, round(attendance, 4) AS attendance, n_missing, coalesce(n_festivals, 0) AS n_festivals FROM g FULL JOIN f ON g.station_no = f.station_no AND g.date = f.date")
def p9_event_panel(spark, d):
    venues = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("place")).agg((F.lit(37.5) + F.min("o_custkey") * 0.0001).alias("lat")).withColumn("lon", F.lit(126.95))
    day = lambda x: F.lit(x).cast("date")
    g = v_game(spark, d)
    # the other source has two thirds of the games and names the teams the other way round
    crowds = g.where("id % 3 <> 0").select("id", "date", F.col("b").alias("a"), F.col("a").alias("b"), "attendance")
    out = J.event_panel(g.drop("attendance"), v_festival(spark, d), v_station(spark, d), venues, day("1900-01-01"), day("2100-01-01"), 5.0, crowds)
    return out.select("station_no", "date", "n_games", F.round("attendance", 4).alias("attendance"), "n_missing", "n_festivals")


@query(f"WITH s AS (SELECT *, h / nullif(sum(h) OVER w, 0) AS share FROM ({CR.HEAD}) WINDOW w AS (PARTITION BY station_no, direction, slot30)), t AS (SELECT station_no, direction, slot30, count(DISTINCT train_id) AS trains, count(*) AS stops, sum(share) AS shares FROM s GROUP BY ALL), b AS (SELECT *, (20 + station_no % 50 + stops) / 100 * 160 * trains AS before FROM t) SELECT station_no, direction, slot30, round(before, 6) AS before, round(before * coalesce(shares, stops / trains), 6) AS after, abs(before - before * coalesce(shares, stops / trains)) <= 1e-6 * greatest(before, 1) AS kept FROM b")
def p10_load_by_train(spark, d):
    tt = v_timetable(spark, d)
    # the percentage comes from the stops of the half hour
    slots = tt.groupBy("station_no", "direction", minutes_to_slot30(F.col("arr_min")).alias("slot30")).agg(F.count(F.lit(1)).alias("stops"))
    cong = slots.select("station_no", "direction", "slot30", (F.lit(20.0) + F.col("station_no") % 50 + F.col("stops")).alias("percent"))
    return rounded(J.load_by_train(tt, cong, 160.0)[1].select("station_no", "direction", "slot30", "before", "after", "kept"))
