"""Queries of loads, crowding, trains and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import crowding as C
from tramline.operators import events as E
from tramline.operators import network as N
from tramline.operators import panel as P
from tramline.queries.base import query, read, rounded, v_panel, v_pred, v_station, v_timetable
from tramline.queries.panel import topology
from tramline.queries.scalars import HAV

#: A day's line: stations of a line in order with the panel's sums by month, so that lines are full.
LINE = "SELECT s.line, s.seq, s.station_no, month(p.date) AS m, sum(p.boarding) AS boarding, sum(p.alighting) AS alighting FROM v_panel p JOIN v_station s ON s.station_no = p.station_no GROUP BY ALL"


def line_month(spark, d):
    return v_panel(spark, d).join(v_station(spark, d), "station_no").groupBy("line", "seq", "station_no", F.month("date").alias("m")).agg(F.sum("boarding").alias("boarding"), F.sum("alighting").alias("alighting"))


OD = "SELECT i.line, i.m, i.seq AS i, j.seq AS j, CASE WHEN t.total - i.alighting > 0 THEN i.boarding / (t.total - i.alighting) ELSE 0 END * j.alighting AS trips, t.n FROM l i JOIN l j ON i.line = j.line AND i.m = j.m AND i.seq <> j.seq JOIN (SELECT line, m, sum(alighting) AS total, count(*) AS n FROM l GROUP BY ALL) t ON t.line = i.line AND t.m = i.m"


@query(f"WITH l AS ({LINE}), od AS ({OD}) SELECT l.station_no, l.m::INTEGER AS m, round(coalesce(sum(trips) FILTER (WHERE i <= l.seq AND j > l.seq), 0), 4) AS load_up, round(coalesce(sum(trips) FILTER (WHERE i >= l.seq AND j < l.seq), 0), 4) AS load_down FROM l LEFT JOIN od ON od.line = l.line AND od.m = l.m GROUP BY 1, 2")
def win11_linear_loads(spark, d):
    return rounded(C.linear_loads(line_month(spark, d), ["line", "m"]).select("station_no", "m", "load_up", "load_down"), 4)


RINGS = f"""WITH l0 AS ({LINE}), l AS (SELECT line, m, station_no, boarding, alighting, row_number() OVER (PARTITION BY line, m ORDER BY seq) - 1 AS seq FROM l0), od AS (SELECT *, (j - i + n) % n AS up, (i - j + n) % n AS down FROM ({OD}))
    SELECT l.station_no, l.m::INTEGER AS m, round(coalesce(sum(trips) FILTER (WHERE up <= down AND (l.seq - i + n) % n < up), 0), 4) AS load_up, round(coalesce(sum(trips) FILTER (WHERE down < up AND (i - l.seq + n) % n < down), 0), 4) AS load_down FROM l LEFT JOIN od ON od.line = l.line AND od.m = l.m GROUP BY 1, 2"""


@query(RINGS)
def win12_circular_loads(spark, d):
    from pyspark.sql.window import Window

    l = line_month(spark, d).withColumn("seq", F.row_number().over(Window.partitionBy("line", "m").orderBy("seq")) - 1)
    return rounded(C.circular_loads(l, ["line", "m"]).select("station_no", "m", "load_up", "load_down"), 4)


@query(RINGS)
def win12_ring_loads(spark, d):
    return rounded(C.ring_loads(line_month(spark, d), ["line", "m"]).select("station_no", "m", "load_up", "load_down"), 4)


@query("SELECT station_no, date, slot, round(CASE WHEN v >= 0 THEN v WHEN v < 0 THEN greatest(lookup - 20, 0) END, 6) AS clipped, CASE WHEN v >= 0 THEN 'model' WHEN v < 0 THEN CASE WHEN lookup - 20 >= 0 THEN 'lookup' ELSE 'zero' END END AS source FROM (SELECT *, CASE WHEN slot = 7 THEN NULL ELSE model - 25 END AS v FROM v_pred)")
def prj10_clip_negative(spark, d):
    p = v_pred(spark, d).withColumns({"v": F.when(F.col("slot") != 7, F.col("model") - 25), "low": F.col("lookup") - 20})
    return rounded(C.clip_negative(p, "v", "low").select("station_no", "date", "slot", "clipped", "source"))


@query("SELECT station_no, CASE WHEN station_no % 7 = 0 THEN 'no_lookup' WHEN station_no % 5 = 0 THEN 'calibration_fallback' WHEN station_no % 3 = 0 THEN 'segment_truncated' WHEN station_no % 2 = 0 THEN 'no_calibration' ELSE 'ok' END AS status FROM v_station")
def prj11_data_status(spark, d):
    k = lambda n: F.col("station_no") % n == 0
    return v_station(spark, d).select("station_no", C.data_status(k(7), k(5), k(3), k(2)).alias("status"))


@query("SELECT event_id, unnest(list_filter([CASE WHEN floor(value) = 0 THEN 'zero' END, CASE WHEN floor(value) > 100 THEN 'over_100' END, CASE WHEN floor(value) > 150 THEN 'very_high' END], lambda x: x IS NOT NULL)) AS flag FROM events")
def prj12_outlier_flags(spark, d):
    e = read(spark, d, "events").select("event_id", F.floor("value").alias("v"))
    return C.value_flags(e, "v").select("event_id", "flag")


@query("SELECT event_id, reason, reason IN ('empty', 'risk') AS fired FROM (SELECT event_id, CASE WHEN user_id % 13 = 0 THEN 'no_data' WHEN value > 80 THEN 'out_of_range' WHEN event_type = 'error' THEN 'low_confidence' WHEN user_id % 7 = 0 THEN 'empty' WHEN (user_id % 10) / 10 >= 0.5 THEN 'risk' ELSE 'fine' END AS reason FROM events)")
def prj18_reroute_trigger(spark, d):
    e = read(spark, d, "events").select("event_id", F.when(F.col("user_id") % 13 != 0, F.col("user_id") % 10 / 10).alias("p_empty"), (F.col("user_id") % 7).alias("stock"), F.when(F.col("event_type") == "error", "fallback").otherwise("model").alias("source"), F.col("value").alias("eta"))
    return C.reroute_trigger(e, "p_empty", "stock", "source", "eta", most_eta=80).select("event_id", "reason", "fired")


HEAD = "SELECT *, coalesce(CAST(arr_min - lag(arr_min) OVER (PARTITION BY station_no, direction ORDER BY arr_min, train_id) AS DOUBLE), 30.0) AS h, printf('%02d:%02d', arr_min // 60, arr_min % 60 // 30 * 30) AS slot30 FROM v_timetable"


@query(f"SELECT train_id, h AS headway_min, round(h / nullif(sum(h) OVER (PARTITION BY station_no, direction, slot30), 0), 6) AS share, h > 20 AS headway_long FROM ({HEAD})")
def win05_headway_share(spark, d):
    return rounded(C.headway_share(v_timetable(spark, d), ["station_no", "direction"]).select("train_id", "headway_min", "share", "headway_long"))


@query(f"WITH a AS (SELECT *, coalesce(h / nullif(sum(h) OVER w, 0), 0) AS s, count(*) OVER w AS n, greatest(least((15.0 - h) / 10, 1), 0) AS m FROM ({HEAD}) WINDOW w AS (PARTITION BY station_no, direction, slot30)), b AS (SELECT *, m * s + (1 - m) / n AS r FROM a) SELECT train_id, round(r / sum(r) OVER (PARTITION BY station_no, direction, slot30), 6) AS share FROM b")
def win05_headway_share_mixed(spark, d):
    return rounded(C.headway_share(v_timetable(spark, d), ["station_no", "direction"], h0=5.0).select("train_id", "share"))


@query("WITH a AS (SELECT *, coalesce(CAST(arr_min - lag(arr_min) OVER w > 20 AS INTEGER), 0) AS new FROM v_timetable WINDOW w AS (PARTITION BY station_no ORDER BY arr_min, train_id)), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY station_no ORDER BY arr_min, train_id) AS BIGINT) AS run FROM a) SELECT train_id, run, lag(direction) OVER r AS prev_station, lead(direction) OVER r AS next_station FROM b WINDOW r AS (PARTITION BY station_no, run ORDER BY arr_min, train_id)")
def win06_run_split(spark, d):
    return C.run_split(v_timetable(spark, d), ["station_no"], "arr_min", "train_id", station="direction").select("train_id", "run", "prev_station", "next_station")


@query("WITH s AS (SELECT c_custkey AS id, c_nationkey AS train, c_custkey % 12 AS station_no, c_acctbal AS load FROM customer), l AS (SELECT *, lag(station_no) OVER w AS p, lag(load) OVER w AS q, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY train ORDER BY id)) SELECT id, CASE WHEN i = 1 THEN 0.0 WHEN abs(p - station_no) = 1 THEN q END AS arriving, CASE WHEN i = 1 THEN 'first' WHEN abs(p - station_no) = 1 THEN 'previous' ELSE 'not_adjacent' END AS source FROM l")
def win07_node_states(spark, d):
    s = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("train"), (F.col("c_custkey") % 12).alias("station_no"), F.col("c_acctbal").alias("load"))
    near = spark.range(12).select(F.col("id").alias("station_no"), F.explode(F.array(F.col("id") - 1, F.col("id") + 1)).alias("other"))
    return C.node_states(s, ["train"], ["id"], near).select("id", "arriving", "source")


@query("WITH c AS (SELECT l_orderkey, CAST(l_linenumber AS VARCHAR) || '-' || l_partkey || '-' || l_suppkey AS seg, l_returnflag = 'A' AS match, l_quantity AS load FROM lineitem), f AS (SELECT *, sum(CAST(match AS INTEGER)) OVER w AS fits, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, seg, n > 1 AND fits <> 1 AS ambiguous FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN fits = 1 THEN CAST(match AS INTEGER) ELSE 0 END DESC, load DESC, seg) = 1")
def win08_resolve_links(spark, d):
    c = read(spark, d, "lineitem").select("l_orderkey", F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("seg"), (F.col("l_returnflag") == "A").alias("match"), F.col("l_quantity").alias("load"))
    return C.resolve_links(c, ["l_orderkey"], "seg", "match", "load").select("l_orderkey", "seg", "ambiguous")


ALLOC = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS dir, l_quantity AS load, l_discount AS share FROM lineitem"


def allocation(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("dir"), F.col("l_quantity").alias("load"), F.col("l_discount").alias("share"), F.lit(1000.0).alias("flow"))


@query(f"WITH a AS (SELECT *, sum(load) OVER d AS dl, sum(load) OVER o AS al, sum(share) OVER d AS ds, count(*) OVER d AS k FROM ({ALLOC}) WINDOW o AS (PARTITION BY l_orderkey), d AS (PARTITION BY l_orderkey, dir)) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(1000 * dl / al * CASE WHEN ds > 0 THEN share / ds ELSE 1.0 / k END, 6) AS allocated FROM a")
def win09_allocate_flows(spark, d):
    return rounded(C.allocate_flows(allocation(spark, d), ["l_orderkey"], "dir", "share", "load", "flow", by_load=True).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "allocated"))


@query("WITH h AS (SELECT l_suppkey AS station_no, l_linenumber AS hour, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), s AS (SELECT station_no, hour, unnest([printf('%02d:00', hour), printf('%02d:30', hour)]) AS slot30, v FROM h) SELECT station_no, slot30, round(v * CASE WHEN station_no % 9 = 0 THEN NULL WHEN slot30 LIKE '%:00' THEN 0.6 ELSE 0.4 END, 6) AS v_30min FROM s")
def win10_split_hourly(spark, d):
    h = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station_no"), F.col("l_linenumber").alias("hour")).agg(F.sum("l_quantity").alias("v"))
    from tramline.functions.timefn import half_hours

    shares = h.where("station_no % 9 <> 0").select("station_no", F.explode(half_hours(F.col("hour"))).alias("slot30")).withColumn("share", F.when(F.col("slot30").endswith(":00"), 0.6).otherwise(0.4))
    return rounded(C.split_hourly(h, shares, ["station_no"], "hour", "v").select("station_no", "slot30", "v_30min"))


@query("WITH h AS (SELECT l_suppkey AS station_no, l_linenumber AS hour, sum(l_quantity) AS raw FROM lineitem GROUP BY ALL), s AS (SELECT station_no, unnest([printf('%02d:00', hour), printf('%02d:30', hour)]) AS slot30, raw FROM h) SELECT station_no, slot30, round(CASE WHEN station_no % 9 <> 0 THEN (raw + CASE WHEN station_no % 2 = 0 THEN 10.0 ELSE 0.0 END) * (0.5::DOUBLE + station_no % 3) END, 6) AS calibrated FROM s")
def joi23_apply_calibration(spark, d):
    from tramline.functions.timefn import half_hours

    h = read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("station_no"), F.col("l_linenumber").alias("hour")).agg(F.sum("l_quantity").alias("raw"))
    t = h.where("station_no % 9 <> 0").select("station_no", F.explode(half_hours(F.col("hour"))).alias("slot30"), (F.lit(0.5) + F.col("station_no") % 3).alias("ratio"), F.when(F.col("station_no") % 2 == 0, 10.0).alias("offset"))
    return rounded(C.apply_calibration(h, t, ["station_no"]).select("station_no", "slot30", "calibrated"))


@query("SELECT station_no, direction, printf('%02d:%02d', arr_min // 60, arr_min % 60 // 30 * 30) AS slot30, count(DISTINCT train_id) AS trains FROM v_timetable GROUP BY ALL")
def agg33_trains_per_slot(spark, d):
    return C.trains_per_slot(v_timetable(spark, d), ["station_no", "direction"])


TARGETS = "SELECT a.line, a.station_no, CASE WHEN b.seq = a.seq + 1 OR (a.line % 2 = 0 AND n > 2 AND a.seq = n AND b.seq = 1) THEN 'up' ELSE 'down' END AS direction, b.station_no AS to_station FROM v_station a JOIN v_station b ON a.line = b.line JOIN (SELECT line, max(seq) AS n FROM v_station GROUP BY 1) c ON c.line = a.line WHERE abs(a.seq - b.seq) = 1 OR (a.line % 2 = 0 AND n > 2 AND abs(a.seq - b.seq) = n - 1)"


def node_rows(spark, d):
    return v_panel(spark, d).select("station_no", "date", "slot", F.when(F.col("slot") % 2 == 0, "up").otherwise("down").alias("direction"), "boarding")


@query(f"SELECT p.station_no, p.date, p.slot, t.to_station, boarding FROM v_panel p JOIN ({TARGETS}) t ON t.station_no = p.station_no AND t.direction = CASE WHEN p.slot % 2 = 0 THEN 'up' ELSE 'down' END")
def joi24_link_table(spark, d):
    links, _ = C.to_link_table(node_rows(spark, d), C.link_targets(topology(spark, d)))
    return links.select("station_no", "date", "slot", "to_station", "boarding")


@query(f"SELECT station_no, direction, count(*) AS n FROM (SELECT station_no, CASE WHEN slot % 2 = 0 THEN 'up' ELSE 'down' END AS direction FROM v_panel) p WHERE NOT EXISTS (SELECT 1 FROM ({TARGETS}) t WHERE t.station_no = p.station_no AND t.direction = p.direction) GROUP BY 1, 2")
def joi24_dropped_keys(spark, d):
    return C.to_link_table(node_rows(spark, d), C.link_targets(topology(spark, d)))[1]


@query("SELECT DISTINCT line, station_no FROM v_station s JOIN (SELECT line AS l, min(seq) AS a, max(seq) AS b FROM v_station GROUP BY 1) e ON e.l = s.line WHERE (seq = a OR seq = b) AND line % 3 = 0")
def arr05_truncated_cells(spark, d):
    return C.truncated_cells(topology(spark, d).withColumn("truncated", F.col("line") % 3 == 0))


@query("SELECT a.line, a.station_no AS a, b.station_no AS b FROM v_station a JOIN v_station b ON a.line = b.line AND b.seq = a.seq + 1")
def arr03_segment_links(spark, d):
    return N.adjacency_pairs(topology(spark, d))


@query("SELECT line, list_sort(list(station_no) FILTER (WHERE known)) AS stations, list_sort(coalesce(list(station_no) FILTER (WHERE NOT known), [])) AS gaps FROM (SELECT line, unnest(generate_series(lo, hi)) AS station_no FROM (SELECT s_nationkey AS line, min(s_suppkey) AS lo, least(min(s_suppkey) + 5, max(s_suppkey)) AS hi FROM supplier GROUP BY 1)) t JOIN (SELECT range AS k, range % 4 <> 1 AS known FROM range(1000000)) u ON u.k = t.station_no GROUP BY 1 HAVING count(*) FILTER (WHERE known) > 0")
def arr01_expand_ranges(spark, d):
    s = read(spark, d, "supplier")
    t = s.groupBy(F.col("s_nationkey").alias("line")).agg(F.array(F.array(F.min("s_suppkey"), F.least(F.min("s_suppkey") + 5, F.max("s_suppkey")))).alias("ranges"))
    known = s.where("s_suppkey % 4 <> 1").select(F.col("s_suppkey").alias("station_no"))
    return N.expand_ranges(t, known).where("size(stations) > 0")


@query("SELECT station_no, slot, date, coalesce(boarding, v) AS boarding, boarding IS NULL AND v IS NOT NULL AS borrowed FROM (SELECT p.station_no, p.slot, p.date, CASE WHEN p.slot % 3 = 0 THEN NULL ELSE p.boarding END AS boarding, CASE WHEN q.slot % 3 = 0 THEN NULL ELSE q.boarding END AS v FROM v_panel p LEFT JOIN v_panel q ON p.station_no % 2 = 0 AND q.station_no = p.station_no + 1 AND q.slot = p.slot AND q.date = p.date)", "joi30_borrow_neighbor")
def joi30(spark, d):
    p = v_panel(spark, d).select("station_no", "slot", "date", F.when(F.col("slot") % 3 != 0, F.col("boarding")).alias("boarding"))
    b = v_station(spark, d).where("station_no % 2 = 0").select("station_no", (F.col("station_no") + 1).alias("from_station"))
    return C.borrow_neighbor(p, b, ["slot", "date"], ["boarding"]).select("station_no", "slot", "date", "boarding", "borrowed")


@query("SELECT station_no, round(regr_slope(alighting, boarding), 6) AS slope, round(regr_intercept(alighting, boarding), 6) AS intercept, count(*) AS n FROM v_panel GROUP BY 1")
def agg37_grouped_line_fit(spark, d):
    return rounded(C.grouped_line_fit(v_panel(spark, d), ["station_no"], "boarding", "alighting"))


@query("SELECT station_no, round(sum(boarding * alighting) / sum(boarding * boarding), 6) AS slope, 0.0::DOUBLE AS intercept, count(*) AS n FROM v_panel GROUP BY 1")
def agg37_line_fit_no_constant(spark, d):
    return rounded(C.grouped_line_fit(v_panel(spark, d), ["station_no"], "boarding", "alighting", const=False))


@query("WITH g AS (SELECT station_no, sum(boarding * alighting) FILTER (WHERE slot < 6) / sum(boarding * boarding) FILTER (WHERE slot < 6) AS slope, count(*) FILTER (WHERE slot < 6) AS n_inner, avg(alighting) FILTER (WHERE slot >= 6) AS y, avg(boarding) FILTER (WHERE slot >= 6) AS x FROM v_panel GROUP BY 1) SELECT station_no, round(slope, 6) AS slope, n_inner, round(CASE WHEN n_inner >= 4 THEN y / nullif(slope, 0) - x END, 6) AS \"offset\" FROM g")
def agg38_boundary_offset(spark, d):
    return rounded(C.boundary_offset(v_panel(spark, d).withColumn("edge", F.col("slot") >= 6), ["station_no"], "boarding", "alighting", "edge"))


JOINT = """WITH g AS (SELECT station_no, sum(CASE WHEN slot < 6 THEN boarding * alighting ELSE 0 END) AS ixy, sum(CASE WHEN slot < 6 THEN boarding * boarding ELSE 0 END) AS ixx, sum(CASE WHEN slot >= 6 THEN boarding * alighting ELSE 0 END) AS exy, sum(CASE WHEN slot >= 6 THEN boarding * boarding ELSE 0 END) AS exx, avg(boarding) FILTER (WHERE slot >= 6) AS x, avg(alighting) FILTER (WHERE slot >= 6) AS y, count(*) FILTER (WHERE slot >= 6) AS m FROM v_panel GROUP BY 1),
    f AS (SELECT station_no, ixy / nullif(ixx, 0) AS s0, x, y, (ixy + exy - coalesce(m * x * y, 0)) / nullif(ixx + exx - coalesce(m * x * x, 0), 0) AS s1 FROM g), o AS (SELECT station_no, s0, s1, coalesce(greatest(0, y / nullif(s0, 0) - x), 0) AS o0, coalesce(greatest(0, (y - s1 * x) / nullif(s1, 0)), 0) AS o1 FROM f),
    e AS (SELECT p.station_no, s0, o0, s1, o1, avg(abs(alighting - s0 * (boarding + CASE WHEN slot >= 6 THEN o0 ELSE 0 END))) AS e0, avg(abs(alighting - s1 * (boarding + CASE WHEN slot >= 6 THEN o1 ELSE 0 END))) AS e1 FROM v_panel p JOIN o ON o.station_no = p.station_no GROUP BY ALL)
    SELECT station_no, round(CASE WHEN e1 < e0 THEN s1 ELSE s0 END, 6) AS slope, round(CASE WHEN e1 < e0 THEN o1 ELSE o0 END, 6) AS "offset", coalesce(e1 < e0, false) AS joint, round(CASE WHEN e1 < e0 THEN e1 ELSE e0 END, 6) AS mae FROM e"""


@query(JOINT)
def agg38_joint_boundary_fit(spark, d):
    return rounded(C.joint_boundary_fit(v_panel(spark, d).withColumn("edge", F.col("slot") >= 6), ["station_no"], "boarding", "alighting", "edge"))


@query("SELECT station_no, n, round(sum(r) FILTER (WHERE true), 3) AS check FROM (SELECT l_suppkey AS station_no, count(*) OVER (PARTITION BY l_suppkey) AS n, 0.0::DOUBLE AS r FROM lineitem) GROUP BY 1, 2")
def agg39_grouped_ols3(spark, d):
    # residuals of least squares are orthogonal to the regressors, so their products sum to 0
    i = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("station_no"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("a"), (F.col("l_discount") * 100).alias("b"), (F.col("l_tax") * 100).alias("c"))
    beta = C.grouped_ols3(i, ["station_no"], "y", ["a", "b", "c"])
    r = F.col("y") - F.col("beta_a") * F.col("a") - F.col("beta_b") * F.col("b") - F.col("beta_c") * F.col("c")
    out = i.join(beta, "station_no").groupBy("station_no", "n").agg((F.abs(F.sum(r * F.col("a"))) + F.abs(F.sum(r * F.col("b"))) + F.abs(F.sum(r * F.col("c")))).alias("_s"), F.sum(F.col("y") * F.col("a")).alias("_y"))
    return out.select("station_no", "n", F.when(F.col("_s") < 1e-6 * F.col("_y"), 0.0).otherwise(F.col("_s")).alias("check"))


@query("WITH t AS (SELECT count_if(value > 50 AND event_type = 'click')::DOUBLE AS p, count_if(value > 50 AND event_type <> 'click')::DOUBLE AS q, count_if(value <= 50 AND event_type = 'click')::DOUBLE AS r, count_if(value <= 50 AND event_type <> 'click')::DOUBLE AS s FROM events) SELECT round((p + q + r + s) * (p * s - q * r) ** 2 / ((p + q) * (r + s) * (p + r) * (q + s)), 6) AS chi2 FROM t")
def agg28_chi2(spark, d):
    return rounded(C.chi2_2x2(read(spark, d, "events"), F.col("value") > 50, F.col("event_type") == "click"))


@query("WITH r AS (SELECT event_type, value, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS r FROM events), g AS (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY event_type), n AS (SELECT count(*)::DOUBLE AS n FROM events), t AS (SELECT sum(t::DOUBLE * t * t - t) AS t FROM (SELECT count(*) AS t FROM events GROUP BY value)) SELECT round((12 / (n.n * (n.n + 1)) * (SELECT sum(s * s / n) FROM g) - 3 * (n.n + 1)) / (1 - t.t / (n.n * n.n * n.n - n.n)), 6) AS h FROM n, t")
def agg28_kruskal_h(spark, d):
    return rounded(C.kruskal_h(read(spark, d, "events"), "event_type", "value"))


@query("SELECT CAST(month(date) AS INTEGER) AS month, slot % 2 = 0 AS rain, round(avg(boarding), 6) AS mean, round(stddev_samp(boarding), 6) AS sd, count(boarding) AS n FROM v_panel GROUP BY 1, 2")
def agg29_effect_by_condition(spark, d):
    p = v_panel(spark, d).select(F.month("date").alias("month"), (F.col("slot") % 2 == 0).alias("rain"), "boarding")
    return rounded(C.effect_by_condition(p, ["month", "rain"], "boarding"))


@query(f"WITH v AS (SELECT station_no, date, avg(boarding) AS v FROM v_panel GROUP BY ALL), pr AS (SELECT p.station_no AS a, s.station_no AS b FROM v_station p, v_station s WHERE p.station_no < s.station_no AND {HAV.format(a='p', b='s')} <= 2), c AS (SELECT a, b, corr(x.v, y.v) AS c FROM pr JOIN v x ON x.station_no = a JOIN v y ON y.station_no = b AND y.date = x.date GROUP BY ALL HAVING count(*) > 2) SELECT round(avg(c), 6) AS mean_corr, count(c) AS pairs FROM c")
def agg30_neighbor_correlation(spark, d):
    v = v_panel(spark, d).groupBy("station_no", "date").agg(F.avg("boarding").alias("v"))
    s = v_station(spark, d).select("station_no", "lat", "lon")
    at = s.groupBy("lat", "lon").agg(F.min("station_no").alias("place"))
    pairs = E.radius_join(at.withColumnRenamed("place", "a"), at.withColumnRenamed("place", "b"), 2.0).select("a", "b")
    places = s.join(at, ["lat", "lon"]).select(F.col("station_no").alias("station"), "place", E.along_curve(F.col("lat"), F.col("lon")).alias("order"))
    return rounded(C.neighbor_correlation(v, pairs, "station_no", "date", "v", block=1024, places=places))




@query("WITH dep AS (SELECT DISTINCT user_id % 5 AS edge, hour(ts) * 3600 + minute(ts) * 60 AS q FROM events), g AS (SELECT edge, coalesce(lag(q) OVER w, 0) AS p, q AS e, q FROM dep WINDOW w AS (PARTITION BY edge ORDER BY q) UNION ALL SELECT edge, max(q), 86400, min(q) + 86400 FROM dep GROUP BY 1), s AS (SELECT edge, q, sl, greatest(p, sl * 1800) AS lo, least(e, (sl + 1) * 1800) AS hi FROM g, range(48) r(sl) WHERE greatest(p, sl * 1800) < least(e, (sl + 1) * 1800)) SELECT edge, CAST(sl AS INTEGER) AS slot, CAST(round(sum((hi - lo) * (q - (lo + hi) / 2)) / 1800) AS INTEGER) AS wait FROM s GROUP BY 1, 2")
def win16_expected_wait(spark, d):
    e = read(spark, d, "events").select((F.col("user_id") % 5).alias("edge"), (F.hour("ts") * 3600 + F.minute("ts") * 60).alias("sec"))
    return N.expected_wait(e, ["edge"], "sec")


@query("WITH w AS (SELECT user_id AS edge, CAST(event_id % 3 AS INTEGER) AS dow_type, CAST(2 * hour(ts) + minute(ts) // 30 AS INTEGER) AS slot, CAST(1800 // count(*) AS INTEGER) AS wait FROM events GROUP BY ALL), e AS (SELECT DISTINCT user_id AS edge FROM events) SELECT edge, dow_type, slot, coalesce(wait, 86400) AS wait FROM (SELECT edge, CAST(a.range AS INTEGER) AS dow_type, CAST(b.range AS INTEGER) AS slot FROM e, range(3) a, range(48) b) LEFT JOIN w USING (edge, dow_type, slot)")
def win17_expand_edge_slots(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    slot = (2 * F.hour("ts") + F.floor(F.minute("ts") / 30)).cast("int")
    waits = e.groupBy(F.col("user_id").alias("edge"), (F.col("event_id") % 3).cast("int").alias("dow_type"), slot.alias("slot")).agg(F.floor(1800 / F.count(F.lit(1))).cast("int").alias("wait"))
    return N.expand_edge_slots(e.select(F.col("user_id").alias("edge")).distinct(), waits, ["edge"])


@query("WITH s AS (SELECT o_custkey AS train, o_custkey % 3 AS line, o_orderkey AS ord, o_orderkey % 40 AS station, CAST(floor(o_totalprice) AS BIGINT) AS tm, o_orderpriority AS name FROM orders), h AS (SELECT line, station AS from_station, lead(station) OVER w AS to_station, lead(tm) OVER w - tm AS t, name AS a, lead(name) OVER w AS b FROM s WINDOW w AS (PARTITION BY train ORDER BY ord)), e AS (SELECT line, from_station, to_station, median(t) AS seconds, count(*) AS n FROM h WHERE to_station IS NOT NULL AND t > 0 AND a <> b GROUP BY ALL) SELECT line, from_station, to_station, round(seconds, 2) AS seconds, n FROM e QUALIFY n >= 0.6 * median(n) OVER (PARTITION BY line)")
def agg35_segment_travel_time(spark, d):
    s = read(spark, d, "orders").select(F.col("o_custkey").alias("train"), (F.col("o_custkey") % 3).alias("line"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 40).alias("station"), F.floor("o_totalprice").alias("at"), F.col("o_orderpriority").alias("name"))
    return rounded(N.segment_travel_time(s, "train", "line", ["ord"], "at", "station", "name", 0.6), 2)


@query("WITH t AS (SELECT station_no, line, slot, max(boarding) AS m FROM v_panel JOIN v_station USING (station_no) GROUP BY ALL) SELECT 'station' AS kind, CAST(station_no AS BIGINT) AS id, slot, max(m) AS congestion FROM t GROUP BY 2, 3 UNION ALL SELECT 'line', CAST(line AS BIGINT), slot, round(avg(m), 1) FROM t GROUP BY 2, 3")
def agg34_congestion_by_station_and_line(spark, d):
    p = v_panel(spark, d).join(v_station(spark, d).select("station_no", "line"), "station_no")
    a, b = N.congestion_by_station_and_line(p, "station_no", "line", "slot", "boarding")
    return a.select(F.lit("station").alias("kind"), F.col("station_no").alias("id"), "slot", "congestion").union(b.select(F.lit("line"), F.col("line").cast("long"), "slot", "congestion"))


@query("SELECT event_type, min(v) AS least, quantile_disc(v, 0.5) AS p50, quantile_disc(v, 0.95) AS p95, max(v) AS most, count(*) AS n FROM (SELECT event_type, CAST(floor(value) AS BIGINT) - 5 AS v FROM events) WHERE v >= 0 GROUP BY 1")
def agg36_latency_stats(spark, d):
    return N.latency_stats(read(spark, d, "events").select("event_type", (F.floor("value") - 5).alias("v")), ["event_type"], "v")


@query(f"WITH r AS (SELECT line, seq, station_no AS from_stop, lead(station_no) OVER w AS to_stop, lat AS a, lon AS b, lead(lat) OVER w AS c, lead(lon) OVER w AS e FROM v_station WINDOW w AS (PARTITION BY line ORDER BY seq)), q AS (SELECT line, from_stop, to_stop, struct_pack(lat := a, lon := b) AS p, struct_pack(lat := c, lon := e) AS s FROM r WHERE to_stop IS NOT NULL) SELECT line, from_stop, to_stop, round({HAV.format(a='p', b='s')} * 1000, 4) AS metres, CAST(round({HAV.format(a='p', b='s')} * 1000 / 5) AS INTEGER) AS seconds FROM q")
def win26_route_edges(spark, d):
    return rounded(N.route_edges(v_station(spark, d), "line", "seq", "station_no").select("line", "from_stop", "to_stop", "metres", "seconds"), 4)


@query("SELECT l_suppkey % 9 AS from_stop, l_partkey % 9 AS to_stop, min(l_orderkey) AS route FROM lineitem GROUP BY 1, 2")
def win26_corridors(spark, d):
    e = read(spark, d, "lineitem").select((F.col("l_suppkey") % 9).alias("from_stop"), (F.col("l_partkey") % 9).alias("to_stop"), F.col("l_orderkey").alias("route"))
    return N.corridors(e, "route")


LINKS = "SELECT o_orderkey AS id, o_custkey % 120 AS f, o_orderkey % 120 AS t, o_totalprice / 100 AS metres FROM orders"


def links(spark, d):
    o = read(spark, d, "orders").select((F.col("o_custkey") % 120).alias("from_node"), (F.col("o_orderkey") % 120).alias("to_node"), (F.col("o_totalprice") / 100).alias("metres"))
    nodes = v_station(spark, d).select(F.col("station_no").alias("node"), "line")
    speeds = read(spark, d, "nation").where("n_nationkey % 3 <> 0").select(F.col("n_nationkey").alias("line"), (F.col("n_nationkey") + 5.0).alias("speed"))
    return N.link_segments(nodes, o, speeds)


@query(f"SELECT s.line, f AS from_node, t AS to_node, greatest(30, CAST(round(metres / CASE WHEN s.line % 3 <> 0 THEN s.line + 5.0::DOUBLE ELSE 9.0::DOUBLE END) AS INTEGER)) AS seconds FROM ({LINKS}) l JOIN v_station s ON s.station_no = f JOIN v_station u ON u.station_no = t WHERE f <> t")
def joi32_link_segments(spark, d):
    return links(spark, d)[0]


@query(f"SELECT f AS from_node, t AS to_node FROM ({LINKS}) l WHERE f = t OR f NOT IN (SELECT station_no FROM v_station) OR t NOT IN (SELECT station_no FROM v_station)")
def joi32_bad_links(spark, d):
    return links(spark, d)[1]


LEG = "SELECT o_custkey AS opt, o_orderkey AS seq, o_orderstatus AS route, o_orderkey % 50 AS edge, CAST(o_totalprice / 1000 AS BIGINT) AS sec FROM orders"


def option_legs(spark, d):
    return read(spark, d, "orders").select(F.col("o_custkey").alias("option"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("route"), (F.col("o_orderkey") % 50).alias("edge"), F.round(F.col("o_totalprice") / 1000).cast("long").alias("seconds"))


TIMED = f"SELECT *, coalesce(sum(sec) OVER (PARTITION BY opt ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t, coalesce(CAST(route <> lag(route) OVER (PARTITION BY opt ORDER BY seq) AS INTEGER), 0) AS new FROM ({LEG})"


@query(f"WITH a AS ({TIMED}), b AS (SELECT *, CAST(sum(new) OVER (PARTITION BY opt ORDER BY seq) AS BIGINT) AS leg, t // 1800 AS slot FROM a), c AS (SELECT *, CASE WHEN edge % 4 <> 0 AND slot < 4 THEN CAST((edge + slot) % 5 AS INTEGER) END AS level FROM b) SELECT opt AS option, leg, max(level) AS level, first(edge ORDER BY level DESC NULLS LAST, seq) AS worst_edge FROM c GROUP BY 1, 2")
def win18_leg_worst(spark, d):
    levels = spark.range(50).where("id % 4 <> 0").select(F.col("id").alias("edge"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot")).withColumn("level", ((F.col("edge") + F.col("slot")) % 5).cast("int"))
    return N.leg_worst(option_legs(spark, d), levels)


@query(f"SELECT opt AS option, bool_and(coalesce((edge + t // 1800) % 6 > 0 OR edge % 4 = 0 OR t // 1800 > 3, true)) AS passes FROM ({TIMED}) GROUP BY 1")
def win27_stock_gate(spark, d):
    stock = spark.range(50).where("id % 4 <> 0").select(F.col("id").alias("station_no"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("slot")).withColumn("stock", (F.col("station_no") + F.col("slot")) % 6)
    return N.stock_gate(option_legs(spark, d).withColumnRenamed("edge", "station_no"), stock)


SCORED = "SELECT o_custkey % 100 AS grp, o_custkey AS opt, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderkey % 5 AS INTEGER) END AS level, CAST(round(o_totalprice / 1000) AS BIGINT) AS sec FROM orders"


def scored_legs(spark, d):
    return read(spark, d, "orders").select((F.col("o_custkey") % 100).alias("grp"), F.col("o_custkey").alias("opt"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_orderkey") % 5).cast("int")).alias("level"), F.round(F.col("o_totalprice") / 1000).cast("long").alias("sec"))


@query(f"WITH o AS (SELECT grp, opt, max(level) AS worst, max(sec) AS minutes FROM ({SCORED}) GROUP BY 1, 2) SELECT *, CAST(row_number() OVER w AS INTEGER) AS rank, row_number() OVER w = 1 AND worst IS NOT NULL AS tagged FROM o WINDOW w AS (PARTITION BY grp ORDER BY worst NULLS LAST, minutes, opt)")
def top03_comfort_rank(spark, d):
    return N.comfort_rank(scored_legs(spark, d), "grp", "opt", "level", "sec")


@query(f"WITH o AS (SELECT grp, opt, sum(sec * level) FILTER (WHERE level IS NOT NULL) / nullif(sum(sec) FILTER (WHERE level IS NOT NULL), 0) AS mean_level, max(level) AS max_level, coalesce(sum(sec) FILTER (WHERE level IS NOT NULL), 0) / sum(sec) AS coverage, CAST(count(*) FILTER (WHERE level IS NULL) AS BIGINT) AS missing FROM ({SCORED}) GROUP BY 1, 2) SELECT grp, opt, round(mean_level, 6) AS mean_level, max_level, round(coverage, 6) AS coverage, missing, CASE WHEN coverage >= 0.5 THEN CAST(row_number() OVER (PARTITION BY grp, coverage >= 0.5 ORDER BY mean_level, opt) AS INTEGER) END AS rank FROM o")
def top04_score_options(spark, d):
    return rounded(N.score_options(scored_legs(spark, d), "grp", "opt", "level", "sec"))


@query(f"WITH o AS (SELECT grp, opt, max(level) AS worst, max(sec) AS mx, min(sec) AS mn FROM ({SCORED}) GROUP BY 1, 2), a AS (SELECT grp, opt FROM o QUALIFY row_number() OVER (PARTITION BY grp ORDER BY worst NULLS LAST, mx, opt) = 1), b AS (SELECT grp, opt FROM o QUALIFY row_number() OVER (PARTITION BY grp ORDER BY worst NULLS LAST, opt) = 1) SELECT round(avg(CAST(a.opt <> b.opt AS INTEGER)), 6) AS changed, count(*) AS n FROM a JOIN b USING (grp)")
def top07_top1_change(spark, d):
    legs = scored_legs(spark, d)
    a = N.comfort_rank(legs, "grp", "opt", "level", "sec")
    b = N.comfort_rank(legs.withColumn("sec", F.lit(0)), "grp", "opt", "level", "sec")
    return rounded(N.top1_change(a, b, "grp", "opt"))


@query("WITH s AS (SELECT o_custkey AS train, o_orderstatus AS segment, o_orderkey AS minutes, CAST(o_totalprice AS BIGINT) AS pos FROM orders), t AS (SELECT *, sign(pos - lag(pos) OVER (PARTITION BY train, segment ORDER BY minutes)) AS st FROM s), g AS (SELECT train, segment, count(*) AS n, avg(CASE WHEN st IS NOT NULL THEN CAST(st > 0 AS INTEGER) END) AS up, avg(CASE WHEN st IS NOT NULL THEN CAST(st < 0 AS INTEGER) END) AS down FROM t GROUP BY 1, 2) SELECT train, segment, CASE WHEN up >= 0.9 THEN 'up' WHEN down >= 0.9 THEN 'down' END AS direction FROM g QUALIFY row_number() OVER (PARTITION BY train ORDER BY n DESC, segment DESC) = 1")
def win14_infer_direction(spark, d):
    s = read(spark, d, "orders").select(F.col("o_custkey").alias("train"), F.col("o_orderstatus").alias("segment"), F.col("o_orderkey").alias("minutes"), F.round("o_totalprice").cast("long").alias("pos"))
    return N.infer_direction(s, "train", "segment", "minutes", "pos")


@query("SELECT user_id, min(lag) > 0 AND arg_max(lag, event_id) >= arg_min(lag, event_id) AND count(*) > 1 AS stalled, arg_max(event_id, event_id) > arg_min(event_id, event_id) AS advancing FROM (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) AS lag FROM events) GROUP BY 1")
def win21_stalled_series(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", F.floor("value").alias("lag"))
    return N.stalled_series(e, ["user_id"], "event_id", "lag", "event_id")


#: One line of text for each (station, date): the values of the 7 slots of each of the 3 days before, oldest first, "-" where
#: nothing was seen; days are separated by a bar.
HISTORY = "WITH k AS (SELECT DISTINCT station_no, date FROM v_panel), c AS (SELECT k.station_no, k.date, b.range AS back, s.range AS slot, p.boarding AS v FROM k CROSS JOIN range(1, 4) b CROSS JOIN range(1, 8) s LEFT JOIN v_panel p ON p.station_no = k.station_no AND p.date = k.date - CAST(b.range AS INTEGER) AND p.slot = s.range), r AS (SELECT station_no, date, back, string_agg(coalesce(CAST(CAST(v AS BIGINT) AS VARCHAR), '-'), ' ' ORDER BY slot) AS line, string_agg(CASE WHEN v IS NULL THEN '0' ELSE '1' END, '' ORDER BY slot) AS seen FROM c GROUP BY 1, 2, 3) SELECT station_no, date, {} FROM r GROUP BY 1, 2"


def slot_texts(history):
    """Each day of a history as text; a day that is not there has seven dashes."""
    value = lambda r, i: F.coalesce(F.get(r, i)["boarding"].cast("long").cast("string"), F.lit("-"))
    return F.array_join(F.transform(history, lambda r: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: value(r, i)), " ")), "|")


@query(HISTORY.format("string_agg(line, '|' ORDER BY back DESC) AS history, string_agg(seen, '|' ORDER BY back DESC) AS mask"))
def win24_history_arrays(spark, d):
    h = C.history_arrays(v_panel(spark, d), "station_no", "date", "slot", ["boarding"], 3, 7)
    mask = F.array_join(F.transform("mask", lambda r: F.array_join(F.transform(r, lambda x: F.when(x, "1").otherwise("0")), "")), "|")
    return h.select("station_no", "date", slot_texts(F.col("history")).alias("history"), mask.alias("mask"))


@query(HISTORY.format("string_agg(CASE WHEN back = 1 THEN line ELSE '- - - - - - -' END, '|' ORDER BY back DESC) AS history"))
def win25_sequence_mask(spark, d):
    h = C.sequence_mask(C.history_arrays(v_panel(spark, d), "station_no", "date", "slot", ["boarding"], 3, 7), [1], 3)
    return h.select("station_no", "date", slot_texts(F.col("history")).alias("history"))
