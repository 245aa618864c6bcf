"""Queries of evaluation and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.functions.scalars import grade
from tramline.operators import evaluate as V
from tramline.operators import panel as P
from tramline.queries.base import parts, query, read, rounded, v_panel, v_pred, v_station

LOSS = "SELECT date, axis, \"group\", count(*) AS n, sum((lookup - boarding) ** 2) AS sse_base, sum(abs(lookup - boarding)) AS sae_base, sum((model - boarding) ** 2) AS sse_model, sum(abs(model - boarding)) AS sae_model FROM (SELECT *, 'all' AS axis, 'all' AS \"group\" FROM v_pred UNION ALL SELECT *, 'slot', CAST(slot AS VARCHAR) FROM v_pred) GROUP BY ALL"


def losses(spark, d):
    return V.daily_losses(v_pred(spark, d), {"all": F.lit("all"), "slot": F.col("slot")}, "boarding", "lookup", "model")


@query(f"SELECT date, axis, \"group\", n, round(sse_base, 7) AS sse_base, round(sae_base, 7) AS sae_base, round(sse_model, 7) AS sse_model, round(sae_model, 7) AS sae_model FROM ({LOSS})")
def eva01_daily_losses(spark, d):
    return rounded(losses(spark, d), 7)


@query(f"SELECT axis, \"group\", CAST(sum(n) AS BIGINT) AS n, round(100 * (1 - sqrt(sum(sse_model) / sum(sse_base))), 6) AS rmse_gain, round(100 * (1 - sum(sae_model) / sum(sae_base)), 6) AS mae_gain FROM ({LOSS}) GROUP BY 1, 2")
def eva02_improvement(spark, d):
    return rounded(V.improvement(losses(spark, d), ["axis", "group"]))


#: Sums of each of the draws 0 .. n - 1 over the days of a loss table x; days are picked by md5.
DRAWS = """{p}days AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS size FROM (SELECT DISTINCT date FROM {x})), {p}picks AS (SELECT draw, CAST('0x' || substr(md5('7:' || draw || ':' || place), 1, 15) AS BIGINT) % size AS i FROM (SELECT range AS draw, size, unnest(range(1, size + 1)) AS place FROM range({n}), (SELECT max(size) AS size FROM {p}days))),
    {p}times AS (SELECT draw, date, count(*) AS k FROM {p}picks JOIN {p}days ON {p}days.i = {p}picks.i GROUP BY 1, 2), {p}draws AS (SELECT draw, axis, "group", 100 * (1 - sqrt(sum(sse_model * k) / sum(sse_base * k))) AS r, 100 * (1 - sum(sae_model * k) / sum(sae_base * k)) AS m FROM {p}times t JOIN {x} ON {x}.date = t.date GROUP BY 1, 2, 3)"""


@query(f"""WITH a AS (SELECT * FROM ({LOSS}) WHERE axis = 'all'), {DRAWS.format(p='', x='a', n=1000)}, g AS (SELECT axis, "group", CAST(sum(n) AS BIGINT) AS n, 100 * (1 - sqrt(sum(sse_model) / sum(sse_base))) AS r, 100 * (1 - sum(sae_model) / sum(sae_base)) AS m FROM a GROUP BY 1, 2)
    SELECT g.axis, g."group", g.n, round(g.r, 6) AS rmse_gain, round(quantile_cont(d.r, 0.025), 6) AS rmse_low, round(quantile_cont(d.r, 0.975), 6) AS rmse_high, round(g.m, 6) AS mae_gain, round(quantile_cont(d.m, 0.025), 6) AS mae_low, round(quantile_cont(d.m, 0.975), 6) AS mae_high FROM g JOIN draws d ON d.axis = g.axis AND d."group" = g."group" GROUP BY ALL""")
def eva02_block_bootstrap(spark, d):
    return rounded(V.block_bootstrap(losses(spark, d).where("axis = 'all'"), ["axis", "group"]))


@query(f"""WITH l AS ({LOSS}), d AS (SELECT axis, "group", date, (sse_base - sse_model) / n AS d FROM l), c AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY axis, "group") AS t, d - avg(d) OVER (PARTITION BY axis, "group") AS c, avg(d) OVER (PARTITION BY axis, "group") AS m FROM d WINDOW w AS (PARTITION BY axis, "group" ORDER BY date)),
    k AS (SELECT a.axis, a."group", a.t, a.m, a.i - b.i AS k, a.c * b.c AS p, floor(4 * pow(a.t / 100, 2.0 / 9)) AS lag FROM c a JOIN c b ON a.axis = b.axis AND a."group" = b."group" AND a.i - b.i BETWEEN 0 AND floor(4 * pow(a.t / 100, 2.0 / 9)))
    SELECT axis, "group", max(t) AS days, round(max(m), 6) AS mean_diff, round(max(m) / sqrt(sum(CASE WHEN k = 0 THEN p ELSE 2 * (1 - k / (lag + 1)) * p END) / max(t) / max(t)), 5) AS dm FROM k GROUP BY 1, 2""")
def eva03_diebold_mariano(spark, d):
    out = V.diebold_mariano(losses(spark, d), ["axis", "group"])
    return out.select("axis", "group", "days", F.round("mean_diff", 6).alias("mean_diff"), F.round("dm", 5).alias("dm"))


G = [20, 35, 50]
GS = "(CAST({x} >= 20 AS INTEGER) + CAST({x} >= 35 AS INTEGER) + CAST({x} >= 50 AS INTEGER))"


@query(f"SELECT slot, count(*) AS n, round(avg(abs(model - boarding)), 6) AS mae, round(sqrt(avg((model - boarding) ** 2)), 6) AS rmse, round(corr(boarding, model), 6) AS corr, round(avg(CAST({GS.format(x='boarding')} = {GS.format(x='model')} AS INTEGER)), 6) AS agreement FROM v_pred GROUP BY 1")
def eva04_cell_metrics(spark, d):
    return rounded(V.cell_metrics(v_pred(spark, d), ["slot"], "boarding", "model", lambda x: grade(x, G)))


@query(f"SELECT slot, round(avg(CAST({GS.format(x='boarding')} = {GS.format(x='lookup')} AS INTEGER)), 6) AS before, round(avg(CAST({GS.format(x='boarding')} = {GS.format(x='model')} AS INTEGER)), 6) AS after, round(avg(CAST({GS.format(x='lookup')} <> {GS.format(x='model')} AS INTEGER)), 6) AS changed, count(*) AS n, round(avg(CAST({GS.format(x='boarding')} = {GS.format(x='model')} AS INTEGER)) - avg(CAST({GS.format(x='boarding')} = {GS.format(x='lookup')} AS INTEGER)), 6) AS gain FROM v_pred GROUP BY 1")
def eva05_grade_agreement(spark, d):
    g = lambda c: grade(F.col(c), G)
    return rounded(V.grade_agreement(v_pred(spark, d), ["slot"], g("boarding"), g("lookup"), g("model")))


@query(f"SELECT count(*) AS n, round(avg(CAST({GS.format(x='boarding')} = {GS.format(x='model')} AS INTEGER)), 6) AS hit_rate FROM v_pred WHERE {GS.format(x='boarding')} <> {GS.format(x='lookup')}")
def eva06_informative_cells(spark, d):
    g = lambda c: grade(F.col(c), G)
    return rounded(V.informative_cells(v_pred(spark, d), g("boarding"), g("lookup"), g("model")))


@query("WITH c AS (SELECT count(*) AS n, count_if(quality = 1 AND toxic = 0)::BIGINT AS tp, count_if(quality = 0 AND toxic = 0)::BIGINT AS fp, count_if(quality = 1 AND toxic = 1)::BIGINT AS fn FROM labels) SELECT *, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c")
def eva07_shortage_metrics(spark, d):
    return rounded(V.class_metrics(read(spark, d, "labels"), [], F.col("quality") == 1, F.col("toxic") == 0))


@query("SELECT slot, round(sum(abs(p - t)) / nullif(sum(abs(t)), 0), 6) AS wape, round(avg(CASE WHEN t <> 0 THEN CAST(sign(t) = sign(p) AS INTEGER) END), 6) AS direction, round(1 - sum((p - t) ** 2) / nullif(var_pop(t) * count(t), 0), 6) AS r2 FROM (SELECT slot, boarding - 25 AS t, model - 25 AS p FROM v_pred) GROUP BY 1")
def eva07_change_metrics(spark, d):
    p = v_pred(spark, d).select("slot", (F.col("boarding") - 25).alias("t"), (F.col("model") - 25).alias("p"))
    return rounded(V.change_metrics(p, ["slot"], "t", "p"))


@query("SELECT round(avg(((event_id % 100) / 100 - CAST(value > 50 AS DOUBLE)) ** 2), 6) AS brier, count(*) AS n FROM events")
def eva08_brier(spark, d):
    e = read(spark, d, "events").withColumn("prob", F.col("event_id") % 100 / 100)
    return rounded(V.brier(e, F.col("value") > 50, "prob"))


@query("WITH p AS (SELECT value, (event_id * 37 % 1009) / 1009 AS prob FROM events), e AS (SELECT quantile_cont(prob, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM p) SELECT CAST(len(list_filter(q, lambda t: prob > t)) AS INTEGER) AS bin, round(avg(prob), 6) AS mean_prob, round(avg(CAST(value > 50 AS INTEGER)), 6) AS observed, count(*) AS n FROM p, e GROUP BY 1")
def eva08_calibration_table(spark, d):
    e = read(spark, d, "events").withColumn("prob", F.col("event_id") * 37 % 1009 / 1009)
    return rounded(V.calibration_table(e, F.col("value") > 50, "prob"))


@query("SELECT o_orderpriority, count_if(o_orderstatus = 'O')::BIGINT AS \"O\", count_if(o_orderstatus = 'F')::BIGINT AS \"F\", count_if(o_orderstatus = 'P')::BIGINT AS nulls FROM orders GROUP BY 1")
def eva09_status_distribution(spark, d):
    o = read(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return V.status_distribution(o, "o_orderpriority", "o_orderstatus", ["O", "F"], "v")


@query("WITH s AS (SELECT station_no, slot, year(date) AS y, avg(boarding) AS v FROM v_panel WHERE year(date) IN (1997, 1998) GROUP BY ALL) SELECT count(*) AS n, round(avg(abs(a.v - b.v)), 6) AS mae, round(max(abs(a.v - b.v)), 6) AS largest FROM s a JOIN s b ON a.station_no = b.station_no AND a.slot = b.slot AND a.y = 1997 AND b.y = 1998")
def eva10_late_share(spark, d):
    a, b = (v_panel(spark, d).where(F.year("date") == y).groupBy("station_no", "slot").agg(F.avg("boarding").alias("share")) for y in (1997, 1998))
    return rounded(V.late_share(a, b, ["station_no", "slot"], "share"))


@query("WITH r AS (SELECT station_no, slot, min(boarding) AS lo, max(boarding) AS hi FROM v_panel WHERE year(date) < 1997 GROUP BY ALL), p AS (SELECT v.*, boarding * 3 - 40 AS q FROM v_pred v WHERE year(date) >= 1997) SELECT p.station_no, p.date, p.slot, coalesce(q < lo - (hi - lo) OR q > hi + (hi - lo), false) AS diverged, round(greatest(CASE WHEN coalesce(q < lo - (hi - lo) OR q > hi + (hi - lo), false) THEN lookup ELSE q END, 0), 6) AS bounded FROM p LEFT JOIN r ON r.station_no = p.station_no AND r.slot = p.slot")
def eva11_divergence_bounds(spark, d):
    p = v_pred(spark, d).where("year(date) >= 1997").withColumn("q", F.col("boarding") * 3 - 40)
    return rounded(V.divergence_bounds(p, v_panel(spark, d).where("year(date) < 1997"), ["station_no", "slot"], "q", "boarding", "lookup").select("station_no", "date", "slot", "diverged", "bounded"))


@query("SELECT p.station_no, p.date, p.slot, b.boarding AS naive FROM v_panel p LEFT JOIN v_panel b ON b.station_no = p.station_no AND b.slot = p.slot AND b.date = p.date - 7")
def eva12_seasonal_naive(spark, d):
    return P.day_lags(v_panel(spark, d), ["station_no", "slot"], ["boarding"], [7]).select("station_no", "date", "slot", F.col("boarding_lag7d").alias("naive"))


WORSE = "SELECT date, 'all' AS axis, 'all' AS \"group\", count(*) AS n, sum((lookup - boarding) ** 2) AS sse_base, sum(abs(lookup - boarding)) AS sae_base, sum((lookup * 0.9 - boarding) ** 2) AS sse_model, sum(abs(lookup * 0.9 - boarding)) AS sae_model FROM v_pred GROUP BY ALL"


@query(f"""WITH a AS (SELECT * FROM ({LOSS}) WHERE axis = 'all'), b AS ({WORSE}), {DRAWS.format(p='', x='a', n=50)}, {DRAWS.format(p='b_', x='b', n=50)}
    SELECT x.axis, x."group", round(quantile_cont(y.r - x.r, 0.025), 6) AS low, round(quantile_cont(y.r - x.r, 0.5), 6) AS median, round(quantile_cont(y.r - x.r, 0.975), 6) AS high FROM draws x JOIN b_draws y ON y.draw = x.draw GROUP BY 1, 2""")
def eva13_window_diff(spark, d):
    a = losses(spark, d).where("axis = 'all'")
    worse = V.daily_losses(v_pred(spark, d).withColumn("model", F.col("lookup") * 0.9), {"all": F.lit("all")}, "boarding", "lookup", "model")
    return rounded(V.window_diff(a, worse, ["axis", "group"], 50))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY CAST('0x' || substr(md5('1:' || event_id), 1, 15) AS BIGINT), event_id) <= 100")
def eva14_stratified_sample(spark, d):
    return V.stratified_sample(read(spark, d, "events"), "event_type", "event_id", 100).select("event_id", "event_type")


#: The isotonic fit in closed form: at each value the largest, over where a run begins, of the least mean of a run that holds it;
#: between two values a straight line.
ISOTONIC = """WITH e AS (SELECT event_id, (event_id % 100) / 100 AS prob, CAST(value > 50 AS DOUBLE) AS hit FROM events),
    g AS (SELECT prob AS x, sum(hit) AS s, count(*) AS n FROM e WHERE event_id % 2 = 0 GROUP BY 1), c AS (SELECT *, row_number() OVER w AS i, sum(s) OVER w AS cs, sum(n) OVER w AS cn FROM g WINDOW w AS (ORDER BY x)),
    m AS (SELECT o.x, a.i AS a, min((b.cs - a.cs + a.s) / (b.cn - a.cn + a.n)) AS least FROM c o JOIN c a ON a.i <= o.i JOIN c b ON b.i >= o.i GROUP BY 1, 2), f AS (SELECT x, max(least) AS f FROM m GROUP BY 1),
    t AS (SELECT p.prob, max(f.x) FILTER (WHERE f.x <= p.prob) AS x0, min(f.x) FILTER (WHERE f.x >= p.prob) AS x1 FROM (SELECT DISTINCT prob FROM e WHERE event_id % 2 = 1) p, f GROUP BY 1)
    SELECT e.event_id, e.prob, round(CASE WHEN x0 IS NULL THEN b.f WHEN x1 IS NULL OR x0 = x1 THEN a.f ELSE a.f + (b.f - a.f) * (e.prob - x0) / (x1 - x0) END, 6) AS calibrated
    FROM e JOIN t ON t.prob = e.prob LEFT JOIN f a ON a.x = x0 LEFT JOIN f b ON b.x = x1 WHERE e.event_id % 2 = 1"""


@query(ISOTONIC)
def ml01_isotonic(spark, d):
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 100 / 100).alias("prob"), (F.col("value") > 50).cast("double").alias("hit"))
    out = V.isotonic_calibrate(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "prob", "hit")
    return out.select("event_id", "prob", F.round("calibrated", 6).alias("calibrated"))


@query()
def ml02_cluster_profiles(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(8)])
    return V.cluster_profiles(e, "vec_id", [f"e{i}" for i in range(8)], 4)


@query()
def ml03_residual_model(spark, d):
    p = v_pred(spark, d).join(v_station(spark, d).select("station_no", "line"), "station_no").withColumn("dom", F.dayofmonth("date"))
    out = V.residual_model(p.where("year(date) < 1999"), p.where("year(date) >= 1999"), ["slot", "dow_type", "dom", "line"], "boarding", "lookup", iterations=5, tasks=parts(spark, d))
    return out.select("station_no", "date", "slot", "prediction")
