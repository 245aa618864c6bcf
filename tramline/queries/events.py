"""Queries of events, places and stations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.operators import events as E
from tramline.queries.base import query, read, rounded, v_festival, v_game, v_point, v_station
from tramline.queries.scalars import HAV

KM = HAV.format(a="p", b="s")


@query(f"SELECT point_id, station_no, round(km, 6) AS km FROM (SELECT p.point_id, s.station_no, {KM} AS km FROM v_point p, v_station s) WHERE km <= 1.5")
def joi09_radius_join(spark, d):
    return rounded(E.radius_join(v_point(spark, d), v_station(spark, d).drop("name", "line", "seq"), 1.5).select("point_id", "station_no", "km"))


@query(f"SELECT point_id, arg_min(station_no, (km, station_no)) AS station_no, round(min(km), 6) AS km FROM (SELECT p.point_id, s.station_no, round({KM}, 9) AS km FROM v_point p, v_station s) GROUP BY 1")
def joi10_nearest_one(spark, d):
    return rounded(E.nearest_one(v_point(spark, d), v_station(spark, d), "point_id", "station_no"))


@query(f"WITH e AS (SELECT point_id, station_no, CAST(round(km * 1000 * 1.3::DOUBLE / 1.2::DOUBLE) AS INTEGER) AS seconds FROM (SELECT p.point_id, s.station_no, {KM} AS km FROM v_point p, v_station s) WHERE km <= 0.5) SELECT 'a' || point_id AS from_id, 'b' || station_no AS to_id, seconds FROM e UNION ALL SELECT 'b' || station_no, 'a' || point_id, seconds FROM e")
def joi11_walk_edges(spark, d):
    return E.walk_edges(v_point(spark, d), v_station(spark, d), "point_id", "station_no")


@query("WITH m AS (SELECT station_no, round(lat, 5) AS la, round(lon, 5) AS lo FROM v_station) SELECT p.point_id, min(m.station_no) AS station_no, 6 AS digits FROM v_point p JOIN m ON m.la = round(p.lat, 5) AND m.lo = round(p.lon, 5) WHERE p.point_id % 2 = 0 GROUP BY 1 UNION ALL SELECT p.point_id, min(m.station_no), 5 FROM v_point p JOIN m ON m.la = round(p.lat, 5) AND m.lo = round(p.lon, 5) WHERE p.point_id % 2 = 1 GROUP BY 1")
def joi12_coord_match(spark, d):
    p = v_point(spark, d).withColumn("lat", F.col("lat") + F.when(F.col("point_id") % 2 == 1, 0.000002).otherwise(0.0))
    return E.coord_match(p, v_station(spark, d), "point_id", "station_no")


@query("WITH r AS (SELECT *, list_sort([a, b]) AS pair FROM v_game), l AS (SELECT *, row_number() OVER (PARTITION BY date, pair ORDER BY id) AS k FROM r), q AS (SELECT *, row_number() OVER (PARTITION BY date, pair ORDER BY id) AS k FROM (SELECT * FROM r WHERE id % 3 <> 0)) SELECT l.id, q.attendance AS seen FROM l LEFT JOIN q ON q.date = l.date AND q.pair = l.pair AND q.k = l.k")
def joi16_sequence_join(spark, d):
    g = v_game(spark, d)
    right = g.where("id % 3 <> 0").select("id", "date", F.col("b").alias("a"), F.col("a").alias("b"), F.col("attendance").alias("seen"))
    return E.sequence_join(g.select("id", "date", "a", "b"), right, "a", "b", "date", "id", ["seen"]).select("id", "seen")


@query("SELECT id FROM v_game WHERE (date, place) NOT IN (SELECT (date, place) FROM v_game GROUP BY date, place HAVING count(*) > 1)")
def joi17_drop_days(spark, d):
    return E.drop_days(v_game(spark, d), ["date", "place"]).select("id")


DAYS = "SELECT id, place, unnest(generate_series(begin_date, end_date, INTERVAL 1 DAY))::DATE AS date, CAST(date_diff('day', begin_date, end_date) + 1 AS INTEGER) AS days FROM v_festival"
FEST = f"SELECT place, date, count(DISTINCT id) AS n_festivals, count(DISTINCT CASE WHEN days <= 3 THEN id END) AS n_short, min(days) AS min_days, count(DISTINCT id) - count(DISTINCT CASE WHEN days <= 3 THEN id END) AS n_long FROM ({DAYS}) GROUP BY 1, 2"
GAME = "SELECT place, date, count(*) AS n_games, CASE WHEN count(attendance) = count(*) THEN round(sum(attendance), 4) END AS attendance, count(*) - count(attendance) AS n_missing FROM v_game GROUP BY 1, 2"


def festivals(spark, d):
    f = E.duration_days(v_festival(spark, d), "begin_date", "end_date")
    every = E.explode_days(f, "begin_date", "end_date", F.lit("1900-01-01").cast("date"), F.lit("2100-01-01").cast("date"))
    return E.festival_rollup(every, ["place", "date"], "id", "days")


def games(spark, d):
    return rounded(E.game_rollup(v_game(spark, d), ["place", "date"], "attendance"), 4)


@query(FEST)
def agg13_festival_rollup(spark, d):
    return festivals(spark, d)


@query(GAME)
def agg14_game_rollup(spark, d):
    return games(spark, d)


@query(f"SELECT coalesce(g.place, f.place) AS place, coalesce(g.date, f.date) AS date, coalesce(n_games, 0) AS n_games, attendance, n_missing, coalesce(n_festivals, 0) AS n_festivals, coalesce(n_short, 0) AS n_short, min_days, coalesce(n_long, 0) AS n_long FROM ({GAME}) g FULL JOIN ({FEST}) f ON f.place = g.place AND f.date = g.date")
def agg15_station_events(spark, d):
    return E.station_events(games(spark, d), festivals(spark, d), ["place", "date"])


@query(f"WITH near AS (SELECT DISTINCT station_no FROM (SELECT s.station_no, {KM} AS km FROM v_point p, v_station s) WHERE km <= 0.3), days AS (SELECT DISTINCT date FROM v_game WHERE place = '1-URGENT') SELECT p.station_no, p.date, p.slot, p.station_no IN (SELECT station_no FROM near) AND p.date IN (SELECT date FROM days) AS event FROM v_panel p")
def joi26_event_flag(spark, d):
    from tramline.queries.base import v_panel

    near = E.radius_join(v_point(spark, d), v_station(spark, d).drop("name", "line", "seq"), 0.3)
    return E.event_flag(v_panel(spark, d), near, v_game(spark, d).where("place = '1-URGENT'")).select("station_no", "date", "slot", "event")


@query("SELECT id, a, b FROM (SELECT *, attendance IS NOT NULL AS seen FROM v_game) QUALIFY row_number() OVER (PARTITION BY a, b, place ORDER BY seen DESC, date DESC, id) = 1")
def win20_dedup_ranked(spark, d):
    return E.dedup_ranked(v_game(spark, d), ["a", "b", "place"], [F.col("attendance").isNotNull().desc(), F.col("date").desc(), F.col("id")]).select("id", "a", "b")


@query("SELECT station_no, CASE WHEN station_no % 3 = 0 THEN lat + 0.01 ELSE lat END AS lat, lon, station_no % 3 = 0 AS replaced FROM v_station")
def joi28_coord_majority(spark, d):
    s = v_station(spark, d).select("station_no", "lat", "lon")
    moved = s.withColumn("lat", F.col("lat") + F.when(F.col("station_no") % 3 == 0, 0.01).otherwise(0.0))
    return E.coord_majority(s, moved, moved.withColumn("lon", F.col("lon") + 0.0001), "station_no")


@query("SELECT station_no, CASE WHEN station_no % 3 = 0 THEN lat + 0.02 ELSE lat END AS lat, lon, station_no % 3 = 0 AS replaced, station_no % 3 < 2 AND station_no % 7 <> 0 AS warned FROM v_station WHERE station_no % 7 <> 0 UNION ALL SELECT station_no, lat, lon, false, false FROM v_station WHERE station_no % 7 = 0")
def joi28_coord_replace(spark, d):
    s = v_station(spark, d).select("station_no", "lat", "lon")
    k = F.col("station_no") % 3
    moved = s.where("station_no % 7 <> 0").withColumn("lat", F.col("lat") + F.when(k == 0, 0.02).when(k == 1, 0.005).otherwise(0.0))
    return E.coord_replace(s, moved, "station_no")


@query("WITH c AS (SELECT line, 'n' || station_no % 30 AS name, lat, lon FROM v_station WHERE station_no % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY line, 'n' || station_no % 30 ORDER BY station_no) = 1), a AS (SELECT name, arg_min(lat, line) AS lat, arg_min(lon, line) AS lon FROM c GROUP BY 1) SELECT s.station_no, coalesce(c.lat, a.lat) AS lat, coalesce(c.lon, a.lon) AS lon FROM v_station s LEFT JOIN c ON c.line = s.line AND c.name = 'n' || s.station_no % 30 LEFT JOIN a ON a.name = 'n' || s.station_no % 30")
def joi29_coord_by_line_then_name(spark, d):
    s = v_station(spark, d).select("station_no", "line", F.concat(F.lit("n"), F.col("station_no") % 30).alias("name"), "lat", "lon")
    coords = E.dedup_ranked(s.where("station_no % 4 <> 0"), ["line", "name"], [F.col("station_no")]).drop("station_no")
    return E.coord_by_line_then_name(s.drop("lat", "lon"), coords).select("station_no", "lat", "lon")


@query(f"SELECT point_id, station_no, round(km, 6) AS km, CAST(row_number() OVER (PARTITION BY point_id ORDER BY km, station_no) AS INTEGER) AS rank FROM (SELECT p.point_id, s.station_no, {KM} AS km FROM v_point p, v_station s WHERE s.station_no % 5 <> 0) WHERE km <= 3 QUALIFY rank <= 3")
def top01_nearby(spark, d):
    s = v_station(spark, d).select("station_no", "lat", "lon", (F.col("station_no") % 5 == 0).alias("is_empty"))
    return rounded(E.nearby(v_point(spark, d), s, "point_id", "station_no", 3.0, 3, F.col("is_empty")).select("point_id", "station_no", "km", "rank"))


@query(f"WITH c AS (SELECT p.point_id, s.station_no, {KM} AS km, s.station_no % 10 / 10 AS p_empty FROM v_point p, v_station s), k AS (SELECT *, CASE WHEN station_no % 7 <> 0 THEN km * 15 + 10 * p_empty END AS score FROM c WHERE km <= 3) SELECT point_id, station_no, round(score, 6) AS score FROM k WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY score, km, station_no) = 1")
def top02_best_candidate(spark, d):
    s = v_station(spark, d).select("station_no", "lat", "lon", F.when(F.col("station_no") % 7 != 0, F.col("station_no") % 10 / 10).alias("p_empty"))
    return rounded(E.best_nearby(v_point(spark, d), s, "point_id", "station_no", 3.0, 15, "p_empty"))


@query("SELECT DISTINCT p_name AS name, CASE WHEN p_name = 'red widget' THEN 0 WHEN p_name LIKE 'red widget%' THEN 1 ELSE 2 END AS rank FROM part WHERE contains(p_name, 'red widget') ORDER BY rank, name LIMIT 20")
def top06_search_index(spark, d):
    from tramline.scratch import new_folder

    path = new_folder(spark, "names")
    E.write_name_index(read(spark, d, "part"), "p_name", path)
    return E.search_index(spark, path, "red widget")


@query("SELECT DISTINCT p_name, CASE WHEN p_name = 'red widget' THEN 0 WHEN p_name LIKE 'red%' THEN 1 ELSE 2 END AS rank FROM part WHERE contains(p_name, 'red') ORDER BY rank, p_name LIMIT 20")
def top06_search_names(spark, d):
    out = E.search_names(read(spark, d, "part"), "p_name", "red")
    return out.withColumn("rank", F.when(F.col("p_name") == "red widget", 0).otherwise(F.col("rank")))
