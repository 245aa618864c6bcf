"""Registration, and the driver's tables as the shapes of the transit operators, in Spark and in SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions import timefn as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

VIEWS = {
    "v_stock": "SELECT event_id, user_id AS station_id, ts AS collected_at, CAST(ts AS DATE) AS date, CAST(floor(value) AS INTEGER) AS stock, 100.0::DOUBLE AS racks, props AS payload_json FROM events",
    "v_rental": "SELECT event_id, user_id AS station_id, ts, CASE event_type WHEN 'view' THEN 'rent' ELSE 'return' END AS kind, 1::BIGINT AS cnt FROM events WHERE event_type IN ('view', 'click')",
    "v_panel": "SELECT l_suppkey AS station_no, CAST(l_shipdate AS DATE) AS date, l_linenumber AS slot, sum(l_quantity) AS boarding, sum(l_extendedprice) / 1000 AS alighting FROM lineitem GROUP BY 1, 2, 3",
    "v_long": "SELECT station_no, date, slot, 'boarding' AS direction, boarding AS passengers FROM v_panel UNION ALL SELECT station_no, date, slot, 'alighting', alighting FROM v_panel",
    "v_station": "SELECT s_suppkey AS station_no, s_name AS name, s_nationkey AS line, 37.4::DOUBLE + (s_suppkey % 97) * 0.003::DOUBLE AS lat, 126.8::DOUBLE + (s_suppkey % 89) * 0.004::DOUBLE AS lon, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INTEGER) AS seq FROM supplier",
    "v_point": "SELECT c_custkey AS point_id, 37.4::DOUBLE + (c_custkey % 101) * 0.003::DOUBLE AS lat, 126.8::DOUBLE + (c_custkey % 103) * 0.004::DOUBLE AS lon FROM customer",
    "v_game": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS place, o_custkey % 7 AS a, (o_custkey + 3) % 7 AS b, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS attendance FROM orders",
    "v_festival": "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS begin_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER) AS end_date, o_orderpriority AS place FROM orders",
    "v_holiday": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, true AS is_holiday FROM orders WHERE day(o_orderdate) = 1",
    "v_dow": "SELECT p.*, CASE WHEN dayofweek(p.date) = 6 THEN 1 WHEN dayofweek(p.date) = 0 OR coalesce(h.is_holiday, false) THEN 2 ELSE 0 END AS dow_type FROM v_panel p LEFT JOIN v_holiday h ON p.date = h.date",
    "v_pred": "SELECT *, 0.5 * boarding + 0.5 * lookup AS model FROM (SELECT *, avg(boarding) OVER (PARTITION BY station_no, slot, dow_type) AS lookup FROM v_dow)",
    "v_profile": "SELECT station_id, CASE WHEN dayofweek(collected_at) = 6 THEN 1 WHEN dayofweek(collected_at) = 0 THEN 2 ELSE 0 END AS dow_type, CAST((hour(collected_at) * 60 + minute(collected_at)) // 30 AS INTEGER) AS time_slot, avg(stock) AS exp_bikes, avg(CAST(stock <= 0 AS INTEGER)) AS p_empty, avg(CAST(stock >= racks AS INTEGER)) AS p_full, count(*) AS n FROM v_stock GROUP BY 1, 2, 3",
    "v_timetable": "SELECT user_id AS station_no, event_type AS direction, event_id AS train_id, hour(ts) * 60 + minute(ts) AS arr_min FROM events",
}
NEEDS = {"v_long": ["v_panel"], "v_dow": ["v_panel", "v_holiday"], "v_pred": ["v_dow"], "v_profile": ["v_stock"]}


def with_views(body: str) -> str:
    """The SQL with the views that it names, and those that they name, before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in NEEDS.get(name, []):
            need(x)
        if name not in order:
            order.append(name)

    for name in VIEWS:
        if name in body:
            need(name)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}" if head else body
    return f"WITH {head} {body}" if head else body


def query(sql: str | None = None, name: str | None = None):
    def put(f):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = with_views(sql)
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def v_stock(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("event_id", F.col("user_id").alias("station_id"), F.col("ts").alias("collected_at"), F.col("ts").cast("date").alias("date"), F.floor("value").cast("int").alias("stock"), F.lit(100.0).alias("racks"), F.col("props").alias("payload_json"))


def v_rental(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").where(F.col("event_type").isin("view", "click"))
    return e.select("event_id", F.col("user_id").alias("station_id"), "ts", F.when(F.col("event_type") == "view", "rent").otherwise("return").alias("kind"), F.lit(1).cast("long").alias("cnt"))


#: Rows of the largest table to a task, on the mean, where panels are put together.
ROWS = 500_000


def parts(spark: SparkSession, d: str) -> int:
    """Tasks that a panel is dealt to. Their number grows with the rows of its table (its files' footers tell), so the memory of
    one does not, however few partitions a session's shuffles have."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(read(spark, d, "lineitem").count() / ROWS))


def v_panel(spark: SparkSession, d: str) -> DataFrame:
    """Dealt by station, which has a row a day and slot at most, so whatever is grouped by station and more needs no other shuffle."""
    i = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("station_no"), F.col("l_shipdate").cast("date").alias("date"), F.col("l_linenumber").alias("slot"), "l_quantity", "l_extendedprice")
    return i.repartition(parts(spark, d), "station_no").groupBy("station_no", "date", "slot").agg(F.sum("l_quantity").alias("boarding"), (F.sum("l_extendedprice") / 1000).alias("alighting"))


def v_long(spark: SparkSession, d: str) -> DataFrame:
    both = F.create_map(F.lit("boarding"), "boarding", F.lit("alighting"), "alighting")
    return v_panel(spark, d).select("station_no", "date", "slot", F.explode(both).alias("direction", "passengers"))


def v_station(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier")
    seq = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return s.select(F.col("s_suppkey").alias("station_no"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("line"), (F.lit(37.4) + F.col("s_suppkey") % 97 * 0.003).alias("lat"), (F.lit(126.8) + F.col("s_suppkey") % 89 * 0.004).alias("lon"), seq.alias("seq"))


def v_point(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), (F.lit(37.4) + F.col("c_custkey") % 101 * 0.003).alias("lat"), (F.lit(126.8) + F.col("c_custkey") % 103 * 0.004).alias("lon"))


def v_game(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("place"), (F.col("o_custkey") % 7).alias("a"), ((F.col("o_custkey") + 3) % 7).alias("b"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("attendance"))


def v_festival(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("begin_date"), F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).alias("end_date"), F.col("o_orderpriority").alias("place"))


def v_holiday(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where(F.dayofmonth("o_orderdate") == 1).select(F.col("o_orderdate").cast("date").alias("date"), F.lit(True).alias("is_holiday")).distinct()


def v_dow(spark: SparkSession, d: str) -> DataFrame:
    return v_panel(spark, d).join(v_holiday(spark, d), "date", "left").withColumn("dow_type", T.dow_type(F.col("date"), F.col("is_holiday"))).drop("is_holiday")


def v_pred(spark: SparkSession, d: str) -> DataFrame:
    from tramline.operators.panel import lookup_join, lookup_means

    p = v_dow(spark, d)
    out = lookup_join(p, lookup_means(p, ["station_no", "slot", "dow_type"], ["boarding"]), ["station_no", "slot", "dow_type"])
    return out.withColumnRenamed("boarding_lookup", "lookup").withColumn("model", 0.5 * F.col("boarding") + 0.5 * F.col("lookup"))


def v_profile(spark: SparkSession, d: str) -> DataFrame:
    from tramline.operators.stock import stock_profile

    s = v_stock(spark, d)
    return stock_profile(s.select("*", T.dow_type(F.col("date")).alias("dow_type"), T.slot_30m(F.col("collected_at")).alias("time_slot")))


def v_timetable(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(F.col("user_id").alias("station_no"), F.col("event_type").alias("direction"), F.col("event_id").alias("train_id"), T.minute_of_day(F.col("ts")).alias("arr_min"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def v_anchor(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").where("event_type = 'purchase'").select("user_id", "ts", "value", F.col("event_id").alias("anchor_id"))
