"""Lines, links and timetables as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline import scratch
from tramline.functions.scalars import haversine_m

DAY, SLOT = 86_400, 1_800


def expected_wait(departures: DataFrame, keys: Sequence[str], seconds: str) -> DataFrame:
    """Mean wait for the next departure over each of the 48 half hours; after the last the first of the next day counts.

    Between departures p and q the wait falls from q - p to 0, so its integral over the part [a, b] of a slot is
    (b - a) (q - (a + b) / 2): gaps are cut at slot ends and summed. Departures past midnight wrap."""
    clock = departures.select(*keys, F.pmod(F.col(seconds), F.lit(DAY)).alias("q")).distinct()
    w = Window.partitionBy(*keys).orderBy("q")
    every = Window.partitionBy(*keys)
    gaps = clock.select(*keys, "q", F.coalesce(F.lag("q").over(w), F.lit(0)).alias("p"), F.min("q").over(every).alias("_first"), F.max("q").over(every).alias("_last"))
    tail = gaps.where(F.col("q") == F.col("_last")).select(*keys, F.col("_last").alias("p"), F.lit(DAY).alias("end"), (F.col("_first") + DAY).alias("q"))
    parts = gaps.select(*keys, "p", F.col("q").alias("end"), "q").unionByName(tail).where("p < end")
    parts = parts.withColumn("slot", F.explode(F.sequence(F.floor(F.col("p") / SLOT).cast("int"), F.floor((F.col("end") - 1) / SLOT).cast("int"))))
    a, b = F.greatest("p", F.col("slot") * SLOT), F.least("end", (F.col("slot") + 1) * SLOT)
    return parts.groupBy(*keys, "slot").agg(F.round(F.sum((b - a) * (F.col("q") - (a + b) / 2)) / SLOT).cast("int").alias("wait"))


def expand_edge_slots(edges: DataFrame, waits: DataFrame, keys: Sequence[str], days: int = 3, slots: int = 48) -> DataFrame:
    """Every edge x day type x slot with its wait; without service a whole day."""
    grid = edges.withColumn("dow_type", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return grid.join(waits, [*keys, "dow_type", "slot"], "left").withColumn("wait", F.coalesce("wait", F.lit(DAY)))


def segment_travel_time(stops: DataFrame, train: str, line: str, order: Sequence[str], at: str, station: str, name: str, least_share: float = 0.1) -> DataFrame:
    """Median seconds between consecutive stops of trains; pairs of one name or no positive time go, and edges that fewer
    trains run than ``least_share`` of the line's median edge."""
    w = Window.partitionBy(train).orderBy(*order)
    hop = stops.select(line, F.col(station).alias("from_station"), F.lead(station).over(w).alias("to_station"), (F.lead(at).over(w) - F.col(at)).alias("_t"), F.col(name).alias("_a"), F.lead(name).over(w).alias("_b"))
    edges = hop.where("to_station IS NOT NULL AND _t > 0 AND _a <> _b").groupBy(line, "from_station", "to_station").agg(F.median("_t").alias("seconds"), F.count(F.lit(1)).alias("n"))
    usual = F.median("n").over(Window.partitionBy(line))
    return edges.withColumn("_usual", usual).where(F.col("n") >= least_share * F.col("_usual")).drop("_usual")


def congestion_by_station_and_line(df: DataFrame, station: str, line: str, slot: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Station: the highest over lines and directions. Line: the mean of its stations' highest, to one decimal."""
    top = df.groupBy(station, line, slot).agg(F.max(value).alias("_m"))
    return top.groupBy(station, slot).agg(F.max("_m").alias("congestion")), top.groupBy(line, slot).agg(F.round(F.avg("_m"), 1).alias("congestion"))


def latency_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Smallest, nearest-rank median and 95th percentile, largest; negatives do not count."""
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)")
    kind = df.schema[value].dataType
    return df.where(F.col(value) >= 0).groupBy(*keys).agg(F.min(value).alias("least"), rank(0.5).cast(kind).alias("p50"), rank(0.95).cast(kind).alias("p95"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))


#: Size of a quantile sketch. A quantile read from it is one whose rank is off by at most ``SKETCH_ERROR`` of the rows, at 99 %
#: confidence, however many sketches were merged; up to ``SKETCH`` rows it is exact.
SKETCH, SKETCH_ERROR = 2000, 0.0025


def latency_partials(df: DataFrame, keys: Sequence[str], value: str, k: int = SKETCH) -> DataFrame:
    """What a batch leaves of its latencies: ``keys``, n, least, most and a mergeable sketch; negatives do not count."""
    v = F.col(value).cast("bigint")
    return df.where(v >= 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_bigint(v, k).alias("sketch"))


def merged_latency(partials: DataFrame, keys: Sequence[str], k: int = SKETCH) -> DataFrame:
    """Partials of any number of batches as one a key, a partial again."""
    return partials.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def latency_from_partials(partials: DataFrame, keys: Sequence[str], k: int = SKETCH) -> DataFrame:
    """``latency_stats`` of all batches from their partials alone: least, most and n exact, p50 and p95 within ``SKETCH_ERROR``."""
    at = lambda share: F.kll_sketch_get_quantile_bigint("sketch", F.lit(share))
    return merged_latency(partials, keys, k).select(*keys, "least", at(0.5).alias("p50"), at(0.95).alias("p95"), "most", "n")


def route_edges(stops: DataFrame, route: str, seq: str, station: str, speed: float = 5.0) -> DataFrame:
    """Edges between consecutive stops of a route, with seconds by distance."""
    w = Window.partitionBy(route).orderBy(seq)
    nxt = lambda c: F.lead(c).over(w)
    out = stops.select(route, seq, F.col(station).alias("from_stop"), nxt(station).alias("to_stop"), haversine_m(F.col("lat"), F.col("lon"), nxt("lat"), nxt("lon")).alias("metres"))
    return out.where("to_stop IS NOT NULL").withColumn("seconds", F.round(F.col("metres") / speed).cast("int"))


def corridors(edges: DataFrame, route: str) -> DataFrame:
    """The first route of each pair of stops."""
    return edges.groupBy("from_stop", "to_stop").agg(F.min(route).alias(route))


def link_segments(nodes: DataFrame, links: DataFrame, speeds: DataFrame, default: float = 9.0, least: int = 30) -> tuple[DataFrame, DataFrame]:
    """Edges of a line from node and link tables, and the links that are none (unknown end, self).

    Seconds are metres over the line's speed (``default`` where it has none), at least ``least``."""
    a = nodes.select(F.col("node").alias("from_node"), F.col("line").alias("line"))
    b = nodes.select(F.col("node").alias("to_node"), F.lit(True).alias("_to"))
    j = links.join(a, "from_node", "left").join(b, "to_node", "left")
    bad = F.col("line").isNull() | F.col("_to").isNull() | (F.col("from_node") == F.col("to_node"))
    good = j.where(~bad).join(speeds, "line", "left")
    edges = good.select("line", "from_node", "to_node", F.greatest(F.lit(least), F.round(F.col("metres") / F.coalesce("speed", F.lit(default))).cast("int")).alias("seconds"))
    return edges, j.where(bad).select("from_node", "to_node")


def leg_worst(legs: DataFrame, levels: DataFrame, option: str = "option", seq: str = "seq", route: str = "route", edge: str = "edge", seconds: str = "seconds") -> DataFrame:
    """Runs of edges on one route are legs; each edge is met at its running time; the worst level of each leg."""
    w = Window.partitionBy(option).orderBy(seq)
    new = (F.col(route) != F.lag(route).over(w)).cast("int")
    e = legs.withColumns({"_new": F.coalesce(new, F.lit(0)), "_t": F.coalesce(F.sum(seconds).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    e = e.withColumns({"leg": F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "slot": F.floor(F.col("_t") / SLOT).cast("int")})
    return e.join(levels, [edge, "slot"], "left").groupBy(option, "leg").agg(F.max("level").alias("level"), F.max_by(edge, F.struct(F.col("level").isNotNull(), F.col("level"), -F.col(seq))).alias("worst_edge"))


def stock_gate(legs: DataFrame, stock: DataFrame, option: str = "option", seq: str = "seq", seconds: str = "seconds", station: str = "station_no") -> DataFrame:
    """Whether every bike leg of an option starts where stock is predicted (or unknown) at its running time."""
    w = Window.partitionBy(option).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    e = legs.withColumn("slot", F.floor(F.coalesce(F.sum(seconds).over(w), F.lit(0)) / SLOT).cast("int"))
    return e.join(stock, [station, "slot"], "left").groupBy(option).agg(F.bool_and(F.coalesce(F.col("stock") > 0, F.lit(True))).alias("passes"))


def comfort_rank(legs: DataFrame, group: str, option: str, level: str, minutes: str) -> DataFrame:
    """Options of a group by worst known level, then minutes; the first is tagged."""
    o = legs.groupBy(group, option).agg(F.max(level).alias("worst"), F.max(minutes).alias("minutes"))
    w = Window.partitionBy(group).orderBy(F.col("worst").asc_nulls_last(), "minutes", option)
    return o.withColumn("rank", F.row_number().over(w)).withColumn("tagged", (F.col("rank") == 1) & F.col("worst").isNotNull())


def score_options(legs: DataFrame, group: str, option: str, level: str, seconds: str, least: float = 0.5) -> DataFrame:
    """Time-weighted mean and highest level, how much of the time has one; ranked are options with coverage enough."""
    known = F.when(F.col(level).isNotNull(), F.col(seconds))
    o = legs.groupBy(group, option).agg((F.sum(known * F.col(level)) / F.nullif(F.sum(known), F.lit(0))).alias("mean_level"), F.max(level).alias("max_level"), (F.coalesce(F.sum(known), F.lit(0)) / F.sum(seconds)).alias("coverage"), F.sum(F.col(level).isNull().cast("int")).alias("missing"))
    ok = F.col("coverage") >= least
    w = Window.partitionBy(group, ok).orderBy("mean_level", option)
    return o.withColumn("rank", F.when(ok, F.row_number().over(w)))


def top1_change(a: DataFrame, b: DataFrame, group: str, option: str) -> DataFrame:
    """Share of groups whose first option differs between two rankings."""
    x, y = (t.where("rank = 1").select(group, F.col(option).alias(n)) for t, n in ((a, "_a"), (b, "_b")))
    return x.join(y, group).agg(F.avg((F.col("_a") != F.col("_b")).cast("int")).alias("changed"), F.count(F.lit(1)).alias("n"))


def infer_direction(stops: DataFrame, train: str, segment: str, minutes: str, position: str, least: float = 0.9) -> DataFrame:
    """up or down for each train: the sign of most of its steps along the segment that it has most stops on; null if
    fewer than ``least`` of the steps agree."""
    w = Window.partitionBy(train, segment).orderBy(minutes)
    step = F.signum(F.col(position) - F.lag(position).over(w))
    s = stops.withColumn("_s", step).groupBy(train, segment).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("_s") > 0).cast("int")).alias("up"), F.avg((F.col("_s") < 0).cast("int")).alias("down"))
    best = s.groupBy(train).agg(F.max_by(F.struct(segment, "up", "down"), F.struct("n", segment)).alias("_b"))
    up, down = F.col("_b.up"), F.col("_b.down")
    return best.select(train, F.col(f"_b.{segment}").alias(segment), F.when(up >= least, "up").when(down >= least, "down").alias("direction"))


def stalled_series(df: DataFrame, keys: Sequence[str], at: str, lag: str, offset: str) -> DataFrame:
    """Series with lag in every sample that did not shrink; whether the producer moved on meanwhile."""
    g = df.groupBy(*keys).agg(F.min(lag).alias("_least"), F.min_by(lag, at).alias("_first"), F.max_by(lag, at).alias("_last"), F.min_by(offset, at).alias("_o1"), F.max_by(offset, at).alias("_o2"), F.count(F.lit(1)).alias("n"))
    stalled = (F.col("_least") > 0) & (F.col("_last") >= F.col("_first")) & (F.col("n") > 1)
    return g.select(*keys, stalled.alias("stalled"), (F.col("_o2") > F.col("_o1")).alias("advancing"))


def adjacency_pairs(topology: DataFrame, line: str = "line") -> DataFrame:
    """Links of consecutive stations of each segment as (line, a, b)."""
    later = F.slice("stations", 2, F.greatest(F.size("stations") - 1, F.lit(0)))
    zipped = F.filter(F.arrays_zip(F.col("stations").alias("a"), later.alias("b")), lambda x: x["b"].isNotNull())
    return topology.select(line, F.explode(zipped).alias("p")).select(line, F.col("p.a").alias("a"), F.col("p.b").alias("b"))


def expand_ranges(topology: DataFrame, known: DataFrame, line: str = "line") -> DataFrame:
    """Segments given as ranges [a, b] as arrays of known station ids, in order of the ranges, and the ids that are not
    known. Ids meet the known ones in a join and are put together again by line."""
    every = F.flatten(F.transform("ranges", lambda r: F.sequence(r[0], r[1])))
    ids = topology.select(line, F.posexplode(every).alias("_i", "station_no"))
    j = ids.join(known.select("station_no").distinct().withColumn("_known", F.lit(True)), "station_no", "left")
    cells = j.groupBy(line).agg(F.array_sort(F.collect_list(F.struct("_i", "station_no", F.coalesce("_known", F.lit(False)).alias("known")))).alias("_c"))
    of = lambda keep: F.transform(F.filter("_c", keep), lambda c: c["station_no"])
    return cells.select(line, of(lambda c: c["known"]).alias("stations"), F.array_distinct(of(lambda c: ~c["known"])).alias("gaps"))


def connected(edges: DataFrame, keys: Sequence[str], a: str, b: str, checkpoint: bool = True) -> DataFrame:
    """Components of each line: (keys, node, label), label the lowest node. Rounds of lowest label and pointer jumping,
    until nothing changes. Each round is cut by a reliable checkpoint; where no checkpoint folder is set, a local session
    has one in its warehouse and a cluster's session raises."""
    both = edges.select(*keys, F.col(a).alias("node"), F.col(b).alias("near")).union(edges.select(*keys, F.col(b), F.col(a))).distinct()
    cut = scratch.cut if checkpoint else (lambda t: t)
    both = cut(both)
    labels = cut(both.groupBy(*keys, "node").agg(F.least(F.col("node"), F.min("near")).alias("label")))
    while True:
        near = both.join(labels.select(*keys, F.col("node").alias("near"), F.col("label").alias("_l")), [*keys, "near"]).groupBy(*keys, "node").agg(F.min("_l").alias("_near"))
        low = labels.join(near, [*keys, "node"]).select(*keys, "node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = labels.select(*keys, F.col("node").alias("label"), F.col("label").alias("_further"))
        after = cut(low.join(jump, [*keys, "label"], "left").select(*keys, "node", "_old", F.least("label", F.coalesce("_further", "label")).alias("label")))
        labels = after.drop("_old")
        if after.where("_old <> label").isEmpty():
            return labels


def violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """A row (rule, key) for each rule that a row breaks; a rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))
