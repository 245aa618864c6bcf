"""From boardings and alightings to onboard loads, calibrated crowding, trains and links."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions import scalars as S
from tramline.functions import timefn as T
from tramline.operators.stock import station_index
from tramline.scratch import cut


def linear_loads(df: DataFrame, keys: Sequence[str], seq: str = "seq", boarding: str = "boarding", alighting: str = "alighting") -> DataFrame:
    """Load on the link behind each station, up and down the line, if people get off in proportion to alightings.

    With weight w = boarding / (all alightings - own), the load upwards is (sum of w so far) x (alightings still to come)
    and downwards (sum of w from here on) x (alightings before): running sums, no matrix. Nobody alights: 0."""
    line = Window.partitionBy(*keys)
    upto = line.orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    onward = line.orderBy(seq).rowsBetween(0, Window.unboundedFollowing)
    total = F.sum(alighting).over(line)
    w = F.when(total - F.col(alighting) > 0, F.col(boarding) / (total - F.col(alighting))).otherwise(0.0)
    df = df.withColumns({"_total": total, "_w": w, "_seen": F.sum(alighting).over(upto)})
    up = F.sum("_w").over(upto) * (F.col("_total") - F.col("_seen"))
    down = F.sum("_w").over(onward) * (F.col("_seen") - F.col(alighting))
    some = F.col("_total") > 0
    return df.withColumns({"load_up": F.when(some, up).otherwise(0.0), "load_down": F.when(some, down).otherwise(0.0)}).drop("_total", "_w", "_seen")


def circular_loads(df: DataFrame, keys: Sequence[str], seq: str = "seq", boarding: str = "boarding", alighting: str = "alighting") -> DataFrame:
    """Loads on a ring, each trip going the way of fewer stations (ties upwards): trips between all pairs of a ring's
    stations, laid on the stations that they depart from. ``seq`` runs from 0 without gaps.

    Pairs are not built, since a ring of n stations has n² and they pass n³ / 4 of them: ``ring_loads`` has the same sums."""
    return ring_loads(df, keys, seq, boarding, alighting)


def ring_loads(df: DataFrame, keys: Sequence[str], seq: str = "seq", boarding: str = "boarding", alighting: str = "alighting") -> DataFrame:
    """Loads on a ring without its pairs of stations: the ring is laid out three times, and each load is a difference of running sums.

    With m = n // 2 a trip goes upwards if it has m stops or fewer, so of those who board at i up to m stations behind s, all
    pass s who get off in s+1 .. i+m: load_up(s) = sum of w(i) (A(i+m) - A(s)) over i in s-m+1 .. s, where A runs over alightings.
    Downwards likewise with (n - 1) // 2. Sums are read at other places of the ring by laying each row out to the rows that
    read it, so one partitioning by ring serves all, and the work grows with the stations. Stations are numbered by ``seq``."""
    line = Window.partitionBy(*keys)
    ranked = df.withColumn("_i", F.row_number().over(line.orderBy(seq)) - 1)
    total, n = F.sum(alighting).over(line), F.count(F.lit(1)).over(line)
    w = F.when(total - F.col(alighting) > 0, F.col(boarding) / (total - F.col(alighting))).otherwise(0.0)
    laid = ranked.select(*keys, "_i", w.cast("double").alias("_w"), F.col(alighting).cast("double").alias("_a"), n.alias("_n"), (total > 0).alias("_some"))
    run = Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    laid = laid.withColumn("_lap", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn("_t", F.col("_i") + F.col("_lap") * F.col("_n")).withColumn("_A", F.sum("_a").over(run))
    m, k = F.floor(F.col("_n") / 2), F.floor((F.col("_n") - 1) / 2)

    def moved(t: DataFrame, steps: dict[str, tuple[Column, str]], own: Sequence[str]) -> DataFrame:
        """Rows with the values that other rows send them, each to the row ``step`` places on."""
        cells = F.array(F.struct(F.lit("").alias("as"), F.col("_t").alias("t")), *[F.struct(F.lit(name).alias("as"), (F.col("_t") + step).alias("t")) for name, (step, _) in steps.items()])
        sent = t.withColumn("_c", F.explode(cells))
        of = lambda name, v: F.max(F.when(F.col("_c.as") == name, F.col(v)))
        put = sent.groupBy(*keys, F.col("_c.t").alias("_t")).agg(*[of("", v).alias(v) for v in own], *[of(name, v).alias(name) for name, (_, v) in steps.items()])
        return put.where("_n IS NOT NULL")

    there = moved(laid, {"_Am": (-m, "_A"), "_Ak": (k + 1, "_A")}, ["_i", "_n", "_some", "_w", "_A"])
    sums = there.withColumns({"_W": F.sum("_w").over(run), "_U": F.sum(F.col("_w") * F.coalesce("_Am", F.lit(0.0))).over(run), "_D": F.sum(F.col("_w") * F.coalesce("_Ak", F.lit(0.0))).over(run)})
    at = {"_Um": (m, "_U"), "_Wm": (m, "_W"), "_A1": (F.lit(1), "_A"), "_W1": (F.lit(1), "_W"), "_D1": (F.lit(1), "_D"), "_Wk": (1 - k, "_W"), "_Dk": (1 - k, "_D")}
    ends = moved(sums, at, ["_i", "_n", "_some", "_A", "_U", "_W"]).where("_t = _i")
    up = (F.col("_U") - F.col("_Um")) - F.col("_A") * (F.col("_W") - F.col("_Wm"))
    down = F.col("_A1") * (F.col("_Wk") - F.col("_W1")) - (F.col("_Dk") - F.col("_D1"))
    # what the differences leave below 0 is rounding
    load = lambda v: F.when(F.col("_some"), F.greatest(v, F.lit(0.0))).otherwise(0.0)
    loads = ends.select(*[F.col(c).alias(f"_of_{c}") for c in keys], F.col("_i").alias("_at"), load(up).alias("load_up"), load(down).alias("load_down"))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in keys]
    return ranked.join(loads, [*same, F.col("_i") == F.col("_at")]).drop("_i", "_at", *[f"_of_{c}" for c in keys])


def clip_negative(df: DataFrame, value: str, lookup: str) -> DataFrame:
    """A negative prediction takes the look-up, a negative one of those 0; missing stays missing. ``source`` tells."""
    v, l = F.nanvl(F.col(value), F.lit(None).cast("double")), F.col(lookup)
    out = F.when(v >= 0, v).when(v < 0, F.when(l >= 0, l).otherwise(F.lit(0.0)))
    source = F.when(v >= 0, "model").when(v < 0, F.when(l >= 0, "lookup").otherwise("zero"))
    return df.withColumns({"clipped": out, "source": source})


def data_status(no_lookup: Column, fallback: Column, truncated: Column, no_calibration: Column) -> Column:
    """The first that holds, by precedence."""
    return F.when(no_lookup, "no_lookup").when(fallback, "calibration_fallback").when(truncated, "segment_truncated").when(no_calibration, "no_calibration").otherwise("ok")


def value_flags(df: DataFrame, value: str, limit: float = 100.0, high: float = 150.0) -> DataFrame:
    """A row for each flag that a value has: zero, over_100, very_high."""
    v = F.col(value)
    flags = F.filter(F.array(F.when(v == 0, "zero"), F.when(v > limit, "over_100"), F.when(v > high, "very_high")), lambda f: f.isNotNull())
    return df.withColumn("flag", F.explode(flags))


def reroute_trigger(df: DataFrame, p_empty: str, stock: str, source: str, eta: str, risk: float = 0.5, most_eta: float = 30.0) -> DataFrame:
    """Whether a reading calls for another route, and why: rules in order, the first that holds decides."""
    reason = (
        F.when(F.col(eta).isNull() | F.col(p_empty).isNull(), "no_data")
        .when(F.col(eta) > most_eta, "out_of_range")
        .when(F.col(source) == "fallback", "low_confidence")
        .when(F.col(stock) <= 0, "empty")
        .when(F.col(p_empty) >= risk, "risk")
        .otherwise("fine")
    )
    return df.withColumns({"reason": reason, "fired": reason.isin("empty", "risk")})


def headway_share(tt: DataFrame, keys: Sequence[str], minutes: str = "arr_min", train: str = "train_id", long: float = 20.0, h0: float | None = None, h1: float = 15.0) -> DataFrame:
    """Gap to the train before (first: 30), a train's share of its half hour by gaps, and whether the gap is long.

    With ``h0`` the share is mixed with an equal split by ``mix_weight`` and made to sum to 1 again."""
    w = Window.partitionBy(*keys).orderBy(minutes, train)
    df = tt.withColumns({"headway_min": F.coalesce((F.col(minutes) - F.lag(minutes).over(w)).cast("double"), F.lit(30.0)), "slot30": T.minutes_to_slot30(F.col(minutes))})
    slot = Window.partitionBy(*keys, "slot30")
    df = df.withColumn("share", F.col("headway_min") / F.nullif(F.sum("headway_min").over(slot), F.lit(0.0)))
    if h0 is not None:
        m = S.mix_weight(F.col("headway_min"), h0, h1)
        df = df.withColumn("share", m * F.coalesce("share", F.lit(0.0)) + (1 - m) / F.count(train).over(slot))
        df = df.withColumn("share", F.col("share") / F.sum("share").over(slot))
    return df.withColumn("headway_long", F.col("headway_min") > long)


def run_split(df: DataFrame, keys: Sequence[str], minutes: str, tie: str, gap: float = 20.0, station: str = "station_no") -> DataFrame:
    """Numbers the runs of a train (a new one after a gap) with the stations before and after in the run."""
    w = Window.partitionBy(*keys).orderBy(minutes, tie)
    new = (F.col(minutes) - F.lag(minutes).over(w) > gap).cast("int")
    df = df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    r = Window.partitionBy(*keys, "run").orderBy(minutes, tie)
    return df.withColumns({"prev_station": F.lag(station).over(r), "next_station": F.lead(station).over(r)})


def node_states(df: DataFrame, keys: Sequence[str], order: Sequence[str], adjacent: DataFrame, load: str = "load", station: str = "station_no") -> DataFrame:
    """Arriving load = load that left the stop before; 0 at the first stop; null where the two are not neighbours."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumns({"_prev": F.lag(station).over(w), "_load": F.lag(load).over(w), "_i": F.row_number().over(w)})
    near = adjacent.select(F.col("station_no").alias(station), F.col("other").alias("_prev")).distinct().withColumn("_near", F.lit(True))
    out = df.join(near, [station, "_prev"], "left")
    source = F.when(F.col("_i") == 1, "first").when(F.col("_near"), "previous").otherwise("not_adjacent")
    return out.withColumns({"arriving": F.when(F.col("_i") == 1, F.lit(0.0)).when(F.col("_near"), F.col("_load")), "source": source}).drop("_prev", "_load", "_i", "_near")


def resolve_links(df: DataFrame, keys: Sequence[str], segment: str, match: str, load: str) -> DataFrame:
    """One segment for each stop: the only one whose neighbours match, else the highest load, else the first by name;
    ``ambiguous`` where several match or none."""
    w = Window.partitionBy(*keys)
    fits = F.sum(F.col(match).cast("int")).over(w)
    df = df.withColumns({"_fits": fits, "_n": F.count(F.lit(1)).over(w)})
    best = w.orderBy(F.when(F.col("_fits") == 1, F.col(match).cast("int")).otherwise(0).desc(), F.col(load).desc_nulls_last(), segment)
    return df.withColumns({"_r": F.row_number().over(best), "ambiguous": (F.col("_n") > 1) & (F.col("_fits") != 1)}).where("_r = 1").drop("_r", "_fits", "_n")


def allocate_flows(df: DataFrame, slot_keys: Sequence[str], direction: str, share: str, load: str, flow: str, by_load: bool = False) -> DataFrame:
    """A slot's flow over its trains: first over directions (by load, equally where there is none), then by share in a
    direction. The parts of a slot sum to its flow."""
    slot = Window.partitionBy(*slot_keys)
    way = Window.partitionBy(*slot_keys, direction)
    directions = F.size(F.collect_set(direction).over(slot))
    df = df.withColumns({"_dirs": directions, "_dir_load": F.sum(load).over(way), "_all": F.sum(load).over(slot), "_share": F.sum(share).over(way), "_k": F.count(F.lit(1)).over(way)})
    equally = F.col(flow) / F.col("_dirs")
    of_direction = F.when(F.col("_all") > 0, F.col(flow) * F.col("_dir_load") / F.col("_all")).otherwise(equally) if by_load else equally
    within = F.when(F.col("_share") > 0, F.col(share) / F.col("_share")).otherwise(1 / F.col("_k"))
    return df.withColumn("allocated", of_direction * within).drop("_dirs", "_dir_load", "_all", "_share", "_k")


def split_hourly(df: DataFrame, shares: DataFrame, keys: Sequence[str], hour: str, value: str, slot: str = "slot30") -> DataFrame:
    """Each hour as two half hours by a table of shares; a missing share leaves the value missing."""
    halves = df.withColumn(slot, F.explode(T.half_hours(F.col(hour))))
    return halves.join(shares, [*keys, slot], "left").withColumn(f"{value}_30min", F.col(value) * F.col("share"))


def apply_calibration(df: DataFrame, table: DataFrame, keys: Sequence[str], raw: str = "raw") -> DataFrame:
    """(raw + offset) x ratio on the half hours of each hour; without a ratio null, without an offset 0."""
    halves = df.withColumn("slot30", F.explode(T.half_hours(F.col("hour"))))
    out = halves.join(table, [*keys, "slot30"], "left")
    return out.withColumn("calibrated", (F.col(raw) + F.coalesce("offset", F.lit(0.0))) * F.col("ratio"))


def trains_per_slot(tt: DataFrame, keys: Sequence[str], minutes: str = "arr_min", train: str = "train_id") -> DataFrame:
    return tt.groupBy(*keys, T.minutes_to_slot30(F.col(minutes)).alias("slot30")).agg(F.countDistinct(train).alias("trains"))


def link_targets(topology: DataFrame, line: str = "line") -> DataFrame:
    """Station and direction to the next station of its segment (up, down); rings wrap."""
    pairs = topology.select(line, "circular", "stations", F.posexplode("stations").alias("_i", "station_no"))
    n = F.size("stations")
    ring = F.col("circular") & (n > 2)
    up = F.when(F.col("_i") < n - 1, F.get("stations", F.col("_i") + 1)).when(ring, F.get("stations", F.lit(0)))
    down = F.when(F.col("_i") > 0, F.get("stations", F.col("_i") - 1)).when(ring, F.get("stations", n - 1))
    ways = F.array(F.struct(F.lit("up").alias("direction"), up.alias("to_station")), F.struct(F.lit("down").alias("direction"), down.alias("to_station")))
    return pairs.select(line, "station_no", F.explode(ways).alias("w")).select(line, "station_no", "w.direction", "w.to_station").where("to_station IS NOT NULL")


def to_link_table(nodes: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of directed links, and the keys that have no link with their counts."""
    links = nodes.join(targets, ["station_no", "direction"])
    dropped = nodes.join(targets.select("station_no", "direction"), ["station_no", "direction"], "left_anti")
    return links, dropped.groupBy("station_no", "direction").agg(F.count(F.lit(1)).alias("n"))


def truncated_cells(topology: DataFrame, line: str = "line") -> DataFrame:
    """The end stations of segments that the data cuts off."""
    ends = F.array_distinct(F.array(F.element_at("stations", 1), F.element_at("stations", -1)))
    return topology.where("truncated").select(line, F.explode(ends).alias("station_no"))


def borrow_neighbor(df: DataFrame, borrow: DataFrame, keys: Sequence[str], values: Sequence[str], station: str = "station_no") -> DataFrame:
    """Empty cells of stations in ``borrow`` (station_no, from_station) take the values of the other station's cell."""
    other = df.select(F.col(station).alias("from_station"), *keys, *[F.col(v).alias(f"_{v}") for v in values])
    out = df.join(borrow.select(F.col("station_no").alias(station), "from_station"), station, "left").join(other, ["from_station", *keys], "left")
    took = F.coalesce(*[F.col(v).isNull() for v in values[:1]]) & F.col(f"_{values[0]}").isNotNull()
    return out.withColumns({"borrowed": F.coalesce(took, F.lit(False)), **{v: F.coalesce(v, f"_{v}") for v in values}}).drop("from_station", *[f"_{v}" for v in values])


def grouped_line_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, const: bool = True) -> DataFrame:
    """Slope and intercept by group from sums; without a constant the slope is sum(xy) / sum(xx)."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    g = df.where(both).groupBy(*keys)
    if const:
        return g.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))
    return g.agg((F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(F.col(x) * F.col(x)), F.lit(0.0))).alias("slope"), F.lit(0.0).alias("intercept"), F.count(F.lit(1)).alias("n"))


def boundary_offset(df: DataFrame, keys: Sequence[str], x: str, y: str, boundary: str, least: int = 4) -> DataFrame:
    """Offset of boundary cells: slope through 0 of the interior cells, then mean boundary y / slope - mean boundary x.
    Groups with fewer than ``least`` interior points have none. ``joint_boundary_fit`` fits both at once."""
    inner, edge = ~F.col(boundary), F.col(boundary)
    slope = F.sum(F.when(inner, F.col(x) * F.col(y))) / F.nullif(F.sum(F.when(inner, F.col(x) * F.col(x))), F.lit(0.0))
    g = df.groupBy(*keys).agg(slope.alias("slope"), F.count(F.when(inner, 1)).alias("n_inner"), F.avg(F.when(edge, F.col(y))).alias("_y"), F.avg(F.when(edge, F.col(x))).alias("_x"))
    return g.select(*keys, "slope", "n_inner", F.when(F.col("n_inner") >= least, F.col("_y") / F.nullif(F.col("slope"), F.lit(0.0)) - F.col("_x")).alias("offset"))


def joint_boundary_fit(df: DataFrame, keys: Sequence[str], x: str, y: str, boundary: str) -> DataFrame:
    """``slope, offset, joint, mae`` by group: y = slope (x + offset) on boundary cells and slope x on the others.

    The anchored fit takes the slope through 0 of the interior and the offset that meets the boundary's mean, not below 0
    and 0 where there is no boundary or no slope. The joint fit minimises the squares of all cells at once (slope and
    slope x offset are linear in it: four sums). It is taken where it lowers the mean absolute error. Two groupings, for
    the sums and for the errors of both fits."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(boundary).isNotNull())
    inner, edge = ~F.col(boundary), F.col(boundary)
    total = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0.0))
    xy, xx = F.col(x) * F.col(y), F.col(x) * F.col(x)
    g = rows.groupBy(*keys).agg(
        total(inner, xy).alias("_ixy"), total(inner, xx).alias("_ixx"), total(edge, xy).alias("_exy"), total(edge, xx).alias("_exx"),
        total(edge, F.col(x)).alias("_ex"), total(edge, F.col(y)).alias("_ey"), F.count_if(edge).alias("_n"),
    )
    n = F.nullif(F.col("_n").cast("double"), F.lit(0.0))
    slope = F.col("_ixy") / F.nullif(F.col("_ixx"), F.lit(0.0))
    offset = F.coalesce(F.greatest(F.lit(0.0), F.col("_ey") / n / F.nullif(slope, F.lit(0.0)) - F.col("_ex") / n), F.lit(0.0))
    # normal equations of y = b x + c [boundary]: the boundary's own mean takes c out
    b = (F.col("_ixy") + F.col("_exy") - F.coalesce(F.col("_ex") * F.col("_ey") / n, F.lit(0.0))) / F.nullif(F.col("_ixx") + F.col("_exx") - F.coalesce(F.col("_ex") * F.col("_ex") / n, F.lit(0.0)), F.lit(0.0))
    c = F.coalesce(F.greatest(F.lit(0.0), (F.col("_ey") / n - b * F.col("_ex") / n) / F.nullif(b, F.lit(0.0))), F.lit(0.0))
    fits = g.select(*keys, slope.alias("_s0"), offset.alias("_o0"), b.alias("_s1"), c.alias("_o1"))
    error = lambda k: F.avg(F.abs(F.col(y) - F.col(f"_s{k}") * (F.col(x) + F.when(edge, F.col(f"_o{k}")).otherwise(0.0))))
    e = rows.join(fits, list(keys)).groupBy(*keys, "_s0", "_o0", "_s1", "_o1").agg(error(0).alias("_e0"), error(1).alias("_e1"))
    joint = F.coalesce(F.col("_e1") < F.col("_e0"), F.lit(False))
    pick = lambda p: F.when(joint, F.col(f"{p}1")).otherwise(F.col(f"{p}0"))
    return e.select(*keys, pick("_s").alias("slope"), pick("_o").alias("offset"), joint.alias("joint"), pick("_e").alias("mae"))


def grouped_ols3(df: DataFrame, keys: Sequence[str], y: str, x: Sequence[str], least: int = 10) -> DataFrame:
    """Least squares on three regressors without constant by group: nine sums in one aggregation, solved by Cramer."""
    a, b, c = x
    ok = F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(c).isNotNull()
    s = lambda u, v: F.sum(F.col(u) * F.col(v))
    g = df.where(ok).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), s(a, a).alias("aa"), s(a, b).alias("ab"), s(a, c).alias("ac"), s(b, b).alias("bb"), s(b, c).alias("bc"), s(c, c).alias("cc"), s(a, y).alias("ay"), s(b, y).alias("by"), s(c, y).alias("cy"))
    m = [["aa", "ab", "ac"], ["ab", "bb", "bc"], ["ac", "bc", "cc"]]
    v = ["ay", "by", "cy"]

    def det(r: list[list[str]]) -> Column:
        (p, q, u), (d, e, f), (g_, h, i) = [[F.col(k) for k in row] for row in r]
        return p * (e * i - f * h) - q * (d * i - f * g_) + u * (d * h - e * g_)

    whole = F.nullif(det(m), F.lit(0.0))
    beta = [det([[v[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / whole for k in range(3)]
    return g.where(F.col("n") >= least).select(*keys, "n", *[t.alias(f"beta_{k}") for t, k in zip(beta, x, strict=True)])


def chi2_2x2(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """The chi-square statistic (no correction) of two conditions."""
    n = lambda c: F.sum(c.cast("double"))
    t = df.agg(n(a & b).alias("p"), n(a & ~b).alias("q"), n(~a & b).alias("r"), n(~a & ~b).alias("s"))
    p, q, r, s = (F.col(x) for x in "pqrs")
    return t.select(((p + q + r + s) * F.pow(p * s - q * r, 2) / F.nullif((p + q) * (r + s) * (p + r) * (q + s), F.lit(0.0))).alias("chi2"))


def kruskal_h(df: DataFrame, group: str, value: str) -> DataFrame:
    """The Kruskal-Wallis statistic with the correction for ties."""
    from tramline.operators.panel import average_rank

    ranked = average_rank(df.where(F.col(value).isNotNull()), value, "_r")
    by = ranked.groupBy(group).agg(F.sum("_r").alias("_s"), F.count(F.lit(1)).alias("_n"))
    h = by.agg(F.sum("_n").alias("n"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("q"))
    ties = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_t")).agg(F.sum(F.pow(F.col("_t"), 3) - F.col("_t")).alias("t"))
    n = F.col("n").cast("double")
    return h.crossJoin(F.broadcast(ties)).select(((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))).alias("h"))


class BlockSums:
    """Sums over the common times of each two stations of two blocks, added up part of time by part of time."""

    def __init__(self, ga: int, gb: int, low: np.ndarray, high: np.ndarray, block: int):
        self.first, self.block, self.low, self.high = (ga * block, gb * block), block, low, high
        self.place = [np.full(block, -1, np.int64) for _ in range(2)]
        self.sums = np.zeros((6, block, block))

    def add(self, rows: list[tuple]) -> None:
        """``rows`` of one part of time: number, place, mean, times and values of a station."""
        when = np.unique(np.concatenate([r[3] for r in rows]))
        sides = []
        for first, place in zip(self.first, self.place, strict=True):
            mine = [r for r in rows if first <= r[0] < first + self.block]
            at = np.array([r[0] - first for r in mine], np.int64)
            place[at] = [r[1] for r in mine]
            there, v = np.zeros((len(mine), len(when))), np.zeros((len(mine), len(when)))
            for k, (_, _, mean, times, given) in enumerate(mine):
                column = np.searchsorted(when, times)
                # values around their station's mean, so that squares of large numbers do not cancel
                there[k, column], v[k, column] = 1, np.asarray(given) - mean
            sides.append((at, there, v))
        (i, m, x), (j, k, y) = sides
        for total, part in zip(self.sums, ((m, k), (x, k), (m, y), (x * x, k), (m, y * y), (x, y)), strict=True):
            total[np.ix_(i, j)] += part[0] @ part[1].T

    def result(self) -> tuple[float, int]:
        """Sum and number of the correlations of the pairs that are asked for."""
        (a, i), (b, j) = (np.unique(c, return_inverse=True) for c in (self.low, self.high))
        asked = np.zeros((len(a) + 1, len(b) + 1), bool)
        asked[i, j] = True
        row, column = (np.where(np.isin(p, known), np.searchsorted(known, p), len(known)) for p, known in zip(self.place, (a, b), strict=True))
        number = [np.arange(f, f + self.block) for f in self.first]
        n, x, y, xx, yy, xy = self.sums[:, asked[np.ix_(row, column)] & (number[0][:, None] < number[1])]
        spread = (n * xx - x * x) * (n * yy - y * y)
        ok = (n > 0) & (spread > 0)
        return float(((n * xy - x * y)[ok] / np.sqrt(spread[ok])).sum()), int(ok.sum())


def neighbor_correlation(values: DataFrame, pairs: DataFrame, station: str, time: str, value: str, block: int = 64, times: int = 1024, places: DataFrame | None = None) -> DataFrame:
    """Mean over the pairs (``a, b``) of correlations of two stations' values at equal times; a (station, time) stands once, and
    a pair counts once in whichever order.

    With ``places`` (``station, place, order``) pairs are of places: a station is paired with those of the other place, and with
    those of its own if a place is paired with itself. ``order`` should be close for places that are.

    Stations are numbered by ``order`` and place and dealt to blocks of ``block``, so that the neighbours of a block are in few
    others. Two blocks with a pair in them are a task: it gets each series of a place that is paired there once, as arrays of one of
    the parts of about ``times`` times, adds up the sums of all its pairs by products of matrices, part by part, and gives the
    correlations' sum. So no pair of stations is a row, and no task holds more than the sums of two blocks and one part."""
    rows = values.select(F.col(station).alias("s"), F.col(time).alias("_t"), F.col(value).cast("double").alias("v")).where("s IS NOT NULL AND _t IS NOT NULL AND v IS NOT NULL")
    parts = max(1, math.ceil(rows.agg(F.approx_count_distinct("_t")).first()[0] / times))
    t = {"date": F.unix_date, "timestamp": F.unix_micros}.get(values.schema[time].dataType.typeName(), F.xxhash64)("_t").cast("long")
    rows = rows.select("s", t.alias("t"), "v").withColumn("p", F.pmod(F.xxhash64("t"), F.lit(parts)).cast("int"))
    series = rows.groupBy("s", "p").agg(F.collect_list(F.struct("t", "v")).alias("_c"), F.sum("v").alias("_v"), F.count(F.lit(1)).alias("_n"))
    every = Window.partitionBy("s")
    series = series.select("s", "p", F.col("_c.t").alias("t"), F.col("_c.v").alias("v"), (F.sum("_v").over(every) / F.sum("_n").over(every)).alias("mean"))

    if places is None:
        known = rows.select("s").distinct().select("s", F.col("s").alias("place"), F.col("s").alias("order"))
    else:
        known = places.select(F.col("station").alias("s"), "place", "order").where("s IS NOT NULL")
    # the stations of a place follow one another, so of two places all numbers of one are lower
    number = station_index(known.select(F.struct("order", "place", "s").alias("e")), "e").select("e.s", "e.place", F.col("code").cast("long").alias("code"))
    first = number.groupBy("place").agg(F.min("code").alias("spot"))
    number = number.join(first, "place").select("s", "code", "spot", F.floor(F.col("code") / block).cast("int").alias("g"))
    of = lambda c: first.select(F.col("place").alias(c), F.col("spot").alias(f"_{c}"))
    wanted = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").select(F.least("_a", "_b").alias("low"), F.greatest("_a", "_b").alias("high")).distinct()
    held = number.select("spot", "g").distinct()
    at = lambda c, g: held.select(F.col("spot").alias(c), F.col("g").alias(g))
    # at most block x block pairs of places in a list
    lists = wanted.join(at("low", "ga"), "low").join(at("high", "gb"), "high").where("ga <= gb").groupBy("ga", "gb").agg(F.collect_list(F.struct("low", "high")).alias("_c"))
    lists = cut(lists.select("ga", "gb", F.col("_c.low").alias("low"), F.col("_c.high").alias("high")))
    tasks = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), lists.count())
    end = lambda c, g: F.transform(c, lambda p: F.struct(F.col(g).alias("g"), p.alias("spot")))
    ends = F.explode(F.array_distinct(F.concat(end("low", "ga"), end("high", "gb"))))
    ends = lists.select("ga", "gb", ends.alias("_e")).select("ga", "gb", "_e.g", "_e.spot")
    sent = series.join(number.join(ends, ["g", "spot"]), "s").select("ga", "gb", "p", "code", "spot", "mean", "t", "v")
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    asked = lists.select("ga", "gb", F.lit(-1).alias("p"), none("code", "long"), none("spot", "long"), none("mean", "double"), none("t", "array<long>"), none("v", "array<double>"), "low", "high")
    dealt = sent.unionByName(asked, allowMissingColumns=True).repartition(tasks, "ga", "gb").sortWithinPartitions("ga", "gb", "p")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, part, sums, held, found = None, None, None, [], []
        for pdf in batches:
            for ga, gb, p, code, spot, mean, t, v, low, high in zip(*[pdf[c] for c in ("ga", "gb", "p", "code", "spot", "mean", "t", "v", "low", "high")], strict=True):
                if held and ((ga, gb) != here or p != part):
                    sums.add(held)
                    held = []
                if (ga, gb) != here:
                    if sums is not None:
                        found.append(sums.result())
                    # the list comes before the parts of time
                    here, sums = (ga, gb), BlockSums(ga, gb, low, high, block)
                else:
                    held.append((int(code), int(spot), mean, t, v))
                part = p
        if held:
            sums.add(held)
        if sums is not None:
            found.append(sums.result())
        yield pd.DataFrame(found, columns=["c", "n"]).astype({"c": float, "n": "int64"})

    total = dealt.mapInPandas(walk, "c double, n long").agg(F.sum("c").alias("c"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    return total.select((F.col("c") / F.nullif("pairs", F.lit(0))).alias("mean_corr"), "pairs")


def effect_by_condition(df: DataFrame, conditions: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*conditions).agg(F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.count(value).alias("n"))


def history_arrays(df: DataFrame, station: str, date: str, slot: str, values: Sequence[str], days: int, slots: int) -> DataFrame:
    """For each (station, date) the ``days`` days before as an array of slots x values, null where nothing was seen, and
    a mask of what was. A day is first put together; days are then gathered over a range of dates."""
    cell = F.struct(F.col(slot).alias("slot"), *values)
    day = df.groupBy(station, date).agg(F.collect_list(cell).alias("_c"))
    of = lambda c, s: F.get(F.filter(c, lambda x: x["slot"] == s), F.lit(0))
    day = day.select(station, date, F.transform(F.sequence(F.lit(1), F.lit(slots)), lambda s: of(F.col("_c"), s)).alias("_row"))
    w = Window.partitionBy(station).orderBy(F.unix_date(date)).rangeBetween(-days, -1)
    past = day.withColumn("_past", F.collect_list(F.struct(F.col(date).alias("d"), F.col("_row").alias("row"))).over(w))
    back = F.sequence(F.lit(days), F.lit(1), F.lit(-1))
    row = lambda n: F.get(F.filter("_past", lambda p: p["d"] == F.date_sub(F.col(date), n)), F.lit(0))["row"]
    out = past.withColumn("history", F.transform(back, row))
    mask = F.transform("history", lambda r: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.get(r, i)[values[0]].isNotNull(), F.lit(False))))
    return out.select(station, date, "history", mask.alias("mask"))


def sequence_mask(df: DataFrame, keep: Sequence[int], days: int, column: str = "history") -> DataFrame:
    """Null for the days of a history array (oldest first) whose lag is not in ``keep``."""
    kept = F.array(*[F.lit(k) for k in keep])
    return df.withColumn(column, F.transform(column, lambda r, i: F.when(F.array_contains(kept, (F.lit(days) - i)), r)))
