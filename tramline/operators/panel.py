"""The ridership panel: lags by calendar, look-ups, neighbours, long and wide forms, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions import timefn as T
from tramline.operators.quantiles import exact_quantiles


def dealt(df: DataFrame, parts: int | None, keys: Sequence[str]) -> DataFrame:
    """``df`` by its keys in ``parts`` tasks, as it is if that is None."""
    return df.repartition(parts, *keys) if parts else df


def time_split(df: DataFrame, date: Column, day: str = "date") -> tuple[DataFrame, DataFrame]:
    return df.where(F.col(day) < date), df.where(F.col(day) >= date)


def fit_window(df: DataFrame, variant: str, at: Column, weeks: int = 4, day: str = "date") -> DataFrame:
    """Rows to fit on: "all", "same_year" as ``at``, or "near": within ``weeks`` weeks of it."""
    if variant == "all":
        return df
    return df.where(F.year(day) == F.year(at) if variant == "same_year" else F.abs(F.datediff(day, at)) <= 7 * weeks)


def weighted_mean(df: DataFrame, keys: Sequence[str], value: str, weight: Column) -> DataFrame:
    """Mean by keys; a null value takes its own weight out, no weight makes null."""
    w = F.when(F.col(value).isNotNull(), weight)
    return df.groupBy(*keys).agg((F.sum(w * F.col(value)) / F.nullif(F.sum(w), F.lit(0.0))).alias(value))


def lookup_means(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.avg(v).alias(f"{v}_lookup") for v in values])


def lookup_join(df: DataFrame, means: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(means, list(keys), "left")


def residual_cols(df: DataFrame, values: Sequence[str]) -> DataFrame:
    return df.withColumns({f"{v}_residual": F.col(v) - F.col(f"{v}_lookup") for v in values})


def day_lags(df: DataFrame, keys: Sequence[str], values: Sequence[str], days: Sequence[int] = (1, 7), date: str = "date") -> DataFrame:
    """Values of the same key exactly n days before, null where that day is missing: no join for any number of lags.

    A lag is a frame of the one day n days back in the key's dates, so all lags are one partitioning by key, which a table that
    is dealt by some of its keys already has; (key, date) is unique."""
    dates = Window.partitionBy(*keys).orderBy(F.unix_date(date))
    lags = [F.max(v).over(dates.rangeBetween(-n, -n)).alias(f"{v}_lag{n}d") for n in days for v in values]
    return df.select(*keys, date, *values, *lags)


def slot_lag(df: DataFrame, keys: Sequence[str], slot: str, values: Sequence[str]) -> DataFrame:
    """The value of the slot before in the given numbering; the first slot has none, nor one after a missing slot."""
    before = df.select(*keys, (F.col(slot) + 1).alias(slot), *[F.col(v).alias(f"{v}_prev") for v in values])
    return df.join(before, [*keys, slot], "left")


def same_day_type_lag(df: DataFrame, keys: Sequence[str], value: str, max_gap: int = 14, date: str = "date") -> DataFrame:
    """The value of the previous row of the same keys (a day type among them), null if it is over ``max_gap`` days ago."""
    w = Window.partitionBy(*keys).orderBy(date)
    near = F.datediff(date, F.lag(date).over(w)) <= max_gap
    return df.withColumn(f"{value}_same_type", F.when(near, F.lag(value).over(w)))


def attach_weather(df: DataFrame, weather: DataFrame, hour: Column, date: str = "date", values: Sequence[str] = ("temp",)) -> DataFrame:
    """Weather of the row's hour; hours from 24 on are of the next day."""
    keyed = df.withColumn("_h", hour).withColumn("_date", F.date_add(date, F.floor(F.col("_h") / 24).cast("int"))).withColumn("_hour", F.pmod(F.col("_h"), F.lit(24)))
    w = weather.select(F.col(date).alias("_date"), F.col("hour").alias("_hour"), *values)
    return keyed.join(w, ["_date", "_hour"], "left").drop("_h", "_date", "_hour")


def demean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.withColumn(f"{value}_demeaned", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def centered_moving_avg(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int = 3) -> DataFrame:
    """Mean of the k rows before to k after; null where the window is cut."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-k, k)
    return df.withColumn(f"{value}_smooth", F.when(F.count(value).over(w) == 2 * k + 1, F.avg(value).over(w)))


def pivot_direction(long: DataFrame, keys: Sequence[str], column: str = "direction", value: str = "passengers", values: Sequence[str] = ("boarding", "alighting")) -> DataFrame:
    return long.groupBy(*keys).agg(*[F.sum(F.when(F.col(column) == v, F.col(value))).alias(v) for v in values])


def unpivot_hours(wide: DataFrame, keys: Sequence[str], hours: Sequence[str], value: str = "passengers") -> DataFrame:
    """Hour columns ("5시", "hour_05" ..) as rows with a slot "HH"."""
    long = wide.unpivot(list(keys), list(hours), "_column", value)
    return long.select(*keys, F.lpad(F.regexp_extract("_column", r"([0-9]{1,2})", 1), 2, "0").alias("hour"), value)


def reshape_service_day(df: DataFrame, keys: Sequence[str], hour: str, value: str, date: str = "date", late_until: int = 4) -> DataFrame:
    """Hours to ``late_until`` belong to the day before as "24~", hour 5 is "~06"; sums again by label."""
    h = F.col(hour)
    rows = df.select(*[k for k in keys if k != date], F.when(h <= late_until, F.date_sub(date, 1)).otherwise(F.col(date)).alias(date), T.service_slot(h, late_until).alias("slot"), value)
    return rows.groupBy(*keys, "slot").agg(F.sum(value).alias(value))


def ratio_quantiles(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, count and exact median and 90th percentile."""
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9)))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.count(value).alias("n"), q.alias("_q")).withColumns({"p50": F.col("_q")[0], "p90": F.col("_q")[1]}).drop("_q")


def raw_hourly_mean(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def calibration_ratio(snapshot: DataFrame, means: DataFrame, keys: Sequence[str], share: str, mean: str = "mean") -> DataFrame:
    """Snapshot over mean; null on a zero mean. A key that stands twice in the snapshot stops the job."""
    n = Window.partitionBy(*keys)
    once = snapshot.withColumn("_n", F.count(F.lit(1)).over(n))
    guarded = once.withColumn(share, F.when(F.col("_n") == 1, F.col(share)).otherwise(F.raise_error(F.lit("duplicate snapshot key")).cast("double"))).drop("_n")
    out = guarded.join(means.select(*keys, mean), list(keys), "left")
    return out.withColumns({"ratio": F.col(share) / F.nullif(F.col(mean), F.lit(0.0)), "matched": F.col(mean).isNotNull()})


def half_hour_shares(df: DataFrame, keys: Sequence[str], hour: str, slot: str, ratio: str) -> DataFrame:
    """Share of a half hour in its hour: by direction first, then the mean over directions, made to sum to 1 again.

    ``keys`` begin with those that stay; the last is the direction."""
    stay = list(keys[:-1])
    within = Window.partitionBy(*keys, hour)
    shares = df.withColumn("_s", F.col(ratio) / F.nullif(F.sum(ratio).over(within), F.lit(0.0)))
    mean = shares.groupBy(*stay, hour, slot).agg(F.avg("_s").alias("_m"))
    again = Window.partitionBy(*stay, hour)
    return mean.select(*stay, hour, slot, (F.col("_m") / F.nullif(F.sum("_m").over(again), F.lit(0.0))).alias("share"))


def ridership_sum_long(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums over everything that is no key (card types), in long form."""
    return df.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values]).unpivot(list(keys), list(values), "direction", "passengers")


def residual_breakdown(df: DataFrame, keys: Sequence[str], residual: Column) -> DataFrame:
    """By key: rows, RMSE, shares of rows and of squared error, and how far the second is over the first."""
    g = df.groupBy(*keys).agg(F.count(residual).alias("n"), F.sum(residual * residual).alias("_sse"))
    whole = Window.partitionBy(F.lit(1))
    g = g.withColumns({"rmse": F.sqrt(F.col("_sse") / F.col("n")), "row_share": F.col("n") / F.sum("n").over(whole), "error_share": F.col("_sse") / F.sum("_sse").over(whole)})
    return g.withColumn("skew", F.col("error_share") / F.col("row_share")).drop("_sse")


def top_skew(breakdown: DataFrame, k: int, tie: str) -> DataFrame:
    return breakdown.orderBy(F.col("skew").desc(), tie).limit(k)


def name_inventory(df: DataFrame, key: str, name: str) -> DataFrame:
    """Ids seen under several names."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(name)).alias("names")).where(F.size("names") > 1)


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(a).pivot(b, list(values)).agg(F.count(F.lit(1))).fillna(0)


def missing_cells(df: DataFrame, keys: Sequence[str], slot: str) -> DataFrame:
    """Cells of keys x slots that have no row."""
    grid = df.select(*keys).distinct().crossJoin(df.select(slot).distinct())
    return grid.join(df.select(*keys, slot), [*keys, slot], "left_anti")


def static_profile(df: DataFrame, key: str, slot: str, value: str, slots: Sequence[int]) -> DataFrame:
    """Mean of the value by slot as columns."""
    return df.groupBy(key).pivot(slot, list(slots)).agg(F.avg(value)).withColumnsRenamed({str(s): f"slot_{s}" for s in slots})


def yoy_change(df: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Change to the year before; null after a gap or a zero."""
    sums = df.groupBy(*keys, year).agg(F.sum(value).alias("total"))
    w = Window.partitionBy(*keys).orderBy(year)
    before = F.when(F.lag(year).over(w) == F.col(year) - 1, F.lag("total").over(w))
    return sums.withColumn("change", (F.col("total") - before) / F.nullif(before, F.lit(0.0)))


def inventory_distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), F.median(value).alias("median"), F.avg((F.col(value) == 0).cast("int")).alias("p_zero"), F.avg((F.col(value) <= 2).cast("int")).alias("p_two"))


def heatmap(df: DataFrame, row: Column, column: Column, value: str, columns: Sequence[int], prefix: str = "h") -> DataFrame:
    return df.withColumns({"_row": row, "_column": column}).groupBy(F.col("_row").alias("dow")).pivot("_column", list(columns)).agg(F.avg(value)).withColumnsRenamed({str(c): f"{prefix}{c}" for c in columns})


def binned(df: DataFrame, bins: Column, value: str) -> DataFrame:
    """Mean, exact median and rows of each bin; a bin may hold most rows."""
    of = df.select(bins.alias("bin"), F.col(value).alias("_v"))
    medians = exact_quantiles(of, ["bin"], "_v", [0.5]).select(F.col("bin").alias("_bin"), F.col("q")[0].alias("median"))
    means = of.groupBy("bin").agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    return means.join(medians, F.col("bin").eqNullSafe(F.col("_bin"))).select("bin", "mean", "median", "n")


def decile_bins(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """Means of y by quantile bins of x, with exact edges."""
    edges = exact_quantiles(df, [], x, [i / bins for i in range(1, bins)], "_e")
    b = F.size(F.filter("_e", lambda e: F.col(x) > e))
    return df.crossJoin(F.broadcast(edges)).groupBy(b.alias("bin")).agg(F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"), F.count(F.lit(1)).alias("n"))


def average_rank(df: DataFrame, value: str, name: str, ranges: int = 200) -> DataFrame:
    """Ranks from 1, equal values sharing the mean of theirs.

    Values are counted first and dealt to ``ranges`` ranges cut at approximate quantiles; each range is ordered by itself
    and starts at the count of the ranges below it, so no task orders all values. Only a row a range is gathered."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    cuts = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10_000).alias("_cuts"))
    dealt = counts.crossJoin(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = dealt.groupBy("_range").agg(F.sum("_n").alias("_t"))
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    below = F.col("_start") + F.coalesce(F.sum("_n").over(inside), F.lit(0))
    ranks = dealt.join(F.broadcast(starts), "_range").select(value, (below + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, value)


def pearson_spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    ranked = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, "_rx"), y, "_ry")
    return ranked.agg(F.corr(x, y).alias("pearson"), F.corr("_rx", "_ry").alias("spearman"), F.count(F.lit(1)).alias("n"))


def dispersion(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartile distance over the median."""
    g = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    return g.select(*keys, F.col("_q")[1].alias("median"), ((F.col("_q")[2] - F.col("_q")[0]) / F.nullif(F.col("_q")[1], F.lit(0.0))).alias("dispersion"))


def median_deviation(df: DataFrame, line: str, station: str, value: str) -> DataFrame:
    """How far a station's median is from its line's."""
    s = df.groupBy(line, station).agg(F.median(value).alias("station_median"))
    l = df.groupBy(line).agg(F.median(value).alias("line_median"))
    return s.join(l, line).withColumn("deviation", F.col("station_median") - F.col("line_median"))


def scale_table(df: DataFrame, keys: Sequence[str], value: str, floor: float = 1.0) -> DataFrame:
    return df.groupBy(*keys).agg(F.greatest(F.coalesce(F.stddev_pop(value), F.lit(floor)), F.lit(floor)).alias("scale"))


def discontinuity(df: DataFrame, line: str, station: str, date: str, value: str, first: int, second: int, limit: float = 0.25) -> DataFrame:
    """Stations whose yearly totals change by more than ``limit`` or miss a year, and the class of their line."""
    year = lambda y: F.sum(F.when(F.year(date) == y, F.col(value)))
    t = df.groupBy(line, station).agg(year(first).alias("before"), year(second).alias("after"))
    broken = F.coalesce(F.abs(F.col("after") / F.nullif(F.col("before"), F.lit(0.0)) - 1) > limit, F.lit(True))
    t = t.withColumn("broken", broken)
    w = Window.partitionBy(line)
    every, some = F.min("broken").over(w), F.max("broken").over(w)
    return t.withColumn("line_class", F.when(every, "all").when(some, "some").otherwise("none"))


def ratio_change(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, limit: float = 0.05) -> DataFrame:
    """Relative moves between two tables: median, 90th percentile, largest, share over ``limit``."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), list(keys))
    move = F.abs(F.col("_b") - F.col("_a")) / F.nullif(F.abs("_a"), F.lit(0.0))
    moves = j.select(move.alias("_m"))
    one = moves.agg(F.max("_m").alias("largest"), F.avg((F.col("_m") > limit).cast("int")).alias("share_over"), F.count("_m").alias("n"))
    return one.join(F.broadcast(exact_quantiles(moves, [], "_m", [0.5, 0.9], "_q"))).select(F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p90"), "largest", "share_over", "n")


def day_type_gap(df: DataFrame, keys: Sequence[str], kind: str, value: str, a: int, b: int) -> DataFrame:
    """Correlation and mean distance of the profiles of two day types over the keys that both have."""
    wide = df.groupBy(*keys).pivot(kind, [a, b]).agg(F.avg(value)).withColumnsRenamed({str(a): "_a", str(b): "_b"}).where("_a IS NOT NULL AND _b IS NOT NULL")
    return wide.agg(F.corr("_a", "_b").alias("corr"), F.avg(F.abs(F.col("_a") - F.col("_b"))).alias("gap"), F.count(F.lit(1)).alias("n"))


def outlier_flags(df: DataFrame, station: str, value: str, share: float = 0.9) -> DataFrame:
    """Stations whose deviation, or share of zeros, is at or above that percentile of all stations."""
    s = df.groupBy(station).agg(F.stddev(value).alias("sd"), F.avg((F.col(value) <= 20).cast("int")).alias("low_rate"))
    for c in ("sd", "low_rate"):
        s = s.crossJoin(F.broadcast(exact_quantiles(s, [], c, [share], f"_{c}")))
    return s.select(station, "sd", "low_rate", (F.col("sd") >= F.col("_sd")[0]).alias("sd_high"), (F.col("low_rate") >= F.col("_low_rate")[0]).alias("low_high"))


def zscore(df: DataFrame, station: str, date: str, values: Sequence[str]) -> DataFrame:
    """Columns scaled over distinct (station, date); a zero deviation counts as 1."""
    once = df.select(station, date, *values).distinct()
    stats = once.agg(*[x for v in values for x in (F.avg(v).alias(f"_m_{v}"), F.stddev_pop(v).alias(f"_s_{v}"))])
    return once.crossJoin(F.broadcast(stats)).select(station, date, *[((F.col(v) - F.col(f"_m_{v}")) / F.coalesce(F.nullif(F.col(f"_s_{v}"), F.lit(0.0)), F.lit(1.0))).alias(v) for v in values])


def mask_lags(df: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """Null for every column whose name begins so."""
    return df.select(*[F.lit(None).cast(t).alias(c) if c.startswith(tuple(prefixes)) else F.col(c) for c, t in df.dtypes])


def mask_by_date(df: DataFrame, scenarios: DataFrame, rules: dict[str, Sequence[str]], date: str = "date", stack: bool = False) -> DataFrame:
    """Each date's rows masked by its scenario (a name in ``rules``); a date without one, or an unknown scenario, stops the
    job. ``stack`` puts the masked rows behind the whole ones, else they take their place."""
    s = scenarios.select(date, F.col("scenario").alias("_scenario"))
    joined = df.join(s, date, "left")
    checked = joined.withColumn("_scenario", F.when(F.col("_scenario").isin(*rules), F.col("_scenario")).otherwise(F.raise_error(F.lit("a date has no known scenario"))))
    out = []
    for c, t in df.dtypes:
        hit = [n for n, prefixes in rules.items() if c.startswith(tuple(prefixes)) and prefixes]
        out.append(F.when(F.col("_scenario").isin(*hit), F.lit(None).cast(t)).otherwise(F.col(c)).alias(c) if hit else F.col(c))
    masked = checked.select(*out, F.col("_scenario").alias("scenario"))
    return df.withColumn("scenario", F.lit("none")).unionByName(masked) if stack else masked


def year_weight(date: Column, weights: dict[int, float]) -> Column:
    """A weight by year, 1 for years without."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.year(date)), F.lit(1.0))


def feature_matrix(df: DataFrame, columns: Sequence[str], realtime: Sequence[str] = ()) -> DataFrame:
    """Named columns in order; an absent realtime column is null, any other absent one an error."""
    missing = [c for c in columns if c not in df.columns and c not in realtime]
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("double").alias(c) for c in columns])


def route_by_availability(df: DataFrame, observed: DataFrame, station: str, date: str, parts: int | None = None) -> DataFrame:
    """The predictor for each row by which of the days 1 and 7 before are observed: full, d1_only, d7_only or no_lag.
    ``parts`` is the number of tasks that rows meet the days in, where the session's is not to be."""
    o = observed.select(station, date).distinct()
    moved = o.select(station, F.explode(F.array(F.lit(1), F.lit(7))).alias("_n"), date).withColumn(date, F.date_add(date, F.col("_n")))
    have = moved.groupBy(station, date).agg(F.max((F.col("_n") == 1).cast("int")).alias("_d1"), F.max((F.col("_n") == 7).cast("int")).alias("_d7"))
    df, have = (dealt(x, parts, [station, date]) for x in (df, have))
    return df.join(have, [station, date], "left").withColumn("route", F.when((F.col("_d1") == 1) & (F.col("_d7") == 1), "full").when(F.col("_d1") == 1, "d1_only").when(F.col("_d7") == 1, "d7_only").otherwise("no_lag")).drop("_d1", "_d7")


def most_specific(df: DataFrame, rules: DataFrame, keys: Sequence[str], row: str) -> DataFrame:
    """The rule that fits a row (a null key of a rule fits anything) and names most keys; ties go to the rule's name.

    A row meets the rules by equality, once for each set of keys that a rule may name: 2^n narrow copies for n keys, and
    no row is held against rules that do not fit it."""
    named = sum((F.when(F.col(f"_{k}").isNotNull(), 1 << i).otherwise(0) for i, k in enumerate(keys)), F.lit(0))
    r = rules.withColumnsRenamed({k: f"_{k}" for k in keys}).withColumn("_set", named)
    sets = F.explode(F.array(*[F.lit(m) for m in range(1 << len(keys))])).alias("_s")
    each = df.select(row, *keys, sets).select(row, "_s", *[F.when(F.col("_s").bitwiseAND(1 << i) > 0, F.col(k)).alias(k) for i, k in enumerate(keys)])
    fits = F.col("_s") == F.col("_set")
    for k in keys:
        fits &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    best = each.join(r, fits).groupBy(row).agg(F.max_by("rule", F.struct(F.bit_count("_set"), "rule")).alias("rule"))
    return df.join(best, row, "left")


def drop_conflicts(df: DataFrame, group: Sequence[str], slot: str) -> DataFrame:
    """Without the groups in which a slot stands twice."""
    bad = df.groupBy(*group, slot).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*group).distinct()
    return df.join(bad, list(group), "left_anti")


def transfer_map(stations: DataFrame, station: str = "station_no", name: str = "name") -> DataFrame:
    """Stations of the same name under other ids."""
    a, b = stations.select(station, F.col(name).alias("_n")), stations.select(F.col(station).alias("other"), F.col(name).alias("_n"))
    return a.join(b, "_n").where(F.col(station) != F.col("other")).drop("_n")


def segment_neighbors(topology: DataFrame, line: str = "line") -> DataFrame:
    """Neighbours on a line from ``stations`` (an array in order) and ``circular``: (line, station_no, other)."""
    pairs = topology.select(line, F.posexplode("stations").alias("_i", "station_no"), "stations", "circular")
    n = F.size("stations")
    at = lambda i: F.get(F.col("stations"), i)
    ring = F.col("circular") & (n > 2)
    before = F.when(F.col("_i") > 0, at(F.col("_i") - 1)).when(ring, at(n - 1))
    after = F.when(F.col("_i") < n - 1, at(F.col("_i") + 1)).when(ring, at(F.lit(0)))
    return pairs.select(line, "station_no", F.explode(F.array(before, after)).alias("other")).where("other IS NOT NULL AND other <> station_no").distinct()


def neighbor_features(df: DataFrame, neighbors: DataFrame, values: Sequence[str], keys: Sequence[str] = ("date", "slot"), station: str = "station_no", parts: int | None = None) -> DataFrame:
    """Mean of the neighbours' values at the same date and slot. ``parts`` is the number of tasks that rows meet their means
    in, where the session's is not to be."""
    other = df.select(F.col(station).alias("other"), *keys, *values)
    near = dealt(neighbors.select(station, "other").distinct().join(dealt(other, parts, ["other"]), "other"), parts, [station, *keys])
    mean = near.groupBy(station, *keys).agg(*[F.avg(v).alias(f"{v}_near") for v in values])
    return dealt(df, parts, [station, *keys]).join(mean, [station, *keys], "left")


def target_skeleton(stations: DataFrame, slots: DataFrame, date: Column) -> DataFrame:
    """Every station and slot of one date: two dimensions, crossed."""
    return stations.crossJoin(F.broadcast(slots)).withColumn("date", date)


def attach_population(df: DataFrame, areas: DataFrame, population: DataFrame, station: str = "station_no") -> DataFrame:
    return df.join(areas, station, "left").join(population, ["area", "date", "hour"], "left")


def attach_events(df: DataFrame, events: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Left join; missing counts are 0, other missing values stay."""
    return df.join(events, list(keys), "left").fillna(0, list(counts))


def extend_with_recent(panel: DataFrame, recent: DataFrame, station: str = "station_no", date: str = "date") -> DataFrame:
    """The panel and the recent rows after its last date, of stations that it knows."""
    last = panel.agg(F.max(date).alias("_last"))
    known = panel.select(station).distinct()
    new = recent.crossJoin(F.broadcast(last)).where(F.col(date) > F.col("_last")).drop("_last").join(known, station, "left_semi")
    return panel.unionByName(new, allowMissingColumns=True)


def code_then_name(df: DataFrame, master: DataFrame, code: str, line: str, name: str) -> DataFrame:
    """The master's station by code, else by line and name (the lowest of several); null without a match."""
    by_code = master.groupBy(F.col("code").alias(code)).agg(F.min("station_no").alias("_c"))
    by_name = master.groupBy(F.col("line").alias(line), F.col("name").alias(name)).agg(F.min("station_no").alias("_n"))
    return df.join(by_code, code, "left").join(by_name, [line, name], "left").withColumn("station_no", F.coalesce("_c", "_n")).drop("_c", "_n")


def unmatched_inventory(matched: DataFrame, line: str, name: str) -> DataFrame:
    """The (line, name) pairs that ``code_then_name`` found no station for, with their rows."""
    return matched.where("station_no IS NULL").groupBy(line, name).agg(F.count(F.lit(1)).alias("rows"))


def holiday_similarity(df: DataFrame, keys: Sequence[str], kind: str, value: str, holiday: str, others: Sequence[str]) -> DataFrame:
    """Which other day type the profile of ``holiday`` is nearest to: for each of ``others`` the correlation and the mean
    distance of the two mean profiles over the keys that both have, and whether it is the nearest (lowest distance, ties by
    name). One grouping by key and day type, then one over the pairs of columns."""
    wide = df.groupBy(*keys).pivot(kind, [holiday, *others]).agg(F.avg(value))
    at = lambda n: F.col(f"`{n}`")
    laid = wide.select(at(holiday).alias("_h"), F.explode(F.array(*[F.struct(F.lit(o).alias("day_type"), at(o).alias("v")) for o in others])).alias("_o"))
    rows = laid.select("_h", "_o.day_type", "_o.v").where("_h IS NOT NULL AND v IS NOT NULL")
    found = rows.groupBy("day_type").agg(F.corr("_h", "v").alias("corr"), F.avg(F.abs(F.col("_h") - F.col("v"))).alias("gap"), F.count(F.lit(1)).alias("n"))
    best = found.agg(F.min(F.struct("gap", "day_type")).alias("_b"))
    return found.crossJoin(F.broadcast(best)).select("day_type", "corr", "gap", "n", (F.col("day_type") == F.col("_b.day_type")).alias("nearest"))
