"""Bike stock: cleaning of snapshots, profiles with fallbacks, as-of joins and net flow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.scratch import cut

from tramline.functions import timefn as T

VALUES = ("exp_bikes", "p_empty", "p_full")


def normalize_stock(raw: DataFrame, names: Mapping[str, str], stock: str = "stock", racks: str = "racks", at: str = "collected_at") -> DataFrame:
    """Renames, casts to numbers (null if none), a ratio that is null without racks, and the parts of the time."""
    out = raw.withColumnsRenamed(dict(names))
    number = lambda c: F.col(c).cast("string").try_cast("double")
    out = out.withColumns({stock: number(stock).cast("int"), racks: number(racks)})
    return out.withColumns({
        "ratio": F.col(stock) / F.when(F.col(racks) > 0, F.col(racks)),
        "date": F.col(at).cast("date"), "hour": F.hour(at), "minute": F.minute(at),
    })


def valid_stock(df: DataFrame, day: Column | None = None, entity: str = "station_id", at: str = "collected_at", stock: str = "stock", racks: str = "racks") -> DataFrame:
    """Rows with an id, a time, a stock of 0 or more and racks; on one local day if one is given."""
    ok = F.col(entity).isNotNull() & F.col(at).isNotNull() & (F.col(stock) >= 0) & (F.col(racks) > 0)
    return df.where(ok if day is None else ok & (F.col(at).cast("date") == day))


def one_horizon(df: DataFrame, horizon: str, value: int, anchor: str) -> DataFrame:
    return df.where((F.col(horizon) == value) & F.col(anchor).isNotNull())


def dedup_slot(df: DataFrame, entity: str, at: str, tie: str) -> DataFrame:
    """The last row of each entity and 5-minute slot; equal times go to the highest ``tie``."""
    w = Window.partitionBy(entity, F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / 300)).orderBy(F.col(at).desc(), F.col(tie).desc())
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_by_key(df: DataFrame, entity: str, at: str, tie: str, ttl: str = "30 minutes") -> DataFrame:
    """The newest row of each entity, if it is at most ``ttl`` behind the newest of all."""
    w = Window.partitionBy(entity).orderBy(F.col(at).desc(), F.col(tie).desc())
    newest = df.agg(F.max(at).alias("_newest"))
    rows = df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return rows.crossJoin(F.broadcast(newest)).where(F.col(at) >= F.col("_newest") - F.expr(f"INTERVAL {ttl}")).drop("_newest")


def latest_issue(df: DataFrame, series: Sequence[str], issued: str, valid: str, tie: str) -> DataFrame:
    """All horizons of each series' newest issue, and of each horizon the newest row."""
    newest = Window.partitionBy(*series)
    w = Window.partitionBy(*series, valid).orderBy(F.col(tie).desc())
    rows = df.withColumn("_m", F.max(issued).over(newest)).where(F.col(issued) == F.col("_m")).drop("_m")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def stock_profile(df: DataFrame, entity: str = "station_id", stock: str = "stock", racks: str = "racks", keys: Sequence[str] = ("dow_type", "time_slot")) -> DataFrame:
    """Mean stock and the shares of empty and full rows of each station and slot. One shuffle, with partial sums."""
    return df.where(F.col(stock).isNotNull()).groupBy(entity, *keys).agg(
        F.avg(stock).alias("exp_bikes"), F.avg((F.col(stock) <= 0).cast("int")).alias("p_empty"), F.avg((F.col(stock) >= F.col(racks)).cast("int")).alias("p_full"), F.count(stock).alias("n")
    )


def realtime_profile(df: DataFrame, entity: str, at: str, stock: str, racks: str, tie: str) -> DataFrame:
    """After the slot dedup: mean, sample deviation, mean ratio and count by station, weekday (0 Monday) and hour."""
    rows = dedup_slot(df, entity, at, tie)
    return rows.groupBy(entity, T.mon0_dow(F.col(at)).alias("dow"), F.hour(at).alias("hour")).agg(
        F.avg(stock).alias("mean_stock"), F.stddev(stock).alias("sd_stock"), F.avg(F.col(stock) / F.nullif(F.col(racks), F.lit(0.0))).alias("mean_ratio"), F.count(F.lit(1)).alias("n")
    )


def daily_partial(df: DataFrame, entity: str, day: str, slot: str, stock: str, racks: str) -> DataFrame:
    """Sums and counts of a day that can be added over any window of days."""
    return df.groupBy(entity, day, slot).agg(
        F.sum(stock).alias("stock_sum"), F.count(stock).alias("n"), F.sum((F.col(stock) <= 0).cast("int")).alias("empty_sum"), F.sum((F.col(stock) >= F.col(racks)).cast("int")).alias("full_sum")
    )


def window_profile(partials: DataFrame, entity: str, day: str, slot: str, last: Column, days: int = 28) -> DataFrame:
    """A profile from the daily partials of the ``days`` days up to ``last``."""
    rows = partials.where(F.col(day).between(F.date_sub(last, days - 1), last))
    n = F.sum("n")
    return rows.groupBy(entity, slot).agg((F.sum("stock_sum") / n).alias("exp_bikes"), (F.sum("empty_sum") / n).alias("p_empty"), (F.sum("full_sum") / n).alias("p_full"), n.alias("n"))


def blend_profile(prior: DataFrame, recent: DataFrame, keys: Sequence[str], weight: float = 48.0, least: int = 6, values: Sequence[str] = VALUES) -> DataFrame:
    """Prior and recent means joined: blended (weight x prior + n x recent) / (weight + n) where n >= ``least``; else the
    prior; a cell without a prior takes the recent mean."""
    r = recent.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.col("n").alias("_n"))
    both = prior.select(*keys, *values).join(r, list(keys), "full_outer")
    out = {
        v: F.when(F.col(v).isNull(), F.col(f"_{v}")).when(F.col("_n") >= least, (F.col(v) * weight + F.col(f"_{v}") * F.col("_n")) / (weight + F.col("_n"))).otherwise(F.col(v))
        for v in values
    }
    return both.select(*keys, *[c.alias(v) for v, c in out.items()])


def complete_grid(profile: DataFrame, entity: str = "station_id", day: str = "dow_type", slot: str = "time_slot", days: int = 3, slots: int = 48, values: Sequence[str] = VALUES) -> DataFrame:
    """Every station x day type x slot: the observed row, else the station's mean at that slot, else its mean; a row is
    filled as a whole, and ``source`` says from where."""
    seen = profile.select(entity, day, slot, *values)
    grid = seen.select(entity).distinct().withColumn(day, F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).withColumn(slot, F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    at_slot = seen.groupBy(entity, slot).agg(*[F.avg(v).alias(f"_s_{v}") for v in values])
    overall = seen.groupBy(entity).agg(*[F.avg(v).alias(f"_g_{v}") for v in values])
    out = grid.join(seen, [entity, day, slot], "left").join(at_slot, [entity, slot], "left").join(overall, entity, "left")
    whole = lambda p: F.coalesce(*[F.lit(None)], F.lit(True)) & _all_present([f"{p}{v}" for v in values])
    source = F.when(whole(""), "observed").when(whole("_s_"), "station_slot").when(whole("_g_"), "station")
    filled = [F.when(source == "observed", F.col(v)).when(source == "station_slot", F.col(f"_s_{v}")).when(source == "station", F.col(f"_g_{v}")).alias(v) for v in values]
    return out.select(entity, day, slot, *filled, source.alias("source"))


def _all_present(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def attach_holidays(df: DataFrame, holidays: DataFrame, date: str = "date") -> DataFrame:
    """A flag from a calendar; days that it does not name are none. The calendar is small; Spark broadcasts it by size."""
    return df.join(holidays.select(F.col("date").alias(date), "is_holiday").distinct(), date, "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False)))


def profile_with_fallback(df: DataFrame, profile: DataFrame, grains: Sequence[Sequence[str]], value: str) -> DataFrame:
    """``value`` of the finest grain that has one, and its level (0 finest).

    ``profile`` is a grouping-sets table: key columns of coarser grains are null and ``grain`` tells which grain it is."""
    out = df
    for i, keys in enumerate(grains):
        part = profile.where(F.col("grain") == i).select(*keys, F.col(value).alias(f"_{i}"))
        out = out.join(part, list(keys), "left") if keys else out.crossJoin(F.broadcast(part))
    found = [F.col(f"_{i}") for i in range(len(grains))]
    level = F.lit(None).cast("int")
    for i in reversed(range(len(grains))):
        level = F.when(found[i].isNotNull(), i).otherwise(level)
    return out.withColumn(value, F.coalesce(*found)).withColumn("level", level).drop(*[f"_{i}" for i in range(len(grains))])


def grain_profile(df: DataFrame, grains: Sequence[Sequence[str]], aggregates: Sequence[Column]) -> DataFrame:
    """One pass over the data for all grains (grouping sets); ``grain`` is the place in the list."""
    keys = list(dict.fromkeys(k for g in grains for k in g))
    # bit of grouping_id is 1 for a key that is not part of the grain
    number = {sum(0 if k in g else 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)): n for n, g in enumerate(grains)}
    grain = F.lit(None).cast("int")
    for code, n in number.items():
        grain = F.when(F.col("_gid") == code, n).otherwise(grain)
    sets = [[F.col(k) for k in g] for g in grains]
    return df.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.grouping_id().alias("_gid"), *aggregates).withColumn("grain", grain).drop("_gid")


def historical_profile(df: DataFrame, station: str = "station_id", horizon: str = "horizon", keys: Sequence[str] = ("dow_type", "time_slot")) -> DataFrame:
    """Mean and deviation of net flow, mean rents and returns, at (station, horizon, keys), (station, horizon) and over all."""
    return grain_profile(df, [[station, horizon, *keys], [station, horizon], []], [F.avg("net_flow").alias("mean_flow"), F.stddev("net_flow").alias("sd_flow"), F.avg("rent").alias("mean_rent"), F.avg("ret").alias("mean_return"), F.count(F.lit(1)).alias("n")])


def target_profile(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and deviation by keys; a cell of one row takes the deviation of all."""
    whole = df.agg(F.avg(value).alias("_mean"), F.stddev(value).alias("_sd"))
    cells = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev(value).alias("sd"))
    return cells.crossJoin(F.broadcast(whole)).select(*keys, F.coalesce("mean", "_mean").alias("mean"), F.coalesce("sd", "_sd").alias("sd"))


def lag_lookup(df: DataFrame, entity: str, date: str, slot: str, value: str, last: Column, days: int = 8) -> DataFrame:
    """Mean by station, date and slot of the last ``days`` days."""
    return df.where(F.col(date).between(F.date_sub(last, days - 1), last)).groupBy(entity, date, slot).agg(F.avg(value).alias("mean"))


def mode_rack_count(df: DataFrame, entity: str, racks: str) -> DataFrame:
    """The most frequent rack count of a station; the smallest of equals."""
    counts = df.where(F.col(racks).isNotNull()).groupBy(entity, racks).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(entity).agg(F.min_by(racks, F.struct(-F.col("_n"), F.col(racks))).alias(racks))


def asof_backward(left: DataFrame, right: DataFrame, by: str, on: str, values: Sequence[str], tie: str, bucket: int = 86400) -> DataFrame:
    """Each left row with the last right row at or before it, and the minutes since. A right row comes before a left one
    of equal time, ``tie`` orders right rows of equal time.

    Rows of both sides are ordered in one window of key and time bucket (``bucket`` seconds), so a key with a share of all
    rows is many tasks. What the buckets before have last is carried by a second window, over one row a bucket."""
    l = left.withColumns({"_side": F.lit(1), "_right": F.lit(None).cast(_struct_type(right, [on, *values]))})
    r = right.select(F.col(by), F.col(on), F.lit(0).alias("_side"), F.struct(on, *values).alias("_right"), F.col(tie).alias("_tie"))
    both = l.withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType)).unionByName(r, allowMissingColumns=True)
    instant = lambda c: F.unix_timestamp(c.cast("timestamp"))
    both = both.withColumn("_bucket", F.floor(instant(F.col(on)) / bucket))
    w = Window.partitionBy(by, "_bucket").orderBy(on, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    buckets = both.groupBy(by, "_bucket").agg(F.max_by("_right", F.when(F.col("_side") == 0, F.struct(on, "_tie"))).alias("_newest"))
    earlier = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(F.col(by).alias("_by"), F.col("_bucket").alias("_at"), F.last("_newest", ignorenulls=True).over(earlier).alias("_before"))
    out = inside.join(carried, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_at")), "left").withColumn("_last", F.coalesce("_last", "_before"))
    seconds = instant(F.col(on)) - instant(F.col("_last")[on])
    return out.select(*left.columns, *[F.col("_last")[v].alias(f"anchor_{v}") for v in values], (seconds / 60).alias("minutes_since"))


def _struct_type(df: DataFrame, names: Sequence[str]):
    return df.select(F.struct(*names).alias("s")).schema["s"].dataType


def net_flow(rent: DataFrame, ret: DataFrame, keys: Sequence[str], stock_change: bool = True) -> DataFrame:
    """Rents and returns by key, 0 where one side has none, and returns - rents (or the reverse)."""
    a = rent.groupBy(*keys).agg(F.sum("cnt").alias("rent"))
    b = ret.groupBy(*keys).agg(F.sum("cnt").alias("ret"))
    out = a.join(b, list(keys), "full_outer").fillna(0, ["rent", "ret"])
    flow = F.col("ret") - F.col("rent")
    return out.withColumn("net_flow", flow if stock_change else -flow)


def haloed(df: DataFrame, bucket: Column, again: Column) -> DataFrame:
    """``df`` with its bucket as ``_b``, and copies (``_halo``) of each row in the buckets of the array ``again``."""
    place = F.concat(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("halo"))), F.transform(again, lambda b: F.struct(b.alias("b"), F.lit(True).alias("halo"))))
    return df.withColumn("_at", F.explode(place)).withColumns({"_b": F.col("_at.b"), "_halo": F.col("_at.halo")}).drop("_at")


def forward_sum(df: DataFrame, entity: str, at: str, values: Sequence[str], minutes: int, frame: str = "time", step: int = 5, wide: int = 4, rows: int = 4096) -> DataFrame:
    """Sums of what follows within ``minutes`` (frame "time": later than now, up to then), or of rows -(steps - 2) to +1
    as a shifted rolling window over rows has them (frame "rows_compat").

    An entity is no single window. By time it is cut into buckets of ``wide`` times the minutes, and the first ``minutes`` of
    each bucket are copied into the one before, where they count but give no row; so 1 in ``wide`` rows is sent twice.
    By rows it is cut into runs of ``rows`` rows, by places that are counted by day first, with the neighbours of each run
    copied into it. Rows without a time are of one bucket: by time they count for each other, as in a plain window."""
    if frame == "time":
        sec, span = F.unix_timestamp(F.col(at).cast("timestamp")), minutes * 60
        width = wide * span
        bucket = F.floor(F.col("_sec") / width)
        early = F.pmod(F.col("_sec"), F.lit(width)) <= span
        cut = haloed(df.withColumn("_sec", sec), bucket, F.when(early, F.array(bucket - 1)).otherwise(F.array().cast("array<bigint>")))
        w = Window.partitionBy(entity, "_b").orderBy("_sec").rangeBetween(1, span)
    else:
        before, after = minutes // step - 2, 1
        placed = place_of(df, entity, at)
        first, last = F.floor((F.col("_place") - after) / rows), F.floor((F.col("_place") + max(before, 0)) / rows)
        bucket = F.floor(F.col("_place") / rows)
        cut = haloed(placed, bucket, F.filter(F.sequence(first, last), lambda b: b != bucket))
        w = Window.partitionBy(entity, "_b").orderBy("_place").rowsBetween(-before, after)
    out = cut.withColumns({f"{v}_next_{minutes}": F.coalesce(F.sum(v).over(w), F.lit(0)) for v in values}).where("not _halo")
    return out.drop("_b", "_halo", "_sec", "_place")


def place_of(df: DataFrame, entity: str, at: str) -> DataFrame:
    """The place of each row in its entity by time, from 0, as ``_place``: ordered inside days, behind the counts of the days before."""
    day = df.withColumn("_day", F.to_date(at))
    counts = day.groupBy(F.col(entity).alias("_e"), F.col("_day").alias("_d")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_e").orderBy(F.col("_d").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(entity, "_day").orderBy(at)) - 1
    joined = day.withColumn("_i", inside).join(counts, F.col(entity).eqNullSafe(F.col("_e")) & F.col("_day").eqNullSafe(F.col("_d")))
    return joined.withColumn("_place", F.col("_before") + F.col("_i")).drop("_day", "_e", "_d", "_before", "_i")


def stock_labels(df: DataFrame, anchor: str, flow: str, racks: str) -> DataFrame:
    """Future stock = anchor + net flow, its ratio to the racks, and whether that is empty or full."""
    future = F.col(anchor) + F.col(flow)
    return df.withColumns({"future_stock": future, "future_ratio": future / F.nullif(F.col(racks), F.lit(0.0)), "is_empty": future <= 0, "is_full": future >= F.col(racks)})


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], update_only: bool = False) -> DataFrame:
    """``old`` with the rows of ``new`` put in by key. ``update_only`` changes rows but adds none. Keys are unique in each."""
    if update_only:
        values = [c for c in old.columns if c not in keys]
        n = new.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in values])
        return old.join(n, list(keys), "left").select(*keys, *[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values])
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def replace_dates(existing: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    """Days that ``new`` has are replaced, the others kept."""
    return existing.join(new.select(date).distinct(), date, "left_anti").unionByName(new)


def dedup_union(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """All tables together; of equal keys the row of the last table."""
    out = tables[0].withColumn("_t", F.lit(0))
    for i, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("_t", F.lit(i)))
    w = Window.partitionBy(*keys).orderBy(F.col("_t").desc())
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_t")


def amplify(df: DataFrame, copies: int, date: str, years: int = 4) -> DataFrame:
    """The table ``copies`` times, each copy ``years`` years later than the one before."""
    n = df.sparkSession.range(copies).select(F.col("id").cast("int").alias("copy"))
    return df.crossJoin(F.broadcast(n)).withColumn(date, F.add_months(date, F.col("copy") * 12 * years))


def station_index(df: DataFrame, entity: str) -> DataFrame:
    """Sorted distinct codes with dense numbers from 0.

    Codes are dealt to ranges and sorted there; their order is written down by a reliable checkpoint before it is read, so
    numbers hang neither on how ranges are cut nor on a second evaluation of them, and a lost executor changes none. A
    code's number is its place in its range behind the counts of the ranges before it: only a row a range passes one window."""
    codes = df.where(F.col(entity).isNotNull()).select(entity).distinct()
    placed = cut(codes.repartitionByRange(entity).sortWithinPartitions(entity).withColumn("_at", F.monotonically_increasing_id()))
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_p")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_p", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_add"))
    return placed.withColumn("_p", F.shiftright("_at", 33)).join(starts, "_p").select(entity, (F.col("_at") + F.col("_add")).cast("int").alias("code"))


def encode_station(df: DataFrame, index: DataFrame, entity: str) -> DataFrame:
    """The code of each row's station; a station outside the index stops the job."""
    out = df.join(index.withColumn("_known", F.lit(True)), entity, "left")
    return out.withColumn("code", F.when(F.col("_known"), F.col("code")).otherwise(F.raise_error(F.concat(F.lit("unknown station "), F.coalesce(F.col(entity).cast("string"), F.lit("null")))))).drop("_known")


def station_status(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Two station lists joined: in both, or only in one."""
    x, y = a.withColumn("_a", F.lit(True)), b.withColumn("_b", F.lit(True))
    status = F.when(F.col("_a") & F.col("_b"), "matched").when(F.col("_a"), "only_left").otherwise("only_right")
    return x.join(y, key, "full_outer").withColumn("status", status).drop("_a", "_b")
