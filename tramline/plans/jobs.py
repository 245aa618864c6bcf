"""Composite jobs: chains of the operators, each from tables to a table, written by executors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.functions import timefn as T
from tramline.functions.scalars import grade
from tramline.operators import crowding as C
from tramline.operators import events as E
from tramline.operators import panel as P
from tramline.operators import quality as Q
from tramline.operators import stock as S
from tramline.scratch import cut
from tramline.sources import io


def stock_refresh(rows: DataFrame, prior: DataFrame, last: Column, holidays: DataFrame | None = None, days: int = 28, weight: float = 48.0, least: int = 6) -> tuple[DataFrame, DataFrame]:
    """P1: snapshots -> valid rows -> last of each slot -> daily partials -> 28-day profile -> blend -> full grid, and the
    findings of the grid's check. ``rows`` has event_id, station_id, collected_at, stock, racks."""
    clean = S.dedup_slot(S.valid_stock(rows), "station_id", "collected_at", "event_id").withColumn("date", F.col("collected_at").cast("date"))
    if holidays is not None:
        clean = S.attach_holidays(clean, holidays)
    off = F.col("is_holiday") if holidays is not None else None
    slotted = clean.withColumns({"dow_type": T.dow_type(F.col("date"), off), "time_slot": T.slot_30m(F.col("collected_at"))})
    partials = slotted.groupBy("station_id", "date", "dow_type", "time_slot").agg(F.sum("stock").alias("stock_sum"), F.count("stock").alias("n"), F.sum((F.col("stock") <= 0).cast("int")).alias("empty_sum"), F.sum((F.col("stock") >= F.col("racks")).cast("int")).alias("full_sum"))
    recent = partials.where(F.col("date").between(F.date_sub(last, days - 1), last))
    n = F.sum("n")
    profile = recent.groupBy("station_id", "dow_type", "time_slot").agg((F.sum("stock_sum") / n).alias("exp_bikes"), (F.sum("empty_sum") / n).alias("p_empty"), (F.sum("full_sum") / n).alias("p_full"), n.alias("n"))
    grid = S.complete_grid(S.blend_profile(prior, profile, ["station_id", "dow_type", "time_slot"], weight, least))
    checks = Q.rule_violations(grid, {"stock": F.col("exp_bikes") >= 0, "p_empty": F.col("p_empty").between(0, 1), "p_full": F.col("p_full").between(0, 1)}, "station_id")
    return grid, checks


def realtime_profile(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """P2: raw snapshots -> normalised -> last of each slot -> profile by weekday and hour."""
    return S.realtime_profile(S.normalize_stock(rows, names), "station_id", "collected_at", "stock", "racks", "event_id")


def weather_features(env: DataFrame, categories: Sequence[str], ranges: Mapping[str, tuple[float, float]]) -> tuple[DataFrame, DataFrame]:
    """P3: weather envelopes -> one row for each valid time, and its check."""
    wide = io.weather_pivot(io.weather_payload(env), categories)
    return wide, Q.range_check(wide, dict(ranges), ["observed", "forecast"])


def match_stations(rentals: DataFrame, places: DataFrame, master: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rentals that name a rental place (``place_id``) by the master's station at its coordinates, and the places that match none with their rentals.

    The map of places is made once and met by ``place_id``, so rentals are not grouped by it."""
    found = E.coord_match(places.where("lat IS NOT NULL AND lon IS NOT NULL"), master, "place_id", "station_id")
    known = rentals.join(found, "place_id")
    return known, rentals.join(found, "place_id", "left_anti").groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))


def netflow_panel(rentals: DataFrame, anchors: DataFrame, horizons: Sequence[int] = (30, 60), places: DataFrame | None = None, master: DataFrame | None = None) -> DataFrame:
    """P4: rentals (station_id, ts, kind, cnt) -> net flow by 5 minutes -> last anchor stock before -> sums ahead.

    With ``places`` (place_id, lat, lon) and ``master`` (station_id, lat, lon) rentals name a place instead of a station, and those
    of places that are at no station's coordinates go (``match_stations`` lists them)."""
    if places is not None:
        rentals = match_stations(rentals, places, master)[0]
    r = rentals.withColumns({"slot_start": T.floor_5min(F.col("ts"))})
    flow = S.net_flow(r.where("kind = 'rent'"), r.where("kind = 'return'"), ["station_id", "slot_start"])
    out = S.asof_backward(flow, anchors.select("station_id", F.col("ts").cast("timestamp").alias("slot_start"), "stock", "tie"), "station_id", "slot_start", ["stock"], "tie")
    for h in horizons:
        out = S.forward_sum(out, "station_id", "slot_start", ["net_flow"], h)
    return out


def crowd_panel(long: DataFrame, holidays: DataFrame, weather: DataFrame, events: DataFrame, first_hour: int = 18) -> DataFrame:
    """P5: long ridership -> wide -> day type -> weather -> events."""
    wide = S.attach_holidays(P.pivot_direction(long, ["station_no", "date", "slot"]), holidays)
    typed = wide.withColumn("day_type", T.day_type(F.col("date"), F.col("is_holiday")))
    with_weather = P.attach_weather(typed, weather, F.col("slot") + first_hour)
    return P.attach_events(with_weather, events, ["date"], ["n_games"])


def features(panel: DataFrame, neighbors: DataFrame, value: str = "boarding", date: str = "date", parts: int | None = None) -> DataFrame:
    """P6: residual to the look-up, its lags by calendar (1 and 7 days, the slot before, the same day type), and the mean of
    the neighbours.

    The operators one after another would each join the panel with itself, and the plan would hold the panel 16 times. Here
    the look-up mean and the same-type lag are windows over one partitioning; then each row is laid out to every cell that
    reads it (its own, 1 and 7 days on, the next slot, its neighbours) and the cells are put together by one grouping, in
    ``parts`` tasks where the session's number is not to be theirs."""
    res = f"{value}_residual"
    w = Window.partitionBy("station_no", "slot", "dow_type")
    base = panel.withColumn(f"{value}_lookup", F.avg(value).over(w)).withColumn(res, F.col(value) - F.col(f"{value}_lookup"))
    base = P.same_day_type_lag(base, ["station_no", "slot", "dow_type"], res, date=date)
    near = neighbors.groupBy("other").agg(F.collect_set("station_no").alias("_near")).select(F.col("other").alias("station_no"), "_near")
    cell = lambda kind, station, slot, day: F.struct(F.lit(kind).alias("_c"), station.alias("station_no"), slot.alias("slot"), day.alias(date))
    st, sl, dy = F.col("station_no"), F.col("slot"), F.col(date)
    fixed = F.array(cell(0, st, sl, dy), cell(1, st, sl, F.date_add(dy, 1)), cell(2, st, sl, F.date_add(dy, 7)), cell(3, st, sl + 1, dy))
    around = F.transform(F.coalesce("_near", F.array().cast(near.schema["_near"].dataType)), lambda s: cell(4, s, sl, dy))
    others = [c for c in base.columns if c not in ("station_no", "slot", date)]
    laid = base.join(near, "station_no", "left").select(F.explode(F.concat(fixed, around)).alias("_at"), *others)
    laid = P.dealt(laid.select("_at.*", *others), parts, ["station_no", "slot", date])
    of = lambda kind, f, c=res: f(F.when(F.col("_c") == kind, F.col(c)))
    # a value each instead of a struct keeps the aggregation hashed
    cells = laid.groupBy("station_no", "slot", date).agg(
        F.min("_c").alias("_kind"), *[of(0, F.max, c).alias(c) for c in others],
        of(1, F.max).alias(f"{res}_lag1d"), of(2, F.max).alias(f"{res}_lag7d"), of(3, F.max).alias(f"{res}_prev"), of(4, F.avg).alias(f"{res}_near"),
    )
    return cells.where("_kind = 0").drop("_kind")


def crowding(pred: DataFrame, calibration: DataFrame, targets: DataFrame, thresholds: Sequence[float]) -> tuple[DataFrame, DataFrame]:
    """P7: predictions (line, seq, station_no, date, hour, boarding, alighting, lookup) -> no negatives -> loads -> calibrated half
    hours -> grade and status -> links, and the keys without one. Lines whose ``circular`` (a column, if there) is true are
    rings, on which people go the way of fewer stations. Grades are those of loads to 9 decimals: a load that is a threshold
    but for the last bits of its sums has the threshold's grade."""
    clean = C.clip_negative(pred, "boarding", "lookup").withColumn("boarding", F.coalesce("clipped", F.lit(0.0)))
    keys = ["line", "date", "hour"]
    if "circular" in pred.columns:
        ring = F.coalesce("circular", F.lit(False))
        loads = C.linear_loads(clean.where(~ring), keys).unionByName(C.ring_loads(clean.where(ring), keys))
    else:
        loads = C.linear_loads(clean, keys)
    ways = loads.select("line", "station_no", "date", "hour", "source", F.explode(F.create_map(F.lit("up"), "load_up", F.lit("down"), "load_down")).alias("direction", "raw"))
    cal = C.apply_calibration(ways, calibration, ["station_no", "direction"])
    graded = cal.withColumns({"grade": grade(F.round("calibrated", 9), thresholds), "status": C.data_status(F.col("source").isNull(), F.col("source") == "lookup", F.lit(False), F.col("ratio").isNull())})
    return C.to_link_table(graded, targets.select("station_no", "direction", "to_station"))


def one_link(timetable: DataFrame, links: DataFrame) -> DataFrame:
    """P8's first step: each stop of a timetable with the one segment that its train runs on, stops without one left out.

    A station may lie on several segments (``links``: station_no, segment). The segment fits if the stop before or after in the train's
    run lies on it as well; of several the one whose neighbours both do, else the first by name. So a stop stands once, and no
    load of it is counted for each segment."""
    runs = C.run_split(timetable, ["direction", "train_id"], "arr_min", "station_no")
    of = links.select("station_no", "segment").distinct()
    mine = runs.join(of, "station_no")
    near = lambda c: of.select(F.col("station_no").alias(c), "segment", F.lit(1).alias(f"_{c}"))
    fits = mine.join(near("prev_station"), ["prev_station", "segment"], "left").join(near("next_station"), ["next_station", "segment"], "left")
    score = F.coalesce("_prev_station", F.lit(0)) + F.coalesce("_next_station", F.lit(0))
    stop = ["station_no", "direction", "train_id", "arr_min"]
    best = C.resolve_links(fits.withColumns({"_fit": score > 0, "_score": score}), stop, "segment", "_fit", "_score")
    return best.select(*timetable.columns, "segment", "ambiguous")


def train_table(timetable: DataFrame, percent: DataFrame, adjacent: DataFrame, hourly: DataFrame, halves: DataFrame, capacity: float, links: DataFrame | None = None) -> DataFrame:
    """P8: timetable (station_no, direction, train_id, arr_min) -> trains of each half hour -> people on board of them all ->
    shares by headway -> load of each train; the station's hourly boardings -> half hours -> allocated over its trains of
    both directions by load; runs -> load that arrives with each train.

    ``percent`` has station_no, direction, slot30, percent (of ``capacity`` a train); ``hourly`` station_no, hour, boarding;
    ``halves`` station_no, slot30, share of the hour. With ``links`` (station_no, segment) each stop first gets its one segment
    (``one_link``), and trains, shares and loads are those of a station's segment, so ``percent`` has segment as well."""
    place = ["station_no", "direction"]
    if links is not None:
        timetable, place = one_link(timetable, links), [*place, "segment"]
    at = [*place, "slot30"]
    onboard = percent.join(C.trains_per_slot(timetable, place), at).withColumn("onboard", F.col("percent") / 100 * capacity * F.col("trains"))
    shares = C.headway_share(timetable, place)
    loaded = shares.join(onboard.select(*at, "onboard"), at).withColumn("load", F.col("onboard") * F.col("share"))
    flows = C.split_hourly(hourly, halves, ["station_no"], "hour", "boarding").select("station_no", "slot30", "boarding_30min")
    boarded = loaded.join(flows, ["station_no", "slot30"], "left")
    allocated = C.allocate_flows(boarded, ["station_no", "slot30"], "direction", "share", "load", "boarding_30min", by_load=True).withColumnRenamed("allocated", "boarding")
    runs = C.run_split(allocated, ["direction", "train_id"], "arr_min", "station_no")
    return C.node_states(runs, ["direction", "train_id", "run"], ["arr_min", "station_no"], adjacent)


def paired_games(games: DataFrame, crowds: DataFrame, most: int = 1) -> DataFrame:
    """Games with the attendance of another source, repeated meetings of a day paired in order, without the places' days of more
    than ``most`` games: ``games`` has id, date, place, a, b, ``crowds`` id, date, a, b, attendance, whoever stands first."""
    seen = E.sequence_join(games, crowds, "a", "b", "date", "id", ["attendance"])
    return E.drop_days(seen, ["date", "place"], most)


def event_panel(games: DataFrame, festivals: DataFrame, stations: DataFrame, venues: DataFrame, first: Column, last: Column, km: float = 1.0, crowds: DataFrame | None = None) -> DataFrame:
    """P9: games and festivals at places -> stations near them -> counts by station and date. With ``crowds`` games take
    their attendance from there, and days of several games at a place go (``paired_games``).

    Stations near the same places have the same counts, so events are counted by set of places and day, and only the counts
    go to the stations: an event is sent once to each set that its place is in and not to each station."""
    if crowds is not None:
        games = paired_games(games, crowds)
    near = E.radius_join(venues, stations.select("station_no", "lat", "lon"), km).select("place", "station_no").distinct()
    around = cut(near.groupBy("station_no").agg(F.array_sort(F.collect_set("place")).alias("_places")))
    sets = around.select("_places").distinct().withColumn("place", F.explode("_places"))
    days = E.explode_days(E.duration_days(festivals, "begin_date", "end_date"), "begin_date", "end_date", first, last)
    g = E.game_rollup(games.join(sets, "place"), ["_places", "date"], "attendance")
    f = E.festival_rollup(days.join(sets, "place"), ["_places", "date"], "id", "days")
    return E.station_events(g, f, ["_places", "date"]).join(around, "_places").drop("_places")


def load_by_train(timetable: DataFrame, congestion: DataFrame, capacity: float) -> tuple[DataFrame, DataFrame]:
    """P10: per cent of capacity by half hour -> people on board of all its trains -> split over the trains by headway,
    and the check that nobody is lost. ``congestion`` has station_no, direction, slot30, percent."""
    trains = C.trains_per_slot(timetable, ["station_no", "direction"])
    onboard = congestion.join(trains, ["station_no", "direction", "slot30"]).withColumn("onboard", F.col("percent") / 100 * capacity * F.col("trains"))
    split = C.headway_share(timetable, ["station_no", "direction"]).join(onboard, ["station_no", "direction", "slot30"]).withColumn("load", F.col("onboard") * F.coalesce("share", 1 / F.col("trains")))
    return split, Q.mass_check(onboard, split, ["station_no", "direction", "slot30"], "onboard", "load")


def publish(df: DataFrame, path: str, partition: str = "dt") -> None:
    """Writes a job's days; running it again changes nothing."""
    io.overwrite_day(df, path, partition)


def read_snapshot_rows(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots of both file schemas with an id for ties."""
    return io.read_mixed_schema(spark, root).withColumn("event_id", F.xxhash64("station_id", "collected_at", "stock"))
