"""Data-quality checks: each gives a small table of findings, computed in one pass where it can be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.operators.quantiles import exact_quantiles


def missing_columns(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def table_check(df: DataFrame, keys: Sequence[str], not_null: Sequence[str], not_negative: Sequence[str], min_rows: int = 1) -> DataFrame:
    """One row of counts and a verdict, the first that holds: few_rows, nulls, negatives, duplicates, ok."""
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(sum((F.col(c).isNull().cast("int") for c in not_null if c not in keys), F.lit(0))).alias("_nulls"),
        F.sum(sum((F.coalesce(F.col(c) < 0, F.lit(False)).cast("int") for c in not_negative), F.lit(0))).alias("_neg"),
    )
    key_null = sum((F.col(k).isNull().cast("int") for k in keys if k in not_null), F.lit(0))
    one = counted.agg(F.sum("_n").alias("rows"), F.sum(F.col("_nulls") + key_null * F.col("_n")).alias("nulls"), F.sum("_neg").alias("negatives"), F.sum((F.col("_n") > 1).cast("long")).alias("duplicate_keys"))
    one = one.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in one.columns])
    return one.withColumn("verdict", F.when(F.col("rows") < min_rows, "few_rows").when(F.col("nulls") > 0, "nulls").when(F.col("negatives") > 0, "negatives").when(F.col("duplicate_keys") > 0, "duplicates").otherwise("ok"))


def range_check(df: DataFrame, ranges: dict[str, tuple[float, float]], sources: Sequence[str], source: str = "source") -> DataFrame:
    """Sources that are missing, columns that are all null, values out of range: counts by column and a verdict."""
    seen = F.collect_set(source)
    cols = [x for c, (lo, hi) in ranges.items() for x in (F.count(c).alias(f"n_{c}"), F.sum((~F.col(c).between(lo, hi)).cast("long")).alias(f"out_{c}"))]
    one = df.agg(F.size(F.array_except(F.array(*map(F.lit, sources)), seen)).alias("missing_sources"), *cols)
    empty = sum(((F.col(f"n_{c}") == 0).cast("int") for c in ranges), F.lit(0))
    out = sum((F.coalesce(F.col(f"out_{c}"), F.lit(0)) for c in ranges), F.lit(0))
    return one.withColumn("verdict", F.when(F.col("missing_sources") > 0, "missing_source").when(empty > 0, "all_null").when(out > 0, "out_of_range").otherwise("ok"))


def freshness_check(df: DataFrame, keys: Sequence[str], at: str, now: Column, stale_minutes: int) -> DataFrame:
    """Age of the newest row, and rows older than the limit, by key."""
    age = lambda c: (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(c.cast("timestamp"))) / 60
    return df.groupBy(*keys).agg(age(F.max(at)).alias("age_minutes"), F.count_if(age(F.col(at)) > stale_minutes).alias("stale_rows"), F.count(F.lit(1)).alias("n"))


def hourly_completeness(df: DataFrame, at: str, run: Column, first: Column, last: Column, expected: int) -> DataFrame:
    """Distinct poll runs of every hour in [first, last], hours without rows too."""
    hours = df.sparkSession.range(1).select(F.explode(F.sequence(first, last, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    seen = df.groupBy(F.date_trunc("hour", F.col(at).cast("timestamp")).alias("hour")).agg(F.countDistinct(run).alias("runs"))
    out = hours.join(seen, "hour", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))
    return out.withColumn("complete", F.col("runs") >= expected)


def rule_violations(df: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, key) for each rule that a row breaks; a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unknown_refs(df: DataFrame, master: DataFrame, key: str) -> DataFrame:
    """Distinct keys that the master does not have."""
    return df.join(master.select(key), key, "left_anti").select(key).distinct()


def edge_check(edges: DataFrame, stations: DataFrame, a: str = "from_id", b: str = "to_id", seconds: str = "seconds", station: str = "station_no") -> DataFrame:
    """Findings on edges: self_loop, bad_time, unknown_from, unknown_to; an edge may have several."""
    known = lambda c, n: stations.select(F.col(station).alias(c), F.lit(True).alias(n)).distinct()
    j = edges.join(known(a, "_a"), a, "left").join(known(b, "_b"), b, "left")
    found = F.array_compact(F.array(F.when(F.col(a) == F.col(b), "self_loop"), F.when(~F.coalesce(F.col(seconds) > 0, F.lit(False)), "bad_time"), F.when(F.col("_a").isNull(), "unknown_from"), F.when(F.col("_b").isNull(), "unknown_to")))
    return j.select(a, b, F.explode(found).alias("finding"))


def components_per_line(labels: DataFrame, line: str = "line") -> DataFrame:
    """Components of each line; more than one means that it is broken."""
    return labels.groupBy(line).agg(F.countDistinct("label").alias("components"), F.count(F.lit(1)).alias("stations"))


def mass_check(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str, after_value: str, tolerance: float = 1e-6) -> DataFrame:
    """Sums by key before and after a step, and whether they agree."""
    a = before.groupBy(*keys).agg(F.sum(value).alias("before"))
    b = after.groupBy(*keys).agg(F.sum(after_value).alias("after"))
    j = a.join(b, list(keys), "full_outer").fillna(0.0, ["before", "after"])
    return j.withColumn("kept", F.abs(F.col("before") - F.col("after")) <= tolerance * F.greatest(F.abs("before"), F.lit(1.0)))


def calibration_identity(calibrated: DataFrame, snapshot: DataFrame, keys: Sequence[str], value: str, target: str, tolerance: float = 1e-6) -> DataFrame:
    """Cells whose mean calibrated value is not the snapshot's."""
    m = calibrated.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return m.join(snapshot, list(keys)).select(*keys, (F.col("_m") - F.col(target)).alias("error")).where(F.abs("error") > tolerance)


def terminal_residual(loads: DataFrame, keys: Sequence[str], seq: str, up: str = "load_up", down: str = "load_down") -> DataFrame:
    """What is still on board past the ends of a line: upwards at its last station, downwards at its first."""
    w = Window.partitionBy(*keys)
    ends = loads.withColumns({"_a": F.min(seq).over(w), "_b": F.max(seq).over(w)})
    return ends.groupBy(*keys).agg(F.max(F.when(F.col(seq) == F.col("_b"), F.col(up))).alias("up_left"), F.max(F.when(F.col(seq) == F.col("_a"), F.col(down))).alias("down_left"))


def coverage(sources: DataFrame, panel: DataFrame, name: str, date: str = "date") -> DataFrame:
    """First and last date of each source, and whether it spans the panel."""
    span = panel.agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    s = sources.groupBy(name).agg(F.min(date).alias("first"), F.max(date).alias("last"))
    return s.crossJoin(F.broadcast(span)).select(name, "first", "last", ((F.col("first") <= F.col("_a")) & (F.col("last") >= F.col("_b"))).alias("covers"))


def load_predictions(raw: DataFrame, codes: DataFrame, code: str, casts: dict[str, str], required: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows cast and with their codes mapped, and the rest with the reason: bad_<column> or unknown_code."""
    typed = raw.withColumns({f"_{c}": F.col(c).try_cast(t) for c, t in casts.items()}).join(codes.select(F.col("code").alias(code), "station_no"), code, "left")
    reason = F.when(F.col("station_no").isNull(), "unknown_code")
    for c in required:
        reason = reason.when(F.col(f"_{c}").isNull(), f"bad_{c}")
    tagged = typed.withColumn("reason", reason)
    good = tagged.where("reason IS NULL").select("station_no", *[F.col(f"_{c}").alias(c) for c in casts])
    return good, tagged.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def compare_frames(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows in both and in one only, and the largest difference of each value (nulls on both sides are equal)."""
    x = a.select(*keys, *[F.col(v).alias(f"_a_{v}") for v in values], F.lit(True).alias("_a"))
    y = b.select(*keys, *[F.col(v).alias(f"_b_{v}") for v in values], F.lit(True).alias("_b"))
    j = x.join(y, list(keys), "full_outer")
    both = F.col("_a") & F.col("_b")
    return j.agg(F.count_if(both).alias("both"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"), *[F.max(F.abs(F.col(f"_a_{v}") - F.col(f"_b_{v}"))).alias(f"max_error_{v}") for v in values])


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows by status (same, changed, left, right) of two tables.

    Fractions are the same within ``tolerance`` of the larger one: a sum of doubles differs in its last bits with the order of
    its rows, which no shuffle keeps. Everything else is compared as it is; nulls and NaN are equal to themselves."""
    x = a.select(*keys, F.struct(*values).alias("_x"))
    y = b.select(*keys, F.struct(*values).alias("_y"))
    j = x.join(y, list(keys), "full_outer")
    equal = F.lit(True)
    for v in values:
        p, q = F.col("_x")[v], F.col("_y")[v]
        same = p.eqNullSafe(q)
        if all(t.schema[v].dataType.typeName() in ("double", "float") for t in (a, b)):
            near = F.abs(p - q) <= tolerance * F.greatest(F.abs(p), F.abs(q))
            same |= F.coalesce(near & ~F.isnan(p) & ~F.isnan(q) & (F.abs(p) < float("inf")) & (F.abs(q) < float("inf")), F.lit(False))
        equal &= same
    status = F.when(F.col("_y").isNull(), "left").when(F.col("_x").isNull(), "right").when(equal, "same").otherwise("changed")
    return j.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def drift(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str, grade: Column, status: str) -> DataFrame:
    """How far a second run moved: mean, median, 95th percentile and largest change, changed grades, equal status."""
    x = a.select(*keys, F.col(value).alias("_x"), grade.alias("_gx"), F.col(status).alias("_sx"))
    y = b.select(*keys, F.col(value).alias("_y"), grade.alias("_gy"), F.col(status).alias("_sy"))
    d = x.join(y, list(keys)).withColumn("_d", F.abs(F.col("_y") - F.col("_x")))
    one = d.agg(F.avg("_d").alias("mean"), F.max("_d").alias("largest"), F.avg((F.col("_gx") != F.col("_gy")).cast("int")).alias("grade_changed"), F.avg((F.col("_sx") == F.col("_sy")).cast("int")).alias("status_same"))
    return one.join(F.broadcast(exact_quantiles(d, [], "_d", [0.5, 0.95], "_q"))).select("mean", F.col("_q")[0].alias("median"), F.col("_q")[1].alias("p95"), "largest", "grade_changed", "status_same")


def dataset_report(train: DataFrame, test: DataFrame, station: str, date: str, horizon: str, target: str, leaks: Sequence[str] = ()) -> DataFrame:
    """What a training set must be judged by, one row: equal schemas, dates that do not overlap, stations of the test that
    the training has not, rows and target by part, directions of the target, columns that leak."""
    part = lambda t, n: t.agg(F.count(F.lit(1)).alias(f"{n}_rows"), F.min(date).alias(f"{n}_first"), F.max(date).alias(f"{n}_last"), F.avg(target).alias(f"{n}_mean"), F.avg((F.col(target) > 0).cast("int")).alias(f"{n}_up"), F.countDistinct(horizon).alias(f"{n}_horizons"))
    new = test.select(station).distinct().join(train.select(station).distinct(), station, "left_anti").agg(F.count(F.lit(1)).alias("new_stations"))
    same = train.dtypes == test.dtypes
    out = part(train, "train").crossJoin(F.broadcast(part(test, "test"))).crossJoin(F.broadcast(new))
    return out.withColumns({"same_schema": F.lit(same), "split_clean": F.col("train_last") < F.col("test_first"), "leaks": F.lit(",".join(c for c in leaks if c in train.columns))})
