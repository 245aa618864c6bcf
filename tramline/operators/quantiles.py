"""Exact quantiles of columns of any size, without one task that holds all values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.scratch import cut

#: Parts that a range of values is cut into by a pass, and values of a range that are put in order at the end.
FAN, FEW = 1024, 4096


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, shares: Sequence[float], name: str = "q", fan: int = FAN, few: int = FEW) -> DataFrame:
    """``keys`` and an array of the ``shares`` quantiles of ``value`` (linear between neighbours, as ``percentile`` gives them).

    Selection by refinement: a pass counts values in ``fan`` parts of the range in which a wanted rank lies and goes on
    with the part that holds it, so after each pass the range is that much narrower, until it holds ``few`` rows or one
    value; only those are put in order. Counts are summed where rows lie before they move, so neither a column without
    keys nor a hot key is one task's, and a task holds ``fan`` counts of a range. ``df`` is read once a pass (two or three
    on even data, more where a few values are far off); it is kept on disk meanwhile. Nulls do not count; a group of nulls has null quantiles.

    Values are finite numbers. Without keys an empty table has one row of nulls."""
    keys = list(keys)
    v = F.col(value) if isinstance(value, str) else value
    rows = df.select(*keys, v.cast("double").alias("_x")).persist()
    names = [f"_k{i}" for i in range(len(keys))]
    same = lambda d: [F.col(k).eqNullSafe(d[n]) for k, n in zip(keys, names, strict=True)]
    whole = cut(rows.groupBy(*keys).agg(F.count("_x").alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")))
    groups = whole.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], "_n", "_low", "_high")
    at = F.explode(F.transform(F.array(*map(F.lit, shares)), lambda s: s * (F.col("_n") - 1)))
    ranks = groups.where("_n > 0").select("*", at.alias("_at"))
    ranks = ranks.select("*", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).drop("_at").distinct()
    # a range: where it begins and ends, rows in it and below it, and the ranks that lie in it
    state = [*names, "_rank", "_low", "_high", "_in", "_below"]
    open_ = cut(ranks.select(*names, "_rank", "_low", "_high", F.col("_n").alias("_in"), F.lit(0).cast("long").alias("_below")))
    done = []
    wide = (F.col("_in") > few) & (F.col("_low") < F.col("_high"))
    # halves, so that the width of the widest range is no infinity
    part = F.least(F.floor((F.col("_x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * fan), F.lit(fan - 1)).cast("int")
    inside = lambda spans: (F.col("_x") >= spans["_low"]) & (F.col("_x") <= spans["_high"])
    while True:
        done.append(open_.where(~wide))
        open_ = open_.where(wide)
        if open_.isEmpty():
            break
        spans = open_.select(*names, "_low", "_high").distinct()
        met = rows.join(F.broadcast(spans) if not keys else spans, [*same(spans), inside(spans)])
        counts = met.groupBy(*names, "_low", "_high", part.alias("_part")).agg(F.count(F.lit(1)).alias("_in"), F.min("_x").alias("_a"), F.max("_x").alias("_b"))
        before = Window.partitionBy(*names, "_low", "_high").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_more", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        old = open_.select(*[F.col(n).alias(f"{n}o") for n in names], "_rank", F.col("_low").alias("_lo"), F.col("_high").alias("_ho"), F.col("_below").alias("_base"))
        on = [*[F.col(n).eqNullSafe(F.col(f"{n}o")) for n in names], F.col("_low") == F.col("_lo"), F.col("_high") == F.col("_ho")]
        held = counts.join(old, on).where((F.col("_rank") >= F.col("_base") + F.col("_more")) & (F.col("_rank") < F.col("_base") + F.col("_more") + F.col("_in")))
        open_ = cut(held.select(*names, "_rank", F.col("_a").alias("_low"), F.col("_b").alias("_high"), "_in", (F.col("_base") + F.col("_more")).alias("_below")).select(*state))
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    spans = found.where("_low < _high").select(*names, "_low", "_high", "_below").distinct()
    met = rows.join(F.broadcast(spans) if not keys else spans, [*same(spans), inside(spans)])
    values = met.groupBy(*names, "_low", "_high", "_below", "_x").agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*names, "_low", "_high").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_end", F.col("_below") + F.sum("_c").over(upto))
    values = values.select(*[F.col(n).alias(f"{n}o") for n in names], F.col("_low").alias("_lo"), F.col("_high").alias("_ho"), "_x", "_c", "_end")
    on = [*[F.col(n).eqNullSafe(F.col(f"{n}o")) for n in names], F.col("_low") == F.col("_lo"), F.col("_high") == F.col("_ho"), F.col("_rank") < F.col("_end"), F.col("_rank") >= F.col("_end") - F.col("_c")]
    at_rank = found.join(values, on, "left").select(*names, "_rank", F.coalesce("_x", "_low").alias("_v"))
    by_rank = at_rank.groupBy(*names).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))

    def between(s: float) -> Column:
        place = F.lit(s) * (F.col("_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        a, b = F.try_element_at("_m", low), F.try_element_at("_m", high)
        return F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)

    out = groups.select(*names, "_n").join(by_rank.select(*[F.col(n).alias(f"{n}o") for n in names], "_m"), [F.col(n).eqNullSafe(F.col(f"{n}o")) for n in names] or F.lit(True), "left")
    out = cut(out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], F.array(*map(between, shares)).alias(name)))
    rows.unpersist()
    return out
