"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.common import pieces, unit_hash, words

#: Weights of the sources by code point order, null last, repeated.
CYCLE = (3.0, 1.0, 2.0)


def capped_targets(sizes: DataFrame, total_share: float = 1.5, cap: float = 2.0, cycle: Sequence[float] = CYCLE) -> DataFrame:
    """One row a source: ``source, source_size, weight, target``.

    ``sizes`` has source and source_size, a row a source. Targets share ``total_share`` of all sizes by weight; none
    is above ``cap`` times its source's size, and what is cut off is shared anew by weight among the others. That is the
    water level t with sum(min(cap * size, weight * t)) = total: sorted by cap * size / weight, the sources that are
    capped are a prefix, so a running sum finds t without iteration. Sources without words get 0."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(cycle)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), F.pmod(F.row_number().over(by_name) - 1, F.lit(n)).cast("int") + 1)
    rows = sizes.withColumn("weight", weight).withColumn("_most", F.col("source_size") * cap).withColumn("_level", F.col("_most") / F.col("weight"))
    up = Window.orderBy("_level", F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(1))
    rows = (
        rows.withColumn("_full", F.coalesce(F.sum("_most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_open", F.sum("weight").over(up.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_total", F.sum("source_size").over(every) * total_share)
        .withColumn("_t", (F.col("_total") - F.col("_full")) / F.col("_open"))
        # the first source whose own level is not below the level of those that remain
        .withColumn("_water", F.min(F.when(F.col("_t") <= F.col("_level"), F.struct("_level", "_t"))).over(every)["_t"])
    )
    return rows.select("source", "source_size", "weight", F.coalesce(F.least(F.col("_most"), F.col("weight") * F.col("_water")), F.col("_most")).alias("target"))


def position_of_share(share: Column, start: Column, end: Column) -> Column:
    """Inverts a schedule whose weight runs linearly from ``start`` to ``end`` over training time 0 to 1.

    Its integral to x is (start x + (end - start) x^2 / 2) over its whole area (start + end) / 2; this gives the x at
    which the integral is ``share``."""
    slope = end - start
    root = F.sqrt(start * start + slope * share * (start + end))
    return F.when(F.abs(slope) < 1e-12, share).otherwise(2 * share * (start + end) / (2 * (start + root)))


def planned(docs: DataFrame, kept: Sequence[Column], key: str = "doc_id", text: str = "text", source: str = "source", total_share: float = 1.5, cap: float = 2.0, cycle: Sequence[float] = CYCLE, seed: int = 11) -> DataFrame:
    """A struct ``row`` of the ``kept`` columns for every row of ``docs``, with ``size``, its source's ``source_size`` and
    ``target``, the words ``taken`` of it and ``positions``, the training position (0 to 1) of each time it is taken.

    Size: words of the text (null: 0). Inside a source rows follow a keyed hash; the running sum of sizes gives each
    row its range of the source's demand. A target of q whole passes and a rest takes every row q times, and once more
    the rows whose middle lies within the rest; ``taken`` is never over ceil(cap) x size. The source's weight runs
    linearly from ``w`` to ``w x (1 + rank) / 2`` over the training (rank: its weight over the largest). Its cumulative
    demand up to the middle of a copy, ``pass x source_size + middle``, over its target is inverted through the integral of
    that schedule: every source runs from the start of training to its end, however often it is read.

    Running sums are made in two steps, totals of (source, bucket) and then rows inside a bucket of about 20,000, so a
    source with most rows is no single task. Null sources are one source; rows with equal keys all stay; rows without
    words take 0 and have no position. Only totals of sources and buckets are gathered."""
    buckets = pieces(docs.count(), 20_000, 64)
    rows = docs.select(
        F.struct(*kept).alias("row"),
        F.col(key).alias("_key"),
        F.col(source).cast("string").alias("source"),
        F.size(words(F.col(text))).cast("long").alias("size"),
        unit_hash(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_u"),
    ).withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    # plain keys for a source that may be null, so that the join below finds the window's partitioning and moves no text
    rows = rows.withColumns({"_none": F.col("source").isNull(), "_name": F.coalesce("source", F.lit(""))})
    totals = rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    targets = capped_targets(totals.groupBy("source").agg(F.sum("_words").alias("source_size")), total_share, cap, cycle)
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_start"))
    plan = starts.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    plan = plan.withColumns({"_none": F.col("_s").isNull(), "_name": F.coalesce("_s", F.lit(""))}).withColumnRenamed("_b", "_bucket").drop("_s")
    inside = Window.partitionBy("_none", "_name", "_bucket").orderBy("_u", "_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("weight") * (1 + F.col("weight") / max(cycle)) / 2
    times = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    rest = F.col("target") - times * F.col("source_size")
    at = lambda n: (n * F.col("source_size") + F.col("_middle")) / F.col("target")
    return (
        rows.withColumn("_sum", F.sum("size").over(inside))
        # sources x buckets rows, a few for each 20,000 rows; the optimizer checks the size of this side
        .join(plan, ["_none", "_name", "_bucket"])
        .withColumn("_middle", F.col("_start") + F.col("_sum") - F.col("size") / 2)
        .withColumn("_times", F.when(F.col("size") > 0, times + (F.col("_middle") <= rest).cast("long")).otherwise(F.lit(0)).cast("int"))
        .select(
            "row", "size", "source", "source_size", "target", (F.col("size") * F.col("_times")).alias("taken"),
            F.transform(F.slice(F.sequence(F.lit(0), F.greatest(F.col("_times"), F.lit(1)) - 1), F.lit(1), F.col("_times")), lambda n: position_of_share(at(n), F.col("weight"), last)).alias("positions"),
        )
    )


def curriculum(docs: DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """Every row as ``key, size, source_size, target, taken, source, positions`` (see ``planned``), range-sorted by its
    first position; rows that are not taken stand last."""
    rows = planned(docs, [F.col(key)], key, **kw)
    return rows.select(F.col("row")[key].alias(key), "size", "source_size", "target", "taken", "source", "positions").orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), key)


def mix(docs: DataFrame, key: str = "doc_id", **kw) -> DataFrame:
    """``docs`` as the mix reads them: a row for each time a document is taken, range-sorted by that copy's position.

    Rows that the mix does not take go. Repeats of one source stand among the first passes of the others, as the
    schedules say. Whole rows travel with their plan, so rows that repeat a key keep each its own."""
    rows = planned(docs, [F.col(f"`{c}`") for c in docs.columns], key, **kw).select("row", F.explode("positions").alias("position"))
    own = F.col("row")[key]
    return rows.repartitionByRange("position", own).sortWithinPartitions("position", own).select("row.*")
