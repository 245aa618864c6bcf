"""Dense places of rows inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import written


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, pos: str = "pos", without: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the place of each row in its group (long, from 0) by ``order``, written to the shared folder. Columns of
    ``without`` only serve the order.

    Rows are dealt by ranges of (group, order) and sorted there; the written number of a row says its range and its place in
    it. A group that spans ranges gets the rows of its earlier ranges added, one count for each range: no group is sorted in
    one task. Rows alike in every key are told apart by their place in the input, so they are split as well. Null groups are
    a group, and nulls sort as ``order`` says."""
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order, F.col("_tie").asc()]
    dealt = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", *without)
    rows = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_range", F.shiftright("_at", 33))
    spans = rows.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_add", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).drop("_n", "_first")
    spans = spans.select(*[F.col(c).alias(f"_of_{c}") for c in (*group, "_range")], "_add")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in (*group, "_range")])
    return rows.join(spans, same).withColumn(pos, F.col("_at") + F.col("_add")).select(*[c for c in df.columns if c not in without], pos)
