"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tramline.llm.common import pieces, unit_hash


def rendezvous(key: Column, weights: Sequence[float], seed: int = 0) -> Column:
    """The shard (0-based) with the highest score ``weight / -ln(u(key, shard))``.

    Adding a shard moves rows only into the new one, and dropping one moves only its rows: the scores of the other
    shards stay. A null key is hashed as an empty string. Ties go to the higher shard number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct((F.lit(float(w)) / -F.log(unit_hash(F.lit(seed), key, F.lit(i)))).alias("score"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.greatest(*scores)["shard"] if len(scores) > 1 else F.lit(0)


def shard_by_key(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * 16, rows_per_bucket: int = 20_000) -> DataFrame:
    """Every row with its shard, the shard it would have with one more of weight 1, and a gapless slot in its shard.

    Slots come from two steps, so that no shard is sorted in one task: rows are numbered inside (shard, bucket), and
    each bucket starts where the buckets before it in the shard end. Buckets are a hash of key, size and checksum, as many as
    leave each about ``rows_per_bucket`` rows, so a key that many texts share is many tasks; rows alike in all three are
    one bucket. A shard's counts of buckets pass one window. Rows with equal keys all stay; a null key or text is kept
    (empty text, size 1). Columns other than key and text are not read."""
    buckets = pieces(docs.count(), rows_per_bucket * len(weights))
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    rows = docs.select(
        F.col(key).alias("_key"),
        size.alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, 1.0]).alias("grown_shard"),
    ).withColumn("_bucket", F.pmod(F.xxhash64("_key", "size", "text_crc32", F.lit(7)), F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_key", "size", "text_crc32")
    return (
        rows.withColumn("_i", F.row_number().over(inside) - 1)
        .join(starts, ["shard", "_bucket"])
        .select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_i")).cast("long").alias("slot"), "grown_shard")
    )
