"""Helpers shared by the text operators."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``). Where it is unset, as in tests, a local session has one
    beside the warehouse; a cluster's session raises, since a folder of one machine would lose rows."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found or f"{spark.conf.get('spark.sql.warehouse.dir')}-scratch"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` has not, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


#: Stands for a null key inside an operator: below every other key.
NULL_KEY = -(2**63)


def long_key(key: str) -> Column:
    """A key column as a long; null becomes ``NULL_KEY``, so that Arrow does not turn keys into floats."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY))


def given_key(key: Column) -> Column:
    """The key as it was before ``long_key``."""
    return F.nullif(key, F.lit(NULL_KEY))


def words(text: Column) -> Column:
    """array<string> of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit_hash(*parts: Column) -> Column:
    """A double in (0, 1) from md5 of the parts, the same in any SQL engine that has md5."""
    hexa = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13)
    return (F.conv(hexa, 16, 10).cast("double") + 0.5) / float(2**52)


def pieces(n: int, per: int, least: int = 1) -> int:
    return max(least, math.ceil(n / per))


def in_slices(texts: list[bytes], most: int) -> Iterator[slice]:
    """Runs of texts of about ``most`` bytes, one text at least."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield slice(begin, len(texts))


def utf8(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
