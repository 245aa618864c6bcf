"""Stored views that batches are merged into: only the partitions that a batch hits are read and written again.

A view is a folder of versions, ``data/v<n>/view_part=<p>/*.parquet``, and manifests, ``_manifests/<n>.json``, that say which version each
partition is in. A merge writes the new partitions to a version of its own and then its manifest, by renaming a file: until then
readers see the view as it was, and a merge that is killed leaves nothing but files that no manifest names. The number
of each writer's last batch stands in the manifest, so a batch that comes again changes nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PART = "view_part"


@dataclass
class Manifest:
    version: int = 0
    #: writer to the number of its last batch
    batches: dict[str, int] = field(default_factory=dict)
    schema: dict | None = None
    #: partition to the version that has it
    parts: dict[str, int] = field(default_factory=dict)


class Folder:
    """Files of a folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root
        self.fs = self.path().getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *names: str):
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *names)))

    def names(self, *folder: str) -> list[str]:
        at = self.path(*folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, *names: str) -> str:
        stream = self.fs.open(self.path(*names))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *names: str) -> None:
        """Whole or not at all; a file that is there stays, and is an error."""
        aside = self.path(*names[:-1], f".{names[-1]}.{uuid.uuid4().hex}")
        out = self.fs.create(aside, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.path(*names)) or not self.fs.rename(aside, self.path(*names)):
            self.fs.delete(aside, False)
            raise RuntimeError(f"another merge has written {'/'.join(names)}")

    def delete(self, *names: str) -> None:
        self.fs.delete(self.path(*names), True)


def current(spark: SparkSession, root: str) -> Manifest:
    """The newest manifest; an empty one where there is no view yet."""
    folder = Folder(spark, root)
    names = [n for n in folder.names("_manifests") if not n.startswith(".")]
    return Manifest(**json.loads(folder.read("_manifests", names[-1]))) if names else Manifest()


def paths_of(spark: SparkSession, root: str, m: Manifest, parts: list[str]) -> list[str]:
    """Folders of partitions, by the names that Spark's writer gave them."""
    wanted, out = {}, []
    for p in parts:
        wanted.setdefault(m.parts[p], set()).add(p)
    for version, some in wanted.items():
        for name in Folder(spark, root).names("data", f"v{version}"):
            if name.startswith(f"{PART}=") and unquote(name.partition("=")[2]) in some:
                out.append(f"{root}/data/v{version}/{name}")
    return out


def read_view(spark: SparkSession, root: str, parts: list[str] | None = None) -> DataFrame:
    """The view, or those of its partitions that are named."""
    m = current(spark, root)
    if m.schema is None:
        raise ValueError(f"no view in {root}")
    schema = StructType.fromJson(m.schema)
    found = paths_of(spark, root, m, [p for p in m.parts if parts is None or p in parts])
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def merge_into(root: str, batch: DataFrame, part: Column, merge: Callable[[DataFrame | None, DataFrame], DataFrame], number: int | None = None, writer: str | None = None) -> list[str]:
    """Merges a batch into the view at ``root`` and gives the partitions that it hit.

    ``part`` names the partition of a row, from the columns that ``merge`` keeps: a day, or a bucket of the key. ``merge`` gets
    the stored rows of the partitions that the batch has, or None where there are none, and the batch, and gives what they
    become; none of its rows may lie elsewhere. A batch whose ``number`` is not above that of its
    writer's last one is left out. The ``writer`` is the streaming query that runs it, by the id that its checkpoint keeps: one that
    goes on counts on, one with a new checkpoint counts from 0 and is another writer.
    Partitions that a batch hits pass the driver by name, as in any listing. One merge runs at a time; of two, one fails."""
    spark = batch.sparkSession
    m = current(spark, root)
    writer = writer or spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
    if number is not None and number <= m.batches.get(writer, -1):
        return []
    folder, aside = Folder(spark, root), f"_aside/{uuid.uuid4().hex}"
    # a batch is read several times; of a stream it must be made once
    batch.write.parquet(f"{root}/{aside}")
    try:
        batch = spark.read.schema(batch.schema).parquet(f"{root}/{aside}")
        hit = [r[0] for r in batch.select(part.cast("string")).distinct().collect()]
        if None in hit:
            raise ValueError("a row of the batch has no partition")
        known = [p for p in hit if p in m.parts]
        stored = read_view(spark, root, known) if known else None
        out = merge(stored, batch)
        version = m.version + 1
        # what a killed merge has left under this number goes
        out.withColumn(PART, part.cast("string")).hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(f"{root}/data/v{version}")
        made = {unquote(n.partition("=")[2]) for n in folder.names("data", f"v{version}") if n.startswith(f"{PART}=")}
        if made - set(hit):
            raise ValueError(f"merged rows outside the partitions of the batch: {sorted(made - set(hit))[:3]}")
        parts = {p: v for p, v in m.parts.items() if p not in hit} | dict.fromkeys(sorted(made), version)
        new = Manifest(version, m.batches if number is None else m.batches | {writer: number}, out.schema.jsonValue(), parts)
        folder.fs.mkdirs(folder.path("_manifests"))
        folder.write(json.dumps(asdict(new)), "_manifests", f"{version:020d}.json")
        return sorted(hit)
    finally:
        folder.delete(aside)


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes all manifests but the last ``keep``, the versions that none of those names, and what killed merges have left. Readers of
    older ones are cut off, and so is a merge that runs meanwhile."""
    folder = Folder(spark, root)
    folder.delete("_aside")
    names = [n for n in folder.names("_manifests") if not n.startswith(".")]
    kept = [Manifest(**json.loads(folder.read("_manifests", n))) for n in names[-keep:]]
    used = {f"v{v}" for m in kept for v in m.parts.values()}
    for n in names[:-keep]:
        folder.delete("_manifests", n)
    for n in folder.names("data"):
        if n not in used and int(n[1:]) <= kept[-1].version:
            folder.delete("data", n)
