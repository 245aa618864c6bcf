"""An append log of topics in a shared folder, as a data source of its own: batches append, streams replay by offset.

The log stands in for a broker where there is none, and keeps its contract: each topic has partitions, each row of a
partition an offset without gaps, a new stream begins at the earliest one, a stopped stream goes on where its checkpoint
says, and a consumer group's offsets move once a batch is done.

A partition is a folder of Parquet segments, ``<root>/<topic>/<partition>/<first offset>-<rows>.parquet``: names alone tell
the offsets, so a stream's progress costs a listing. Segments are written aside and renamed, so a reader sees whole ones."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

FORMAT = "event_log"
SCHEMA = "topic string, partition int, offset long, key string, value string, timestamp timestamp"
#: Columns that a row to append has; the offset is given by the log.
GIVEN = "topic string, partition int, key string, value string, timestamp timestamp"
SEGMENT = re.compile(r"(\d{20})-(\d+)\.parquet$")
#: Rows of a segment that is being written, and offsets that one task reads.
SEGMENT_ROWS, TASK_ROWS = 1_000_000, 250_000


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, for tasks as well as for the driver."""
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def name_of(topic: str, partition: int) -> str:
    return f"{topic}/{partition}"


def segments(root: str, topics: Iterable[str] = ()) -> dict[str, list[tuple[int, int, str]]]:
    """``topic/partition`` to its segments (first offset, rows, path), in order; of all topics if none is named."""
    fs, base = filesystem(root)
    wanted, out = set(topics), {}
    for f in fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True)):
        *_, topic, partition, leaf = f.path.split("/")
        found = SEGMENT.match(leaf)
        if found and partition.isdigit() and (not wanted or topic in wanted):
            out.setdefault(name_of(topic, int(partition)), []).append((int(found[1]), int(found[2]), f.path))
    return {k: sorted(v) for k, v in sorted(out.items())}


def bounds(root: str, topics: Iterable[str] = ()) -> dict[str, tuple[int, int]]:
    """The earliest offset of each partition and the one that comes next."""
    return {k: (v[0][0], v[-1][0] + v[-1][1]) for k, v in segments(root, topics).items()}


def put(root: str, path: str, value: object) -> None:
    """A small JSON file, written aside and renamed."""
    fs, base = filesystem(root)
    fs.create_dir(f"{base}/{path.rpartition('/')[0]}", recursive=True)
    aside = f"{base}/{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        out.write(json.dumps(value).encode())
    fs.move(aside, f"{base}/{path}")


def committed(root: str, group: str) -> dict[str, int]:
    """The next offset of each partition for a consumer group; empty if it has not committed."""
    fs, base = filesystem(root)
    path = f"{base}/_groups/{group}.json"
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return {}
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass
class Range(InputPartition):
    """Offsets [begin, end) of a partition, all in one segment that begins at ``first``."""

    topic: str
    partition: int
    path: str
    first: int
    begin: int
    end: int


def ranges(root: str, topics: Iterable[str], start: dict[str, int], end: dict[str, int]) -> list[Range]:
    """What lies between two offsets, in pieces of at most ``TASK_ROWS``: a partition with most rows is many tasks. A partition
    that ``start`` does not know began after it. What retention has removed in between is an error, not a silent gap."""
    out = []
    known = segments(root, topics)
    for name, stop in end.items():
        topic, _, partition = name.rpartition("/")
        at = start.get(name, known[name][0][0] if name in known else stop)
        if at < stop and (name not in known or known[name][0][0] > at):
            raise ValueError(f"offset {at} of {name} is gone from the log")
        for first, rows, path in known.get(name, []):
            low, high = max(at, first), min(stop, first + rows)
            out += [Range(topic, int(partition), path, first, b, min(b + TASK_ROWS, high)) for b in range(low, high, TASK_ROWS)]
    return out


def rows_of(root: str, part: Range) -> Iterator[pa.RecordBatch]:
    fs, _ = filesystem(root)
    at = part.first
    with pq.ParquetFile(part.path, filesystem=fs) as file:
        groups = []
        for g in range(file.num_row_groups):
            n = file.metadata.row_group(g).num_rows
            if at + n > part.begin and at < part.end:
                groups.append((g, at))
            at += n
        for g, at in groups:
            for batch in file.iter_batches(batch_size=8192, row_groups=[g]):
                low, high = max(part.begin - at, 0), min(part.end - at, batch.num_rows)
                if low < high:
                    cut = batch.slice(low, high - low)
                    n = cut.num_rows
                    offset = pa.array(range(at + low, at + high), pa.int64())
                    columns = [pa.array([part.topic] * n, pa.string()), pa.array([part.partition] * n, pa.int32()), offset, *[cut.column(c) for c in ("key", "value", "timestamp")]]
                    yield pa.RecordBatch.from_arrays(columns, names=["topic", "partition", "offset", "key", "value", "timestamp"])
                at += batch.num_rows


class LogBatchReader(DataSourceReader):
    def __init__(self, root: str, topics: list[str]):
        self.root, self.topics = root, topics

    def partitions(self) -> list[Range]:
        return ranges(self.root, self.topics, {}, {k: end for k, (_, end) in bounds(self.root, self.topics).items()})

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows_of(self.root, partition)


class LogStreamReader(DataSourceStreamReader):
    def __init__(self, root: str, topics: list[str], starting: str, group: str | None):
        self.root, self.topics, self.starting, self.group = root, topics, starting, group

    def initialOffset(self) -> dict:
        now = bounds(self.root, self.topics)
        if self.starting == "latest":
            return {k: end for k, (_, end) in now.items()}
        first = {k: begin for k, (begin, _) in now.items()}
        return first | {k: v for k, v in committed(self.root, self.group).items() if k in first} if self.starting == "group" else first

    def latestOffset(self) -> dict:
        return {k: end for k, (_, end) in bounds(self.root, self.topics).items()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.root, self.topics, start, end)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return rows_of(self.root, partition)

    def commit(self, end: dict) -> None:
        if self.group:
            put(self.root, f"_groups/{self.group}.json", committed(self.root, self.group) | end)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, str, int]]


class LogWriter(DataSourceArrowWriter):
    """Tasks write segments aside; the driver gives them their offsets, in order of tasks, by renaming them. One writer at a
    time: two that commit at once would give the same offsets. A job that failed leaves nothing in the log."""

    def __init__(self, root: str):
        self.root, self.aside = root, f"_aside/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = filesystem(self.root)
        kind = pa.schema([("key", pa.string()), ("value", pa.string()), ("timestamp", pa.timestamp("us", "UTC"))])
        fs.create_dir(f"{base}/{self.aside}", recursive=True)
        open_, done = {}, []
        for batch in iterator:
            table = pa.Table.from_batches([batch])
            names = table.select(["topic", "partition"]).group_by(["topic", "partition"]).aggregate([])
            for topic, partition in zip(names["topic"].to_pylist(), names["partition"].to_pylist(), strict=True):
                if topic is None or partition is None or "/" in topic or topic.startswith("_"):
                    raise ValueError(f"no place for topic {topic!r}, partition {partition!r}")
                rows = table.filter(pc.and_(pc.equal(table["topic"], topic), pc.equal(table["partition"], partition))).select(kind.names).cast(kind)
                if (topic, partition) not in open_:
                    path = f"{base}/{self.aside}/{uuid.uuid4().hex}.parquet"
                    open_[topic, partition] = [path, pq.ParquetWriter(path, kind, filesystem=fs), 0]
                at = open_[topic, partition]
                at[1].write_table(rows)
                at[2] += rows.num_rows
                if at[2] >= SEGMENT_ROWS:
                    at[1].close()
                    done.append((topic, partition, at[0], at[2]))
                    del open_[topic, partition]
        for (topic, partition), (path, writer, n) in open_.items():
            writer.close()
            done.append((topic, partition, path, n))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.root)
        after = {k: end for k, (_, end) in bounds(self.root).items()}
        for topic, partition, path, n in (f for m in messages if m for f in m.files):
            at = after.get(name_of(topic, partition), 0)
            fs.create_dir(f"{base}/{topic}/{partition}", recursive=True)
            fs.move(path, f"{base}/{topic}/{partition}/{at:020d}-{n}.parquet")
            after[name_of(topic, partition)] = at + n
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = filesystem(self.root)
        if fs.get_file_info(f"{base}/{self.aside}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{base}/{self.aside}")


class EventLog(DataSource):
    """Options: ``path``; ``topics`` (comma-joined, all if absent); for streams ``startingOffsets`` (earliest, latest, or group:
    where ``group`` has committed) and ``group``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def topics(self) -> list[str]:
        return [t for t in self.options.get("topics", "").split(",") if t]

    def reader(self, schema) -> LogBatchReader:
        return LogBatchReader(self.options["path"], self.topics())

    def streamReader(self, schema) -> LogStreamReader:
        starting, group = self.options.get("startingOffsets", "earliest"), self.options.get("group")
        if starting not in ("earliest", "latest", "group") or (starting == "group" and not group):
            raise ValueError(f"startingOffsets {starting!r} with group {group!r}")
        return LogStreamReader(self.options["path"], self.topics(), starting, group)

    def writer(self, schema, overwrite: bool) -> LogWriter:
        if overwrite:
            raise ValueError("the log is only appended to")
        return LogWriter(self.options["path"])


def append_log(df: DataFrame, root: str) -> None:
    """Appends rows of ``topic, partition, key, value, timestamp`` (further columns are left out). Rows of a partition get its
    next offsets; in what order among themselves is the order of tasks."""
    df.sparkSession.dataSource.register(EventLog)
    columns = [c.strip().rsplit(" ", 1) for c in GIVEN.split(",")]
    df.select(*[df[c].cast(kind).alias(c) for c, kind in columns]).write.format(FORMAT).mode("append").save(root)


def read_log(spark: SparkSession, root: str, topics: Iterable[str] = ()) -> DataFrame:
    spark.dataSource.register(EventLog)
    return spark.read.format(FORMAT).option("topics", ",".join(topics)).load(root)


def stream_log(spark: SparkSession, root: str, topics: Iterable[str] = (), starting: str = "earliest", group: str | None = None) -> DataFrame:
    """The log as a stream. A query with a checkpoint goes on behind its last batch whatever ``starting`` says."""
    spark.dataSource.register(EventLog)
    r = spark.readStream.format(FORMAT).option("topics", ",".join(topics)).option("startingOffsets", starting)
    return (r.option("group", group) if group else r).load(root)


def group_lag(spark: SparkSession, root: str, group: str, topics: Iterable[str] = ()) -> DataFrame:
    """``topic, partition, next_offset, end_offset, lag`` of a consumer group, one row a partition."""
    at = committed(root, group)
    rows = [(*k.rpartition("/")[::2], at.get(k, begin), end) for k, (begin, end) in bounds(root, topics).items()]
    return spark.createDataFrame([(t, int(p), a, e, e - a) for t, p, a, e in rows], "topic string, partition int, next_offset long, end_offset long, lag long")
