"""Packing tokenised documents into sequences of balanced attention cost and little padding."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import given_key, long_key
from tramline.llm.common import pieces as parts_of

SIZE = 2048
END = 1
#: Bits of a sequence id: the file and the place in it name a group, then comes the sequence in the group.
FILE_BITS, PLACE_BITS, SEQUENCE_BITS = 20, 16, 27


@lru_cache(maxsize=2)
def encoder(path: str):
    """A fast encoder with the vocabulary and merges of a byte-level BPE file of the tokenizers library.

    The file's ids are read as merge ranks. A special token's string in a text is that token's id, as ``tokenizers``
    does without any flag; the tests compare the ids with that library's."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    # the printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the other bytes for 256 upward
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def by_hash(rows: DataFrame, n: int, per_group: int) -> DataFrame:
    """``rows(_key, _text)`` with a group by a hash of key and text, which doesn't depend on partitions."""
    groups = parts_of(n, per_group)
    return rows.withColumn("_group", F.pmod(F.xxhash64("_key", F.crc32(F.col("_text").cast("binary"))), F.lit(groups)).cast("long"))


def by_place(rows: DataFrame, name: str, row: str, per_group: int) -> DataFrame:
    """``rows`` with a group for each ``per_group`` rows that follow one another in a file. Files that Spark wrote count by
    the number of their part, any other ones by a hash of their name; nothing is shuffled to find the groups."""
    part = F.regexp_extract(name, r"^part-([0-9]+)", 1).try_cast("long")
    file = F.coalesce(part, F.pmod(F.xxhash64(name), F.lit(1 << FILE_BITS))) % (1 << FILE_BITS)
    return rows.withColumn("_group", F.shiftleft(file, PLACE_BITS) + F.floor(F.col(row) / per_group).cast("long"))


def has_files(docs: DataFrame) -> bool:
    """Whether the rows know their place in a file, as rows of a file source do."""
    try:
        docs.select("_metadata.file_name", "_metadata.row_index").schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def tokenised(rows: DataFrame, path: str, size: int) -> DataFrame:
    """Of ``rows(_key, _group, _text)`` the whole sequences of each document (checksum made, ids left behind) and its last
    part with the ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            rows = []
            for k, group, t in zip(pdf["_key"], pdf["_group"], pdf["_text"], strict=True):
                ids = np.array([*enc.encode(t or "", allowed_special="all"), END], dtype=np.uint32)
                n = len(ids)
                whole = n - n % size
                rows += [(k, group, i, size, n, crc(ids[i : i + size]), None) for i in range(0, whole, size)]
                if n > whole:
                    rows.append((k, group, whole, n - whole, n, 0, ids[whole:].astype("<u4" if ids[whole:].max() > 65535 else "<u2").tobytes()))
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=["doc_id", "group", "start", "length", "doc_tokens", "crc", "ids"])
                    rows = []
            yield pd.DataFrame(rows, columns=["doc_id", "group", "start", "length", "doc_tokens", "crc", "ids"])

    return rows.select("_key", "_group", "_text").mapInPandas(run, "doc_id long, group long, start long, length long, doc_tokens long, crc long, ids binary")


def cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def pack_group(rows: list[tuple], size: int, linear: float, quadratic: float) -> Iterator[tuple]:
    """Packs pieces ``(doc_id, start, length, doc_tokens, ids)`` shorter than ``size``; yields
    ``(doc_id, start, length, crc, doc_tokens, sequence, offset)``.

    There are as many sequences as the tokens fill. Pieces go from the dearest down, each to the sequence of lowest cost
    so far among all that have room for it. Where none has, the piece is cut: its first part fills the cheapest sequence
    with any room, and the rest goes on in the same way. Ties go by doc_id, start and sequence number."""
    rows = sorted(rows, key=lambda r: (-cost(r[2], linear, quadratic), r[0], r[1], r[4]))
    n = -(-sum(r[2] for r in rows) // size)
    room, spent = np.full(n, size), np.zeros(n)
    for doc, start, length, tokens, ids in rows:
        ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * length else "<u4").astype("<u4")
        at = 0
        while at < length:
            fits = room >= length - at
            i = int(np.where(fits if fits.any() else room > 0, spent, np.inf).argmin())
            take = min(int(room[i]), length - at)
            yield doc, start + at, take, crc(ids[at : at + take]), tokens, i, size - int(room[i])
            room[i] -= take
            spent[i] += cost(take, linear, quadratic)
            at += take


def pack(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE, linear: float = 1.0, quadratic: float = 1.0 / 1024, per_group: int = 2048, in_order: bool = False) -> DataFrame:
    """All documents (an empty or null text is its end token alone) cut into pieces of sequences of ``size`` tokens.

    A piece costs ``linear * n + quadratic * n^2``: it attends only within itself. Full stretches of long documents are
    sequences of their own; the last parts are dealt to groups of about ``per_group`` documents, and each group is packed
    in one task (``pack_group``). Groups go by a hash, or with ``in_order``, for a table of files written in training order,
    by place in the files: sequence ids then follow that order from group to group. A group's memory is bounded by its
    documents' last parts, whatever the documents' length; it leaves under one sequence of padding. Keys may repeat; each
    row is packed by itself. Keys are integers or null. Columns other than key and text are not read; an empty table gives
    no piece."""
    chosen = [long_key(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")]
    if in_order and has_files(docs):
        rows = by_place(docs.select(*chosen, F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")), "_file", "_row", per_group)
    else:
        rows = by_hash(docs.select(*chosen), docs.count(), per_group)
    cut = tokenised(rows, path, size)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["group"].iloc[0])
        whole = pdf[pdf["ids"].isna()].sort_values(["doc_id", "start", "crc"], kind="stable")
        rest = pdf[pdf["ids"].notna()]
        out = [(d, s, n, c, t, i, 0) for i, (d, s, n, c, t) in enumerate(zip(whole["doc_id"], whole["start"], whole["length"], whole["crc"], whole["doc_tokens"], strict=True))]
        first = len(out)
        packed = pack_group(list(zip(rest["doc_id"], rest["start"], rest["length"], rest["doc_tokens"], rest["ids"], strict=True)), size, linear, quadratic)
        out += [(d, s, n, c, t, first + i, o) for d, s, n, c, t, i, o in packed]
        got = pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        got["sequence_id"] += group << SEQUENCE_BITS
        return got

    out = cut.groupBy("group").applyInPandas(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", given_key(F.col("doc_id"))).withColumn("cost", attention_cost(F.col("length"), linear, quadratic))


def attention_cost(length: Column, linear: float, quadratic: float) -> Column:
    return F.lit(linear) * length + F.lit(quadratic) * length * length
