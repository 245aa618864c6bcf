"""Removal of passages that an earlier document has, by suffixes and a difference cover, one bucket at a time.

Every 50-byte string of every document would be a suffix to sort: far more than the input. A difference cover modulo 31
makes that unnecessary. Its six residues have every difference modulo 31, so of two equal 50-byte strings, wherever they
start, one pair of cover places lies within the first 31 bytes of both at the same shift, and the 20 bytes behind those
places are equal too. So:

1. the suffixes at cover places are dealt to buckets by a fingerprint of 20 bytes and each bucket is ranked alone; a
   place whose rank is its own cannot lie in a repeated string;
2. only suffixes within 31 bytes before a cover place with a shared rank are candidates. They are dealt to buckets by a
   64-bit fingerprint of their 50 bytes, each bucket is sorted alone, and of each run of equal suffixes the lowest
   document is found;
3. each document takes back which of its suffixes have a lower document and removes the bytes they cover.

Documents meet in batches, ranges of keys whose text is shuffled once, compressed; the three passes read the same
exchange. As batches are ranges, the lowest batch that holds a suffix holds its lowest document, so no keys go to the
buckets: between the passes go sorted fingerprints as compressed differences (2 to 3 bytes a cover place, 6 bytes a
candidate) and a bit for each in answer."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import given_key, in_slices, long_key, pieces, utf8
from tramline.llm.shingles import mixed

#: A perfect difference set modulo 31: every difference but 0 once.
MODULUS, COVER = 31, (1, 5, 11, 24, 25, 27)
BATCH_BYTES, BUCKET_PLACES = 1 << 22, 1 << 22
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
VALUE = mixed(np.arange(1, 257, dtype=np.uint64))
#: Kinds of rows between the passes.
PLACES, WHO, SUFFIXES, WHERE = range(4)
SCHEMA = "bucket int, batch int, kind int, blob binary"


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, one table a process that grows to the longest batch met."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = -(-n // (1 << 20)) << 20
        _POWERS.clear()
        for x in (BASE, INVERSE):
            table = np.full(size, x)
            table[0] = 1
            _POWERS.append(np.multiply.accumulate(table, out=table))
    return _POWERS[0][:n], _POWERS[1][:n]


class Texts:
    """A batch's documents in order of key, their bytes joined."""

    def __init__(self, blobs: list[bytes], keep: np.ndarray | None = None):
        rows = sorted(r for b in blobs for r in unpacked(b))
        self.all = rows
        self.rows = rows if keep is None else [r for r, k in zip(rows, keep.tolist(), strict=True) if k]
        self.keys = np.array([k for k, _ in self.rows], np.int64)
        self.data = np.frombuffer(b"".join(t for _, t in self.rows), np.uint8)
        self.ends = np.cumsum([len(t) for _, t in self.rows]).astype(np.int64) if self.rows else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if self.rows else np.zeros(0, np.int64)
        n = len(self.data)
        up, _ = powers(max(n, 1))
        self.sums = np.zeros(n + 1, np.uint64)
        np.multiply(VALUE[self.data], up[:n], out=self.sums[1:])
        np.cumsum(self.sums, out=self.sums)

    def prints(self, at: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the ``length`` bytes at these places."""
        _, down = powers(max(len(self.data), 1))
        return mixed((self.sums[at + length] - self.sums[at]) * down[at])

    def strong_prints(self, at: np.ndarray, length: int) -> np.ndarray:
        """64-bit fingerprints that decide equality: the ``length`` bytes word by word, each mixed into what came before, so
        that every bit hangs on every byte and its place; the last word may overlap the one before it."""
        words = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,)) if len(self.data) > 7 else np.zeros(0, "<u8")
        out = np.full(len(at), BASE)
        for k in [*range(0, length - 7, 8), length - 8]:
            out ^= words[at + k]
            out = mixed(out)
        return out

    def cover(self, length: int) -> np.ndarray:
        """The cover places, counted from each document's start, that have ``length`` bytes behind them."""
        on = np.zeros(MODULUS, bool)
        on[list(COVER)] = True
        found = []
        for a, b in zip(self.starts.tolist(), self.ends.tolist(), strict=True):
            m = b - a - length + 1
            if m > 0:
                found.append(a + np.flatnonzero(np.resize(on, m)))
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def packed(keys: list[int], texts: list[bytes]) -> bytes:
    sizes = np.array([len(t) for t in texts], np.int64)
    head = len(keys).to_bytes(8, "little") + np.array(keys, np.int64).tobytes() + sizes.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(texts))


def unpacked(blob: bytes) -> list[tuple[int, bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    keys, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    ends = np.cumsum(sizes) + 8 + 16 * n
    return [(k, raw[e - m : e]) for k, m, e in zip(keys.tolist(), sizes.tolist(), ends.tolist(), strict=True)]


def bucket_starts(x: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of n buckets begins in sorted numbers of so many bits: buckets are equal ranges of the numbers."""
    edges = np.array([(i << bits) // n for i in range(n)], np.uint64)
    return np.append(np.searchsorted(x, edges), len(x))


def squeeze_sorted(x: np.ndarray) -> bytes:
    """Sorted numbers as the first one and their differences, compressed by byte planes."""
    steps = np.diff(x)
    planes = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    raw = np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(int(x[0]).to_bytes(8, "little") + bytes([planes]) + raw)


def sorted_of(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    planes = raw[8]
    steps = np.frombuffer(raw, np.uint8, offset=9).reshape(planes, -1)
    out = np.zeros((steps.shape[1] + 1, 8), np.uint8)
    out[1:, :planes] = steps.T
    out[0] = np.frombuffer(raw, np.uint8, 8)
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=np.uint64)


def squeeze(a: np.ndarray) -> bytes:
    """Bits (of a bool array) or numbers, compressed."""
    raw = np.packbits(a).tobytes() if a.dtype == bool else a.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(len(a).to_bytes(8, "little") + raw)


def bits_of(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def candidates(t: Texts, shared: np.ndarray, length: int) -> np.ndarray:
    """The starts within reach of a shared cover place that have ``length`` bytes in their document."""
    n = len(t.data)
    turn = np.zeros(n + 1, np.int32)
    owner = np.searchsorted(t.ends, shared, side="right")
    np.add.at(turn, np.maximum(shared - (MODULUS - 1), t.starts[owner]), 1)
    np.add.at(turn, shared + 1, -1)
    on = np.cumsum(turn[:n]) > 0
    for b in t.ends.tolist():
        on[max(b - length + 1, 0) : b] = False
    return on


def classes(t: Texts, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal suffixes of a batch: fingerprints of the classes, the first member (in the lowest document) of each, and
    the class of every candidate."""
    h = t.strong_prints(at, length)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    first = order[new]
    return h[first], first, of


def removed(t: Texts, at: np.ndarray, gone: np.ndarray, length: int) -> pd.DataFrame:
    """A row a document: bytes, removed bytes, maximal removed runs and the digest of what is kept."""
    turn = np.zeros(len(t.data) + 1, np.int32)
    starts = at[gone]
    np.add.at(turn, starts, 1)
    np.add.at(turn, starts + length, -1)
    off = np.cumsum(turn[:-1]) > 0
    out = []
    for k, a, b in zip(t.keys.tolist(), t.starts.tolist(), t.ends.tolist(), strict=True):
        m = off[a:b]
        runs = int(m[0]) + int((m[1:] & ~m[:-1]).sum()) if len(m) else 0
        out.append((k, b - a, int(m.sum()), runs, hashlib.sha256(t.data[a:b][~m].tobytes()).hexdigest()))
    return pd.DataFrame(out, columns=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept_sha256`` of every row: what is left of its UTF-8 bytes after each byte
    covered by a ``length``-byte string that also starts in a row of lower key is removed.

    Rows with the text of a lower key go whole (if they have ``length`` bytes), without being compared; so a text that a
    third of all rows has is one row to the passes. Of equal suffixes of a batch one goes to the bucket, so a passage
    that most documents have is one record a batch. Null texts count as empty; rows that repeat a key do not remove one
    another; keys are integers, and a null key is below every other. Other columns are not read. Work and memory of a task are those of a batch (about 4 MB of
    text, or one text that is longer) or a bucket (about 4 million places)."""
    if length < MODULUS + 8:
        raise ValueError(f"length must be at least {MODULUS + 8}")
    depth = length - MODULUS + 1
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(long_key(key).alias("doc"), t.alias("text"), F.sha2(t.cast("binary"), 256).alias("sha"))
    total = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    n_batches = pieces(total, BATCH_BYTES)
    n_places = pieces(total * len(COVER) // MODULUS, BUCKET_PLACES)
    n_suffixes = pieces(total, 2 * BUCKET_PLACES)
    # keys that cut the documents into ranges of about equal number: one a batch, so a few bytes for each 4 MB of text
    cuts = docs.agg(F.percentile_approx(long_key(key), [i / n_batches for i in range(1, n_batches)], 100 * n_batches)).first()[0] if n_batches > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    bits = 31 + n_places.bit_length()

    @F.pandas_udf("int")
    def batch_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="left").astype(np.int32))

    same = rows.groupBy("sha").agg(F.min("doc").alias("least"))
    ids = rows.select("doc", "sha", F.octet_length("text").cast("long").alias("n_bytes"))
    ids = ids.join(same, "sha")
    copies = ids.where("doc <> least").select(
        given_key(F.col("doc")).alias(key), "n_bytes",
        F.when(F.col("n_bytes") >= length, F.col("n_bytes")).otherwise(F.lit(0).cast("long")).alias("n_removed"),
        F.when(F.col("n_bytes") >= length, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")).alias("n_spans"),
        F.when(F.col("n_bytes") >= length, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    firsts = same.select(F.col("least").alias("doc"), "sha").withColumn("batch", batch_of("doc"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, texts = pdf["doc"].to_numpy(), utf8(pdf["text"])
            at = np.searchsorted(bounds, keys, side="left")
            order = np.argsort(at, kind="stable")
            out = []
            for group in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                group = group.tolist()
                for part in in_slices([texts[i] for i in group], BATCH_BYTES):
                    mine = group[part]
                    out.append((int(at[mine[0]]), packed(keys[mine].tolist(), [texts[i] for i in mine])))
            yield pd.DataFrame(out, columns=["batch", "blob"])

    texts = rows.select("doc", "text").mapInPandas(pack, "batch int, blob binary")

    def cover_ranks(own: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cover places in order of their fingerprints, those, and where buckets begin."""
        at = own.cover(depth)
        h = own.prints(at, depth) >> np.uint64(64 - bits)
        order = np.argsort(h)
        return at[order], h[order], bucket_starts(h[order], bits, n_places)

    def places(key_: tuple, pdf: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        every = Texts(pdf["blob"].tolist())
        wanted = set(zip(first["doc"].tolist(), first["sha"].tolist(), strict=True))
        keep = np.array([(k, hashlib.sha256(x).hexdigest()) in wanted for k, x in every.all], bool)
        own = every if keep.all() else Texts(pdf["blob"].tolist(), keep)
        _, h, begin = cover_ranks(own)
        out = [(int(b), key_[0], PLACES, squeeze_sorted(h[begin[b] : begin[b + 1]])) for b in np.flatnonzero(np.diff(begin))]
        out.append((key_[0] % n_places, key_[0], WHO, squeeze(keep)))
        return pd.DataFrame(out, columns=["bucket", "batch", "kind", "blob"])

    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        """Answers each batch's cover places of one bucket with whether their rank is shared."""
        own = pdf[pdf["kind"] == PLACES]
        parts = [sorted_of(b) for b in own["blob"]]
        out = pdf[pdf["kind"] == WHO].to_dict("records")
        if parts:
            ordered = np.sort(np.concatenate(parts))
            again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
            for b, k, x in zip(own["bucket"], own["batch"], parts, strict=True):
                at = np.minimum(np.searchsorted(again, x), max(len(again) - 1, 0))
                out.append({"bucket": b, "batch": k, "kind": PLACES, "blob": squeeze(again[at] == x if len(again) else np.zeros(len(x), bool))})
        return pd.DataFrame(out, columns=["bucket", "batch", "kind", "blob"])

    def suffixes(key_: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        blobs = {(k, b): x for k, b, x in zip(answers["kind"], answers["bucket"], answers["blob"], strict=True)}
        who = next(x for (k, _), x in blobs.items() if k == WHO)
        own = Texts(pdf["blob"].tolist(), bits_of(who))
        at, _, begin = cover_ranks(own)
        shared = np.zeros(len(at), bool)
        for b in np.flatnonzero(np.diff(begin)):
            shared[begin[b] : begin[b + 1]] = bits_of(blobs[PLACES, b])
        on = candidates(own, at[shared], length)
        prints, _, _ = classes(own, np.flatnonzero(on), length)
        begin = bucket_starts(prints, 64, n_suffixes)
        out = [(key_[0] % n_suffixes, key_[0], WHO, who), (key_[0] % n_suffixes, key_[0], WHERE, squeeze(on))]
        out += [(int(b), key_[0], SUFFIXES, squeeze_sorted(prints[begin[b] : begin[b + 1]])) for b in np.flatnonzero(np.diff(begin))]
        return pd.DataFrame(out, columns=["bucket", "batch", "kind", "blob"])

    def sorted_suffixes(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sorts the suffixes of one bucket and answers each batch with which of its own a lower batch has."""
        own = pdf[pdf["kind"] == SUFFIXES].sort_values("batch")
        out = pdf[pdf["kind"] != SUFFIXES].to_dict("records")
        parts = [sorted_of(b) for b in own["blob"]]
        if parts:
            h = np.concatenate(parts)
            # stable, so of equal suffixes that of the lowest batch comes first
            order = np.argsort(h, kind="stable")
            lower = np.empty(len(h), bool)
            lower[order] = np.concatenate([[False], h[order][1:] == h[order][:-1]])
            for b, x, part in zip(own["bucket"], own["batch"], np.split(lower, np.cumsum([len(p) for p in parts])[:-1]), strict=True):
                out.append({"bucket": b, "batch": x, "kind": SUFFIXES, "blob": squeeze(part)})
        return pd.DataFrame(out, columns=["bucket", "batch", "kind", "blob"])

    def cut(_: tuple, pdf: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        blobs = {(k, b): x for k, b, x in zip(answers["kind"], answers["bucket"], answers["blob"], strict=True)}
        pick = lambda kind: next(x for (k, _), x in blobs.items() if k == kind)
        own = Texts(pdf["blob"].tolist(), bits_of(pick(WHO)))
        starts = np.flatnonzero(bits_of(pick(WHERE)))
        prints, first, of = classes(own, starts, length)
        doc = np.searchsorted(own.ends, starts, side="right")
        begin = bucket_starts(prints, 64, n_suffixes)
        below = np.zeros(len(prints), bool)
        for b in np.flatnonzero(np.diff(begin)):
            below[begin[b] : begin[b + 1]] = bits_of(blobs[SUFFIXES, b])
        gone = below[of] | (own.keys[doc] > own.keys[doc[first]][of]) if len(starts) else np.zeros(0, bool)
        return removed(own, starts, gone, length)

    # more tasks than the session's number where the input asks for them: a few batches, and a few buckets, each
    usual = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(table: DataFrame, by: str, n: int) -> DataFrame:
        return table.repartition(pieces(n, 4), by) if pieces(n, 4) > usual else table

    together = spread(texts, "batch", n_batches).groupBy("batch")
    first_pass = together.cogroup(firsts.groupBy("batch")).applyInPandas(places, SCHEMA)
    shared = spread(first_pass, "bucket", n_places).groupBy("bucket").applyInPandas(ranked, SCHEMA)
    second_pass = together.cogroup(shared.groupBy("batch")).applyInPandas(suffixes, SCHEMA)
    lower = spread(second_pass, "bucket", n_suffixes).groupBy("bucket").applyInPandas(sorted_suffixes, SCHEMA)
    whole = together.cogroup(lower.groupBy("batch")).applyInPandas(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return whole.select(given_key(F.col("doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept_sha256").union(copies)
