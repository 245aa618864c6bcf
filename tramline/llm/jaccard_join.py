"""Near-duplicate documents: a Jaccard join on word shingles with Bayesian pruning of candidates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import fresh, given_key, in_slices, long_key, pieces, utf8, written
from tramline.llm.components import hub_components
from tramline.llm.shingles import mixed, shingle_sets

#: Bands of rows of MinHash values. Texts of similarity 0.8 miss each other in all bands with a chance of 5e-7.
BANDS, ROWS = 48, 6
VALUES = BANDS * ROWS
STEP = 32
SLICE = 1 << 19
#: Classes that one task compares with as many others.
CHUNK = 2048
#: A component of more chunks than this meets by bands: its chunks would be shipped more often than a class has bands.
MOST_CHUNKS = BANDS


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    seed = mixed(np.arange(1, 2 * VALUES + 1, dtype=np.uint64)).astype(np.uint32)
    return seed[:VALUES] | np.uint32(1), seed[VALUES:]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """[set, value] MinHash values of non-empty sets (uint32), a pass over a cached run of shingles for each value."""
    times, plus = multipliers()
    out = np.empty((len(sets), VALUES), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin + 1, len(sets[begin])
        while end < len(sets) and size + len(sets[end]) <= 1 << 15:
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[begin:end])
        low = (flat ^ flat >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *[len(s) for s in sets[begin : end - 1]]])
        for k in range(VALUES):
            h = low * times[k]
            h += plus[k]
            h ^= h >> np.uint32(15)
            out[begin:end, k] = np.minimum.reduceat(h, starts)
        begin = end
    return out


def fewest_matches(threshold: float, tolerance: float) -> list[int]:
    """For n = STEP, 2 STEP, .. compared values, the fewest equal ones with which a pair stays.

    With a flat prior on the similarity s, m equal of n make Beta(m + 1, n - m + 1) the posterior, and
    P(s >= t) = P(Binomial(n + 1, t) <= m). A pair goes when this is under ``tolerance``."""
    out = []
    for n in range(STEP, VALUES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return out


def surviving(a: np.ndarray, b: np.ndarray, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two signature arrays that no step drops. The first step is dense, later ones see what is left."""
    equal = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        equal += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(equal >= least[0])
    count = equal[i, j].astype(np.int16)
    for s, need in enumerate(least[1:], 1):
        if not len(i):
            break
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            count[part] += (a[i[part], s * STEP : (s + 1) * STEP] == b[j[part], s * STEP : (s + 1) * STEP]).sum(axis=1, dtype=np.int16)
            keep[part] = count[part] >= need
        i, j, count = i[keep], j[keep], count[keep]
    return i, j


def verified(sets_a: list[np.ndarray], sets_b: list[np.ndarray], i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the exact Jaccard similarity of each pair reaches the threshold.

    Few pairs are intersected one by one; many by products of incidence arrays over the shingles that stand in two sets
    or more, a slab of shingles at a time."""
    if not len(i):
        return np.zeros(0, bool)
    na, nb = np.array([len(s) for s in sets_a]), np.array([len(s) for s in sets_b])
    if len(i) < 4 * (len(sets_a) + len(sets_b)):
        both = np.array([len(np.intersect1d(sets_a[x], sets_b[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)])
    else:
        flat_a, flat_b = np.concatenate(sets_a), np.concatenate(sets_b)
        shared = np.intersect1d(flat_a, flat_b)
        row_a, row_b = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
        at_a, at_b = np.searchsorted(shared, flat_a), np.searchsorted(shared, flat_b)
        in_a = (at_a < len(shared)) & (shared[np.minimum(at_a, len(shared) - 1)] == flat_a) if len(shared) else np.zeros(len(flat_a), bool)
        in_b = (at_b < len(shared)) & (shared[np.minimum(at_b, len(shared) - 1)] == flat_b) if len(shared) else np.zeros(len(flat_b), bool)
        row_a, at_a, row_b, at_b = row_a[in_a], at_a[in_a], row_b[in_b], at_b[in_b]
        order_a, order_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
        row_a, at_a, row_b, at_b = row_a[order_a], at_a[order_a], row_b[order_b], at_b[order_b]
        dense = np.zeros((len(na), len(nb)), np.float32)
        for begin in range(0, len(shared), 1024):
            cut_a, cut_b = (slice(*np.searchsorted(at, [begin, begin + 1024])) for at in (at_a, at_b))
            x, y = np.zeros((len(na), 1024), np.float32), np.zeros((len(nb), 1024), np.float32)
            x[row_a[cut_a], at_a[cut_a] - begin] = 1
            y[row_b[cut_b], at_b[cut_b] - begin] = 1
            dense += x @ y.T
        both = dense[i, j].astype(np.int64)
    return both >= threshold * (na[i] + nb[j] - both) - 1e-9


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """[class, band] 64-bit hashes of the values (uint32) of each band and its place, by which classes meet."""
    out = np.full((len(sig), BANDS), 0, np.uint64)
    for r in range(ROWS):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r * BANDS : (r + 1) * BANDS] + np.arange(1, BANDS + 1, dtype=np.uint64))
    return out


def first_common_band(bands_a: np.ndarray, bands_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first band in which the hashes of each pair agree; ``BANDS`` where none does.

    These are the hashes by which classes meet. Stored signatures have 16 bits of each value and may agree in a band in
    which the pair does not meet."""
    out = np.full(len(i), BANDS, np.int64)
    for begin in range(0, len(i), 1 << 14):
        part = slice(begin, begin + (1 << 14))
        same = bands_a[i[part]] == bands_b[j[part]]
        out[part] = np.where(same.any(axis=1), same.argmax(axis=1), BANDS)
    return out


def links_of_block(a: pd.DataFrame, b: pd.DataFrame | None, least: list[int], threshold: float, band: int | None = None) -> pd.DataFrame:
    """``node, root, links`` of the classes of a block, or of two blocks with each other: rows linked counts the
    documents of linked classes, root is a class of the same component among the pairs seen here. If the block is one of
    a band, pairs that share an earlier band are left to that one."""
    other = a if b is None else b
    sig = lambda t: np.frombuffer(b"".join(t["sig"]), np.uint16).reshape(len(t), VALUES)
    sets = lambda t: [np.frombuffer(s, np.uint64) for s in t["shingles"]]
    bands = lambda t: np.stack(t["bands"].to_list())
    sig_a, sets_a = sig(a), sets(a)
    sig_b, sets_b = (sig_a, sets_a) if b is None else (sig(b), sets(b))
    n = len(a)
    first = 0 if b is None else n
    nodes = a["node"].to_numpy() if b is None else np.concatenate([a["node"].to_numpy(), b["node"].to_numpy()])
    links = np.zeros(len(nodes), np.int64)
    root = np.arange(len(nodes))
    size_a, size_b = a["size"].to_numpy(), other["size"].to_numpy()
    for begin in range(0, n, 256):  # rows at a time, so that the pairs in hand are bounded
        i, j = surviving(sig_a[begin : begin + 256], sig_b, least)
        i += begin
        if b is None:
            i, j = i[i < j], j[i < j]
        if band is not None:
            own = first_common_band(bands(a), bands(other), i, j) == band
            i, j = i[own], j[own]
        ok = verified(sets_a[begin : begin + 256], sets_b, i - begin, j, threshold)
        i, j = i[ok], j[ok]
        np.add.at(links, i, size_b[j])
        np.add.at(links, j + first, size_a[i])
        # union by lowest place, repeated until nothing changes
        u, v = i, j + first
        while len(u):
            ru, rv = root[u], root[v]
            apart = ru != rv
            if not apart.any():
                break
            low, high = np.minimum(ru, rv)[apart], np.maximum(ru, rv)[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
    return pd.DataFrame({"node": nodes, "root": nodes[root], "links": links})


def signed(docs: DataFrame, words: int) -> DataFrame:
    """``key, hash, digest, n_shingles, sig, bands`` of every row of ``docs(key, text, hash)`` with a word. The digest (16
    bytes) names the set of shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = utf8(pdf["text"])
            keys, hashes = pdf["key"].to_numpy(), pdf["hash"].to_numpy()
            for part in in_slices(texts, SLICE):
                sets = shingle_sets(texts[part], words)
                some = [k for k, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                sig = signatures([sets[k] for k in some])
                yield pd.DataFrame({
                    "key": keys[part][some],
                    "hash": hashes[part][some],
                    "digest": [hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest() for k in some],
                    "n_shingles": [len(sets[k]) for k in some],
                    "sig": [row.tobytes() for row in sig.astype(np.uint16)],
                    "bands": list(band_hashes(sig).view(np.int64)),
                })

    return docs.where(F.octet_length("text") > 0).mapInPandas(run, "key long, hash long, digest binary, n_shingles long, sig binary, bands array<long>")


def with_shingles(docs: DataFrame, words: int) -> DataFrame:
    """``docs(node, .., text)`` with the shingle set in place of the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = utf8(pdf["text"])
            sets = [s.tobytes() for part in in_slices(texts, SLICE) for s in shingle_sets(texts[part], words)]
            yield pdf.drop(columns="text").assign(shingles=sets)

    names = ", ".join(f"{c} {t}" for c, t in docs.drop("text").dtypes)
    return docs.mapInPandas(run, f"{names}, shingles binary")


def candidate_groups(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(node, label)`` of the classes that share a band of MinHash values with another, labelled by component; and
    ``(node, pos, band)`` of the shared bands.

    A band's lowest class stands for it as a hub. A class has at most ``BANDS`` of them, and only hubs that a class ties
    together go through the rounds of the components."""
    banded = classes.select("node", F.posexplode("bands").alias("pos", "band"))
    leads = banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).where("n > 1")
    shared = banded.join(leads, "band")
    return hub_components(shared.select("node", "hub")), shared.select("node", "pos", "band")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, tolerance: float = 1e-9) -> DataFrame:
    """``key, class_id, n_links``: every row with the lowest key of its group, and how many other rows it is linked to.

    Two rows are linked if the Jaccard similarity of their sets of ``words``-word shingles is at least ``threshold``;
    groups are the connected components of the links. Rows with equal sets are one class: they count in ``n_links`` but
    are compared once. Classes that share a band of MinHash values are candidates. Candidates that hang together are
    compared in blocks of ``CHUNK`` classes: MinHash values ``STEP`` at a time, a pair is dropped as soon as the posterior
    probability of reaching the threshold is under ``tolerance``, and what is left is verified on the whole sets. A group
    of any size is spread over tasks by pairs of blocks, and a block gives back counts and a spanning forest, not pairs.
    Where bands chain so many classes together that pairs of blocks would ship each over ``BANDS`` times, classes meet by
    the bands they share instead, and a pair counts at the first band that it has in common.

    A null or empty text, and one without words, is alone with 0 links. Repeated rows are linked to one another. Keys
    are integers; a null key is below every other (and so a class_id may be null). Other columns are not read. An empty
    table gives an empty result."""
    own = docs.select(long_key(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))
    rows = written(signed(own, words), "signatures")
    classes = rows.groupBy("digest").agg(F.min(F.struct("key", "hash")).alias("first_row"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # numbers given once and written: no two classes share one, as parts of a digest might
    classes = written(classes.select("*", F.col("first_row.key").alias("least"), F.col("first_row.hash").alias("hash"), F.monotonically_increasing_id().alias("node")).drop("first_row"), "classes")
    together, shared = candidate_groups(classes)
    together = written(together, "candidates")
    sizes = together.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    members = (
        together.join(sizes, "label")
        .join(classes.select("node", "size", "sig", "least", "hash"), "node")
        .select("node", "label", "size", "sig", "least", "hash", chunks.alias("chunks"), F.pmod(F.xxhash64("node"), chunks).cast("int").alias("chunk"))
    )
    packs = pieces(classes.count(), CHUNK)
    # a class is compared by the text of its first row
    sets = with_shingles(members.join(own.withColumnRenamed("key", "least"), ["least", "hash"]).drop("least", "hash"), words)
    # small groups share a task; of a large one each pair of chunks is a task; of a huge one each pair of chunks of a band
    small = sets.where("chunks = 1").withColumn("at", F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("label"), F.lit(packs))))
    large = sets.where(f"chunks > 1 and chunks <= {MOST_CHUNKS}").withColumn("at", F.explode(chunk_pairs(F.col("label"), F.col("chunks"), F.col("chunk"))))
    blocks = small.unionByName(large)
    if (sizes.agg(F.max("n")).first()[0] or 0) > CHUNK * MOST_CHUNKS:
        huge_bands = shared.join(members.where(f"chunks > {MOST_CHUNKS}").select("node"), "node")
        parts = huge_bands.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("parts"))
        huge = (
            sets.where(f"chunks > {MOST_CHUNKS}")
            .join(huge_bands.join(parts, "band"), "node")
            .withColumn("chunks", F.col("parts"))
            .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
            .withColumn("label", F.col("band"))
            .withColumn("at", F.explode(chunk_pairs(F.concat_ws(":", F.lit("b"), F.col("pos"), F.col("band")), F.col("chunks"), F.col("chunk"))))
            .drop("pos", "band", "parts")
            .join(classes.select("node", "bands"), "node")
        )
        blocks = blocks.unionByName(huge, allowMissingColumns=True)
    least = fewest_matches(threshold, tolerance)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        # a node may come twice where whole rows repeat
        pdf = pdf.drop_duplicates("node").sort_values("node")
        found = []
        for _, group in pdf.groupby("label", sort=False):
            at = group["at"].iloc[0].split(":")
            band = int(at[1]) if at[0] == "b" else None
            if at[0] == "s" or at[-2] == at[-1]:
                found.append(links_of_block(group, None, least, threshold, band))
            else:
                a, *rest = (x for _, x in group.groupby("chunk"))
                if rest:
                    found.append(links_of_block(a, rest[0], least, threshold, band))
        return pd.concat(found) if found else pd.DataFrame({"node": [], "root": [], "links": []}).astype("int64")

    links = written(blocks.groupBy("at").applyInPandas(compare, "node long, root long, links long"), "links")
    groups = hub_components(links.select("node", F.col("root").alias("hub")))
    per_class = (
        classes.select("node", "digest", "least", "size")
        .join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
        .join(groups, "node", "left")
        .withColumn("label", F.coalesce("label", "node"))
    )
    lowest = per_class.groupBy("label").agg(F.min("least").alias("class_id"))
    of_class = per_class.join(lowest, "label").select("digest", "class_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    worded = rows.select("key", "digest").join(of_class, "digest").select("key", "class_id", "n_links")
    wordless = own.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("key", F.col("key").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return worded.union(wordless).select(given_key(F.col("key")).alias(key), given_key(F.col("class_id")).alias("class_id"), "n_links")


def chunk_pairs(name: Column, chunks: Column, chunk: Column) -> Column:
    """The tasks in which a chunk meets each of its group's chunks, itself included."""
    return F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.concat_ws(":", name, F.least(chunk, j), F.greatest(chunk, j)))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that have a near duplicate of lower key in their group. Rows that repeat a key stay or
    go together; a null key is below every other."""
    name = fresh(docs, "_stay")
    stay = near_duplicates(docs, key, text, **kw).where(F.col(key).eqNullSafe(F.col("class_id"))).select(F.col(key).alias(name)).distinct()
    return docs.join(stay, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(name)), "left_semi")
