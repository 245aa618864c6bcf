"""Near-duplicate documents by MinHash bands, sequential Bayesian tests and exact checks; only components are asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import fresh, given_key, in_slices, long_key, pieces, utf8, written
from tramline.llm.components import components, hub_components
from tramline.llm.jaccard_join import STEP, VALUES, fewest_matches, signed, surviving, verified
from tramline.llm.merkle import LOWER, UPPER
from tramline.llm.shingles import shingle_sets

#: Members of a band that one task compares with as many others, and texts that a lead meets in one task.
CHUNK = 1024


def in_play(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Of rows of two signature arrays, the pairs that no batch of ``STEP`` values drops: after each, a pair goes when the
    posterior probability of a similarity at the threshold or above has fallen to the miss probability."""
    left, count = np.arange(len(a)), np.zeros(len(a), np.int64)
    for s, need in enumerate(least):
        count[left] += (a[left, s * STEP : (s + 1) * STEP] == b[left, s * STEP : (s + 1) * STEP]).sum(axis=1)
        left = left[count[left] >= need]
    return left


def as_array(sig: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sig), np.uint16).reshape(len(sig), VALUES)


def banded(classes: DataFrame) -> DataFrame:
    """``node, band, lead, n`` of the bands that ``n > 1`` of ``classes(node, bands)`` share.

    The lead of a band is its member that shares bands most often: the text from which others were made, where there is one."""
    each = classes.select("node", F.explode("bands").alias("band"))
    counts = each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(each.join(counts, "band"), "shared")
    meets = shared.groupBy("node").agg(F.sum(F.col("n") - 1).alias("meets"))
    leads = shared.join(meets, "node").groupBy("band").agg(F.max_by("node", F.struct("meets", -F.col("node"))).alias("lead"))
    return written(shared.join(leads, "band"), "members")


def star_links(members: DataFrame, classes: DataFrame, texts, words: int, least: list[int], threshold: float) -> DataFrame:
    """``node, lead``: the members linked to the lead of a band. Signatures are compared first; the texts of pairs left meet by
    lead, ``CHUNK`` members to a task, and each task streams them past the shingles of the lead."""
    pairs = members.where("node <> lead").select("node", "lead").distinct()
    sig = classes.select("node", "sig")
    pairs = pairs.join(sig, "node").join(sig.select(F.col("node").alias("lead"), F.col("sig").alias("lead_sig")), "lead")

    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[["node", "lead"]].iloc[in_play(as_array(pdf["sig"]), as_array(pdf["lead_sig"]), least)]

    left = written(pairs.mapInPandas(prune, "node long, lead long"), "stars")
    tasks = left.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("tasks"))
    to_member = left.join(tasks, "lead").select("node", "lead", F.pmod(F.xxhash64("node"), F.col("tasks")).cast("int").alias("part"))
    to_lead = tasks.select(F.col("lead").alias("node"), "lead", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"))
    visits = to_member.unionByName(to_lead).groupBy("node").agg(F.collect_list(F.struct("lead", "part")).alias("visits"))
    met = texts(visits).withColumn("visit", F.explode("visits")).select("node", "visit.lead", "visit.part", "text", (F.col("node") != F.col("visit.lead")).alias("later"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, of_lead = None, np.zeros(0, np.uint64)
        for pdf in batches:
            nodes, leads, parts, found = pdf["node"].tolist(), pdf["lead"].tolist(), pdf["part"].tolist(), []
            sets = shingle_sets(utf8(pdf["text"]), words)
            for node, lead, part, own in zip(nodes, leads, parts, sets, strict=True):
                if node == lead:
                    now, of_lead = (lead, part), own
                    continue
                assert now == (lead, part)  # the lead comes first
                both = len(np.intersect1d(own, of_lead, assume_unique=True))
                if both >= threshold * (len(own) + len(of_lead) - both) - 1e-9:
                    found.append((node, lead))
            yield pd.DataFrame(found, columns=["node", "lead"]).astype("int64")

    streamed = met.repartition("lead", "part").sortWithinPartitions("lead", "part", "later", "node")
    return written(streamed.mapInPandas(check, "node long, lead long"), "linked")


def open_blocks(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label, band, chunk, at``: where members of a band meet that the leads left in different components.

    Members of the lead's component (main) need not meet each other. A band of over ``CHUNK`` members is cut into chunks
    of main and of other ones, and each chunk of others meets each chunk: the tasks grow with the others times the band."""
    placed = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # two members have met already: one of them leads
    split = placed.where("n > 2").groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("node") == F.col("lead"), F.col("label"))).alias("main")).where("low <> high")
    placed = placed.join(split.select("band", "main"), "band").withColumn("other", F.col("label") != F.col("main"))
    sizes = placed.groupBy("band").agg(F.sum(F.col("other").cast("long")).alias("n_other"))
    placed = placed.join(sizes, "band")
    cut = lambda n: F.greatest(F.ceil(n / CHUNK).cast("int"), F.lit(1))
    others, mains = cut(F.col("n_other")), cut(F.col("n") - F.col("n_other"))
    at_other, at_main = (F.pmod(F.xxhash64("node"), k).cast("int") for k in (others, mains))
    each = lambda k, f: F.transform(F.sequence(F.lit(0), k - 1), f)
    name = lambda a, b: F.concat_ws(":", "band", a, b)
    of_other = F.concat(each(others, lambda j: name(F.least(at_other, j), F.greatest(at_other, j))), each(mains, lambda j: name(at_other, F.concat(F.lit("m"), j))))
    of_main = each(others, lambda j: name(j, F.concat(F.lit("m"), at_main)))
    small = F.array(name(F.lit("s"), F.lit("s")))
    where = F.when(F.col("n") <= CHUNK, small).when(F.col("other"), of_other).otherwise(of_main)
    side = F.when(F.col("n") <= CHUNK, F.lit(0)).when(F.col("other"), at_other).otherwise(-1 - at_main)
    return placed.select("node", "label", side.alias("chunk"), F.explode(where).alias("at"))


def sides(block: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The two chunks of a block, which are one and the same where it is a chunk with itself."""
    low, high = block["chunk"].min(), block["chunk"].max()
    # a chunk with itself has no other side: with both of one chunk all its members meet
    return (block, block) if low == high else (block[block["chunk"] == high], block[block["chunk"] == low])


def survivors(a: pd.DataFrame, b: pd.DataFrame, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of the pairs of different components that stay in play, 256 rows of ``a`` at a time."""
    sig_a, sig_b, label_a, label_b = as_array(a["sig"]), as_array(b["sig"]), a["label"].to_numpy(), b["label"].to_numpy()
    for begin in range(0, len(a), 256):
        i, j = surviving(sig_a[begin : begin + 256], sig_b, least)
        i += begin
        apart = label_a[i] != label_b[j]
        yield i[apart], j[apart]


def open_links(blocks: DataFrame, classes: DataFrame, texts, words: int, least: list[int], threshold: float, packs: int) -> DataFrame:
    """``a, b``: labels of components that a verified pair of a block links."""
    pack = F.pmod(F.xxhash64("at"), F.lit(packs)).alias("pack")

    def prune(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for _, block in pdf.groupby("at", sort=False):
            a, b = sides(block)
            hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
            for i, j in survivors(a, b, least):
                hit_a[i] = hit_b[j] = True
            kept += [a[hit_a | hit_b]] if a is b else [a[hit_a], b[hit_b]]
        return pd.concat(kept)

    met = blocks.join(classes.select("node", "sig"), "node").select("node", "label", "chunk", "at", "sig")
    left = written(met.groupBy(pack).applyInPandas(prune, "node long, label long, chunk long, at string, sig binary"), "open")
    visits = left.groupBy("node").agg(F.collect_list(F.struct("label", "chunk", "at", "sig")).alias("visits"))
    full = texts(visits).withColumn("v", F.explode("visits")).select("node", "v.label", "v.chunk", "v.at", "v.sig", "text")

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        found = set()
        for _, block in pdf.groupby("at", sort=False):
            a, b = sides(block)
            raw = utf8(block["text"])
            sets = dict(zip(block["node"].tolist(), (s for part in in_slices(raw, 1 << 19) for s in shingle_sets(raw[part], words)), strict=True))
            of_a, of_b = [sets[n] for n in a["node"]], [sets[n] for n in b["node"]]
            label_a, label_b = a["label"].to_numpy(), b["label"].to_numpy()
            for i, j in survivors(a, b, least):
                ok = verified(of_a, of_b, i, j, threshold)
                low, high = np.minimum(label_a[i[ok]], label_b[j[ok]]), np.maximum(label_a[i[ok]], label_b[j[ok]])
                found.update(zip(low.tolist(), high.tolist(), strict=True))
        return pd.DataFrame(sorted(found), columns=["a", "b"]).astype("int64")

    return full.groupBy(pack).applyInPandas(check, "a long, b long").distinct()


def mark(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.85, miss: float = 1e-9) -> DataFrame:
    """``key, n_shingles, component_id, kept``: the size of each row's set of ``words``-word shingles, the lowest key that links of
    similarity ``threshold`` or more reach from it, and whether that is its own.

    Words are lower-cased in A to Z. Rows with equal sets are one class. Classes that share one of 48 bands of 6 MinHash values are
    candidates (at 0.85 a pair shares none with a chance of 1.3e-10). Every member of a band is held against its lead, the
    member that meets most others: batches of 32 values, a pair goes when the posterior probability that its similarity
    reaches the threshold is under ``miss``, the rest are verified on whole sets. That joins copies of one text
    in linear work. Then only members of a band that are still in different components meet, in blocks, again by batches and
    verified on whole sets; pairs inside a component are not compared, since only components are asked for.

    A null or empty text, and one without words, has no shingles and is linked with nothing. Repeated rows are linked.
    Keys are integers; null is below every other. Other columns are not read. An empty table gives an empty result."""
    plain = F.translate(F.col(f"`{text}`"), UPPER, LOWER)
    own = docs.select(long_key(key).alias("key"), plain.alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = written(signed(own, words), "prints")
    classes = rows.groupBy("digest").agg(F.min(F.struct("key", "hash")).alias("first_row"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes.select("digest", "bands", "sig", F.col("first_row.key").alias("key"), F.col("first_row.hash").alias("hash"), F.monotonically_increasing_id().alias("node")), "classes")
    least = fewest_matches(threshold, miss)
    # rows alike in key and text fall together before they meet the classes, in the shuffle that the join needs anyway
    single = own.groupBy("key", "hash").agg(F.first("text").alias("text"))

    def texts(visits: DataFrame) -> DataFrame:
        return single.join(visits.join(classes.select("node", "key", "hash"), "node"), ["key", "hash"]).select("node", "visits", "text")

    members = banded(classes)
    linked = star_links(members, classes, texts, words, least, threshold)
    labels = hub_components(linked.select("node", F.col("lead").alias("hub")).union(linked.select("lead", F.col("lead").alias("hub"))))
    blocks = written(open_blocks(members, labels), "blocks")
    packs = pieces(blocks.count(), 4 * CHUNK)
    further = written(open_links(blocks, classes, texts, words, least, threshold, packs), "further")
    joined = components(further).select(F.col("node").alias("label"), F.col("label").alias("to"))
    placed = classes.select("digest", "node", "key").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")).join(joined, "label", "left").withColumn("label", F.coalesce("to", "label"))
    lowest = placed.groupBy("label").agg(F.min("key").alias("component_id"))
    of_class = placed.join(lowest, "label").select("digest", "component_id")
    worded = rows.select("key", "digest", "n_shingles").join(of_class, "digest").select("key", "n_shingles", "component_id")
    wordless = own.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("key", F.lit(0).cast("long").alias("n_shingles"), F.col("key").alias("component_id"))
    out = worded.unionByName(wordless)
    return out.select(given_key(F.col("key")).alias(key), "n_shingles", given_key(F.col("component_id")).alias("component_id"), (F.col("key") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows that ``mark`` does not keep; rows that repeat a key stay or go together."""
    name = fresh(docs, "_stay")
    stay = mark(docs, key, text, **kw).where("kept").select(F.col(key).alias(name)).distinct()
    return docs.join(stay, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(name)), "left_semi")
