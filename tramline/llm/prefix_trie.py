"""Shared beginnings of conversations as a trie, with totals of every subtree by centroid decomposition."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.llm.common import pieces, written
from tramline.llm.numbering import numbered

#: Components of at most so many nodes are split to the end in one task; larger ones go through distributed rounds.
MOST_NODES = 4096
#: Nodes that a task takes, in components of at most ``MOST_NODES``.
PACK = 1 << 13
#: Turns of a conversation, and conversation numbers, that one window or list holds.
RUN = 1024


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, d1, d2, bytes``: the turns of each conversation from 1 on, by turn (null first), role and text, each as
    128 bits of a digest of role and text. Null roles and texts are empty. Rows without a conversation are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    bare = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.xxhash64(F.lit(1), role, text).alias("d1"),
        F.xxhash64(F.lit(2), text, role).alias("d2"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    out = numbered(bare, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()], "turns", without=("turn", "role", "text"))
    return out.select("conv_id", (F.col("pos") + 1).alias("pos"), "d1", "d2", "bytes")


def rebuilt(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another: ``(c, d, d1, d2, bytes)`` of every rebuilt turn and
    ``(c, length)`` of every conversation, turnless ones included. ``turns`` is as ``ordered_turns`` gives them."""
    lengths = turns.groupBy(F.col("conv_id").alias("c")).agg(F.max("pos").alias("n"))
    head = F.crc32(F.col("c").cast("string").cast("binary")) % most
    plan = lengths.select("c", "n", (F.col("c") - F.col("c") % every).alias("b"), head.alias("h"))
    plan = plan.join(lengths.select(F.col("c").alias("b"), F.col("n").alias("of_b")), "b", "left").withColumn("taken", F.least("h", F.coalesce("of_b", F.lit(0))))
    plan = written(plan.select("c", "b", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "rebuilt")
    # a base lends its first turns to at most ``every`` conversations
    lent = turns.where(F.col("pos") < most).select(F.col("conv_id").alias("b"), "pos", "d1", "d2", "bytes")
    first = plan.join(lent, "b").where("pos <= taken").select("c", F.col("pos").alias("d"), "d1", "d2", "bytes")
    rest = turns.withColumnRenamed("conv_id", "c").join(plan, "c").where("pos > h").select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "d1", "d2", "bytes")
    return first.unionByName(rest), plan.select("c", "length")


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``p1, p2``: 128 bits that name the sequence of the first d turns. They are the exclusive or of digests
    of (place, turn), so they are carried from run to run of a long conversation and no conversation is one task's."""
    keyed = turns.withColumn("p1", F.xxhash64("d", "d1", "d2")).withColumn("p2", F.xxhash64("d2", "d1", F.lit(7), "d")).withColumn("run", F.floor((F.col("d") - 1) / RUN)).drop("d1", "d2")
    before = Window.partitionBy("c").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = keyed.where("d > 0").groupBy("c", "run").agg(F.bit_xor("p1").alias("q1"), F.bit_xor("p2").alias("q2"))
    carried = carried.select("c", "run", *[F.coalesce(F.bit_xor(q).over(before), F.lit(0).cast("long")).alias(q) for q in ("q1", "q2")]).where("run > 0")
    inside = Window.partitionBy("c", "run").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    out = keyed.select("c", "d", "run", "bytes", *[F.bit_xor(p).over(inside).alias(p) for p in ("p1", "p2")], F.col("p1").alias("own1"), F.col("p2").alias("own2"))
    out = out.join(carried, ["c", "run"], "left")
    out = out.select("c", "d", "bytes", "own1", "own2", *[F.col(f"p{i}").bitwiseXOR(F.coalesce(F.col(f"q{i}"), F.lit(0).cast("long"))).alias(f"p{i}") for i in (1, 2)])
    return out.select("c", "d", "bytes", "p1", "p2", F.col("p1").bitwiseXOR(F.col("own1")).alias("u1"), F.col("p2").bitwiseXOR(F.col("own2")).alias("u2"))


def trie(rows: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes(conv_id, depth, parent, n_convs, bytes, n_children, weight)`` and ``of(c, d, node, parent)``, the node that the
    first d turns of conversation c are, by the least conversation of node and parent.

    ``weight`` counts the turns of members from the node on: the sum of ``n_convs`` over its subtree, known from the members
    alone. It is what the centroids balance."""
    told = written(rows.join(lengths, "c").withColumn("left", F.col("length") - F.col("d") + 1).drop("length"), "told")
    named = told.groupBy("d", "p1", "p2").agg(F.min("c").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("u1").alias("u1"), F.first("u2").alias("u2"), F.sum("left").alias("weight"))
    named = written(named, "named")
    root = lengths.agg(F.min("c").alias("node"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("length") + 1).alias("weight")).where("node is not null")
    above = named.select((F.col("d") + 1).alias("d"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("node").alias("parent"))
    above = above.union(root.select(F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long"), "node"))
    inner = named.join(above, ["d", "u1", "u2"]).select(F.col("node").alias("conv_id"), F.col("d").alias("depth"), "parent", "n_convs", "bytes", "weight", "p1", "p2")
    zero = F.lit(0).cast("long")
    top = root.select(F.col("node").alias("conv_id"), zero.alias("depth"), F.lit(None).cast("long").alias("parent"), "n_convs", zero.alias("bytes"), "weight", zero.alias("p1"), zero.alias("p2"))
    nodes = written(top.unionByName(inner), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    out = nodes.join(children, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent", "n_convs", "bytes", F.coalesce("n_children", zero).alias("n_children"), "weight")
    of = told.select("c", "d", "p1", "p2").join(nodes.select(F.col("depth").alias("d"), "p1", "p2", F.col("conv_id").alias("node"), "parent"), ["d", "p1", "p2"]).select("c", "d", "node", "parent")
    return out, of


def rolled(depth: np.ndarray, parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """[node, measure] the sums of ``values`` over subtrees of a forest, by centroid decomposition.

    Nodes stand by ascending depth; ``parent`` is a place, -1 at the top of a tree; ``weight`` sums a positive weight over the
    subtree. In each round every component has its centroid, the deepest node that holds half of its weight. The
    centroid takes the total of what hangs below it, the nodes on the path from it up to the component's top take the total
    of its part, and the component falls apart into the part above and one for each child: no more than the logarithm of the
    weight in rounds, however deep a tree is."""
    n = len(depth)
    # places in a walk from top to bottom: a node's subtree is a run of them
    size = np.ones(n, np.int64)
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order])) + 1
    levels = np.split(order, cuts)
    for level in levels[::-1]:
        inner = level[parent[level] >= 0]
        np.add.at(size, parent[inner], size[inner])
    first = np.zeros(n, np.int64)
    at = 0
    for t in np.flatnonzero(parent < 0).tolist():
        first[t] = at
        at += size[t]
    for level in levels:
        level = level[parent[level] >= 0]
        if not len(level):
            continue
        level = level[np.argsort(parent[level], kind="stable")]
        s = np.cumsum(size[level]) - size[level]
        head = np.concatenate([[True], np.diff(parent[level]) != 0])
        first[level] = first[parent[level]] + 1 + s - s[np.maximum.accumulate(np.where(head, np.arange(len(level)), 0))]
    last = first + size
    out, weight = values.copy(), weight.copy()
    top = np.arange(n)  # the top of each node's component
    for v in levels:
        inner = v[parent[v] >= 0]
        top[inner] = top[parent[inner]]
    alive = np.arange(n)  # by depth, so that the deepest candidate is written last
    alive = order[np.isin(order, alive)]
    centre = np.zeros(n, np.int64)
    while len(alive):
        half = alive[2 * weight[alive] >= weight[top[alive]]]
        centre[top[half]] = half
        g = centre[top[alive]]
        below = (first[alive] > first[g]) & (first[alive] < last[g])
        above = (first[alive] < first[g]) & (first[g] < last[alive])
        down, up = alive[below], alive[above]
        total = np.zeros_like(out)
        np.add.at(total, g[below], values[down])
        found = np.unique(g)
        out[found] += total[found]
        out[up] += (total + values)[g[above]]
        weight[up] -= weight[g[above]]
        # the child of the centroid that a node below it hangs on
        tops = alive[below & (parent[alive] == g)]
        key = parent[tops] * (n + 1) + first[tops]
        by = np.argsort(key)
        top[down] = tops[by][np.searchsorted(key[by], g[below] * (n + 1) + first[down], side="right") - 1]
        alive = alive[alive != g]
    return out


def round_of(parts: DataFrame, of: DataFrame, measures: list[str]) -> DataFrame:
    """One distributed round of ``rolled`` over components too large for a task. ``parts`` has ``conv_id, depth, parent,
    weight``, the component (``top_conv, top_depth``), the measures as given and as summed so far (``sum_`` before)."""
    comp = ["top_conv", "top_depth"]
    totals = parts.groupBy(*comp).agg(F.max("weight").alias("whole"))
    centre = (
        parts.join(totals, comp)
        .where("2 * weight >= whole")
        .groupBy(*comp)
        .agg(F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("g"))
        .select(*comp, F.col("g.conv_id").alias("g_conv"), F.col("g.depth").alias("g_depth"), F.col("g.weight").alias("g_weight"))
    )
    centre = written(centre, "centroids")
    # the path from each centroid to its top: nodes that its conversation's beginnings are
    path = of.join(centre.withColumnRenamed("g_conv", "c"), "c").where("d < g_depth and d >= top_depth").select(F.col("node").alias("conv_id"), F.col("d").alias("depth"), F.lit(True).alias("above"))
    root = centre.where("top_depth = 0 and g_depth > 0").select(F.col("top_conv").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(True).alias("above"))
    with_centre = parts.join(centre, comp)
    # what hangs below it: the beginning of one turn more is a child of the centroid
    child = of.select(F.col("c").alias("conv_id"), F.col("d").alias("child_depth"), F.col("node").alias("child"), F.col("parent").alias("child_parent"))
    under = with_centre.where("depth > g_depth").withColumn("child_depth", F.col("g_depth") + 1).join(child, ["conv_id", "child_depth"]).where("child_parent = g_conv").select("conv_id", "depth", "child")
    seen = written(with_centre.join(path.unionByName(root), ["conv_id", "depth"], "left").join(under, ["conv_id", "depth"], "left"), "split")
    is_centre = (F.col("conv_id") == F.col("g_conv")) & (F.col("depth") == F.col("g_depth"))
    held = seen.where(F.col("child").isNotNull() | is_centre).groupBy(*comp).agg(*[F.sum(m).alias(f"part_{m}") for m in measures])
    joined = seen.join(held, comp)
    add = lambda m: F.when(is_centre, F.col(f"part_{m}") - F.col(m)).when(F.col("above"), F.col(f"part_{m}")).otherwise(0)
    hung = F.col("child").isNotNull()
    done = joined.select(
        "conv_id",
        "depth",
        "parent",
        F.when(F.col("above"), F.col("weight") - F.col("g_weight")).otherwise(F.col("weight")).alias("weight"),
        F.when(is_centre, None).when(hung, F.col("child")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(is_centre, None).when(hung, F.col("g_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        *measures,
        *[(F.col(f"sum_{m}") + add(m)).alias(f"sum_{m}") for m in measures],
    )
    return written(done, "round")


def root_of(nodes: DataFrame) -> int | None:
    found = nodes.where("depth = 0").first()
    return None if found is None else found["conv_id"]


def subtree_sums(nodes: DataFrame, of: DataFrame, measures: list[str]) -> DataFrame:
    """``conv_id, depth`` and ``sum_<measure>`` (long) of every node's subtree, itself included.

    Components of more than ``MOST_NODES`` nodes are split at their centroids by rounds over the whole table; those of
    fewer are finished in tasks of about ``PACK`` nodes, so no task holds a large tree and the rounds are few: the root
    of a trie of many conversations falls apart at once. Rounds are at most the logarithm of the turns."""
    names = [f"sum_{m}" for m in measures]
    state = ["conv_id", "depth", "parent", "weight", "top_conv", "top_depth", *measures, *names]
    # at first the root's component is the whole trie
    start = {"top_conv": F.lit(root_of(nodes)).cast("long"), "top_depth": F.lit(0).cast("long")}
    parts = nodes.withColumns(start | {f"sum_{m}": F.col(m) for m in measures}).select(*state)
    done, ready = [], []
    while True:
        sizes = parts.groupBy("top_conv", "top_depth").agg(F.count(F.lit(1)).alias("nodes"))
        large = sizes.where(F.col("nodes") > MOST_NODES)
        if large.isEmpty():
            ready.append(parts)
            break
        ready.append(parts.join(large, ["top_conv", "top_depth"], "left_anti").select(*state))
        split = round_of(parts.join(large.drop("nodes"), ["top_conv", "top_depth"], "left_semi").select(*state), of, measures)
        done.append(split.where("top_conv is null").select("conv_id", "depth", *names))
        parts = split.where("top_conv is not null").select(*state)
    rest = ready[0]
    for more in ready[1:]:
        rest = rest.unionByName(more)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("depth", kind="stable").reset_index(drop=True)
        is_top = (pdf["conv_id"] == pdf["top_conv"]) & (pdf["depth"] == pdf["top_depth"])
        place = pd.Series(np.arange(len(pdf)), index=pd.MultiIndex.from_frame(pdf[["conv_id", "depth"]]))
        up = pd.MultiIndex.from_arrays([pdf["parent"].fillna(-1).astype("int64"), pdf["depth"] - 1])
        parent = np.where(is_top, -1, place.reindex(up).fillna(-1).to_numpy().astype(np.int64))
        values = pdf[measures].to_numpy(np.int64)
        sums = rolled(pdf["depth"].to_numpy(np.int64), parent, pdf["weight"].to_numpy(np.int64), values)
        out = pdf[["conv_id", "depth"]].copy()
        for k, name in enumerate(names):
            out[name] = sums[:, k] - values[:, k] + pdf[name].to_numpy(np.int64)
        return out

    packs = pieces(nodes.count(), PACK)
    kinds = ", ".join(f"{name} long" for name in names)
    out = rest.groupBy(F.pmod(F.xxhash64("top_conv", "top_depth"), F.lit(packs)).alias("pack")).applyInPandas(finish, f"conv_id long, depth long, {kinds}")
    for more in done:
        out = out.unionByName(more)
    return out


def end_digests(of: DataFrame, lengths: DataFrame, root: int | None) -> DataFrame:
    """``conv_id, depth, ends_sha256`` of the nodes at which a conversation ends: SHA-256 of their numbers in decimal, ascending, joined
    by commas. Numbers are joined in runs of ``RUN`` first; the runs of a node pass through its digest in order, one at a
    time, so a node at which a third of all conversations end needs no memory for them."""
    ends = lengths.join(of.select("c", F.col("d").alias("length"), "node"), ["c", "length"], "left")
    run = ends.groupBy("node", "length", F.floor(F.col("c") / RUN).alias("run")).agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("c")), lambda c: c.cast("string"))).alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, hashlib.sha256()
        for pdf in batches:
            found = []
            for node, depth, ids in zip(pdf["node"].tolist(), pdf["length"].tolist(), pdf["ids"].tolist(), strict=True):
                if (node, depth) != now:
                    if now is not None:
                        found.append((*now, state.hexdigest()))
                    now, state = (node, depth), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pd.DataFrame(found, columns=["conv_id", "depth", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, state.hexdigest())], columns=["conv_id", "depth", "ends_sha256"])

    # turnless conversations end at the root
    placed = run.select(F.coalesce("node", F.lit(root).cast("long")).alias("node"), "length", "run", "ids")
    return placed.repartition("node", "length").sortWithinPartitions("node", "length", "run").mapInPandas(digest, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations, the textless root included: ``conv_id`` (least
    member), ``depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are read by turn (null first), equal turns by role and text. Null roles and texts are empty; rows without a
    ``conv_id`` belong to no conversation and are left out; repeated rows are repeated turns. A conversation of any length
    is spread by runs of turns. Other columns are not read. An empty table has no node."""
    lent, lengths = rebuilt(ordered_turns(conversations.select("conv_id", "turn", "role", "text")))
    nodes, of = trie(prefixes(lent), lengths)
    of = written(of, "members")
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    nodes = written(nodes.withColumn("leaves", leaf).withColumn("saved", saved), "trie")
    sums = subtree_sums(nodes, of, ["leaves", "saved"])
    nothing = hashlib.sha256().hexdigest()
    full = nodes.join(sums, ["conv_id", "depth"]).join(end_digests(of, lengths, root_of(nodes)), ["conv_id", "depth"], "left")
    return full.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )
