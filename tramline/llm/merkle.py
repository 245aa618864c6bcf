"""A Merkle manifest of a dataset: digests of rows, a tree over them, and proofs that are fetched once for each partition."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import written
from tramline.llm.numbering import numbered

#: Children of a node.
FAN = 8
#: Levels that one task builds: it has ``FAN ** STEP`` consecutive nodes of a level, 4,096.
STEP = 4
#: The tree over the trees.
TOP = -1

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def of_run(nodes: Iterable[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Nodes at each level of a tree over ``n`` leaves, up to its root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def missing(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The fewest nodes, as (level, place), that with the leaves at ``places`` give the root of a tree over ``n``: at each
    level those of the runs touched that are neither leaves at hand nor above some."""
    out = []
    known = np.unique(places)
    for level, width in enumerate(widths(n)[:-1]):
        runs = np.unique(known // FAN)
        all_of = (runs[:, None] * FAN + np.arange(FAN)).ravel()
        need = np.setdiff1d(all_of[all_of < width], known, assume_unique=True)
        out += [(level, int(i)) for i in need]
        known = runs
    return out


def interiors(leaves: dict[int, str], fetched: dict[tuple[int, int], str], n: int) -> list[dict[int, str]]:
    """The nodes of every level that the leaves at hand and the fetched nodes give, root included."""
    levels = [dict(leaves)]
    for level, width in enumerate(widths(n)[:-1]):
        now = levels[-1]
        now.update((i, h) for (at, i), h in fetched.items() if at == level)
        levels.append({run: of_run(now[i] for i in range(run * FAN, min(run * FAN + FAN, width))) for run in {i // FAN for i in now}})
    return levels


def siblings(levels: list[dict[int, str]], place: int, n: int) -> list[list[str]]:
    """The proof of the leaf at ``place``: at each level the others of its run, from left to right."""
    out = []
    for now, width in zip(levels, widths(n)[:-1], strict=False):
        begin = place // FAN * FAN
        out.append([now[i] for i in range(begin, min(begin + FAN, width)) if i != place])
        place //= FAN
    return out


def folded(leaf: str, place: int, proof: list[list[str]]) -> str:
    """The root that a leaf and its proof give."""
    for others in proof:
        at = place % FAN
        leaf = of_run([*others[:at], leaf, *others[at:]])
        place //= FAN
    return leaf


def build(leaves: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """``nodes(tree, level, place, hash)`` of every tree, leaves left out, and ``roots(tree, n, hash)``. ``leaves`` has ``tree,
    place, n, hash`` (n: leaves of the tree).

    A task builds the ``STEP`` levels over 4,096 consecutive nodes, so a tree of any size is many tasks and the rounds
    are the logarithm of its size to the base 4,096."""

    def climb(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        tree, n, level = (int(pdf[c].iloc[0]) for c in ("tree", "n", "level"))
        total = widths(n)
        now, places, rows = pdf["hash"].tolist(), pdf["place"].tolist(), []
        for up in range(level + 1, min(level + STEP, len(total) - 1) + 1):
            now = [of_run(now[i : i + FAN]) for i in range(0, len(now), FAN)]
            places = [p // FAN for p in places[::FAN]]
            rows += [(tree, n, up, p, h, up == len(total) - 1, up == level + STEP and up < len(total) - 1) for p, h in zip(places, now, strict=True)]
        return pd.DataFrame(rows, columns=["tree", "n", "level", "place", "hash", "is_root", "open"])

    kinds = "tree long, n long, level long, place long, hash string, is_root boolean, open boolean"
    now = leaves.select("tree", "place", "n", "hash", F.lit(0).cast("long").alias("level"))
    nodes, roots = [], [now.where("n = 1").select("tree", "n", "hash")]
    now = now.where("n > 1")
    while True:
        made = written(now.groupBy("tree", F.floor(F.col("place") / FAN**STEP)).applyInPandas(climb, kinds), name)
        nodes.append(made.where("not is_root").select("tree", "level", "place", "hash"))
        roots.append(made.where("is_root").select("tree", "n", "hash"))
        now = made.where("open").select("tree", "place", "n", "hash", "level")
        if now.isEmpty():
            break
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(nodes), union(roots)


def parts_of(trees: DataFrame) -> DataFrame:
    """``trees`` with a row for each ``part``, 4,096 consecutive leaves of a tree, by which leaves are dealt: a join by tree alone
    would bring a large tree to one task."""
    return trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / FAN**STEP))))


def prove(leaves: DataFrame, nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """``row, proof_sha256, folded_root`` for each of the ``leaves(tree, part, place, hash, seen, row)``, where ``seen`` is the leaf as
    found, perhaps tampered with. ``nodes(tree, level, place, hash)`` holds every node, leaves included; ``parts(tree, part, n,
    at, trees)`` says how many leaves a tree has and at which place of how many its root stands.

    A multiproof for each partition of 4,096 consecutive leaves: from the places that it has, a task works out the fewest nodes that
    are missing up to the root of all; these are fetched once, by one join; then the task derives the shared interiors
    from what it has and expands the proof of each leaf. Any subset of leaves will do: what is missing is found from the
    places alone."""
    asked = leaves.join(parts, ["tree", "part"])

    def wanted(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, here, n, at, trees = (int(pdf[c].iloc[0]) for c in ("tree", "part", "n", "at", "trees"))
        need = [(tree, here, tree, level, place) for level, place in missing(pdf["place"].to_numpy(np.int64), n)]
        need += [(tree, here, TOP, level, place) for level, place in missing(np.array([at]), trees)]
        return pd.DataFrame(need, columns=["of_tree", "part", "tree", "level", "place"])

    need = asked.select("tree", "part", "place", "n", "at", "trees").groupBy("tree", "part").applyInPandas(wanted, "of_tree long, part long, tree long, level long, place long")
    got = need.join(nodes, ["tree", "level", "place"]).withColumnRenamed("tree", "in_tree").withColumnRenamed("of_tree", "tree")

    def expand(here: pd.DataFrame, fetched: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "proof_sha256", "folded_root"]
        if not len(here):
            return pd.DataFrame(columns=names)
        n, at, trees = (int(here[c].iloc[0]) for c in ("n", "at", "trees"))
        by_tree: dict[bool, dict] = defaultdict(dict)
        for in_tree, level, place, h in zip(fetched["in_tree"].tolist(), fetched["level"].tolist(), fetched["place"].tolist(), fetched["hash"].tolist(), strict=True):
            by_tree[in_tree == TOP][level, place] = h
        levels = interiors(dict(zip(here["place"].tolist(), here["hash"].tolist(), strict=True)), by_tree[False], n)
        upper = interiors({at: levels[-1][0]}, by_tree[True], trees)
        above = siblings(upper, at, trees)
        rows = []
        for row, place, seen in zip(here["row"].tolist(), here["place"].tolist(), here["seen"].tolist(), strict=True):
            inside = siblings(levels, place, n)
            proof = hashlib.sha256("".join(h for run in (*inside, *above) for h in run).encode()).hexdigest()
            rows.append((row, proof, folded(folded(seen, place, inside), at, above)))
        return pd.DataFrame(rows, columns=names)

    return asked.groupBy("tree", "part").cogroup(got.groupBy("tree", "part")).applyInPandas(expand, "row long, proof_sha256 string, folded_root string")


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), seen: Column | None = None) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row.

    A leaf is the SHA-256 of the ``fields``. Leaves of a ``group`` ascend by key (null first) and then by digest, so rows alike in both are
    interchangeable; trees have ``FAN`` children a node, the last run fewer. The roots of the groups, by group (null first, bytewise),
    are the leaves of one more tree. ``proof_sha256`` digests the siblings from the leaf to the root of all, and ``folded_root`` is
    what they give with the leaf made from ``seen`` (digest of the row as found; the leaf itself where it is not given): a row
    that was tampered with does not give the root.

    Nulls are ``-``; an empty text is ``0:``. Keys are integers, null or repeated. A group of any size is spread over tasks by 4,096 leaves, and a tree
    over any number of groups likewise. Other columns are not read. An empty table gives an empty result."""
    leaf = digest(*[F.col(f"`{f}`") for f in fields])
    bare = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{group}`").alias("lang"), leaf.alias("hash"), (leaf if seen is None else seen).alias("seen"))
    bare = written(bare, "leaves")
    placed = numbered(bare, ["lang"], [F.col("key").asc_nulls_first(), F.col("hash").asc()], "placed", pos="place")
    groups = numbered(bare.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), [], [F.col("lang").asc_nulls_first()], "groups", pos="tree")
    groups = groups.select(F.col("lang").alias("_lang"), "n", "tree")
    part = F.floor(F.col("place") / FAN**STEP)
    leaves = placed.join(groups, F.col("lang").eqNullSafe(F.col("_lang"))).select("key", "hash", "seen", "n", "tree", "place", part.alias("part"), F.monotonically_increasing_id().alias("row"))
    leaves = written(leaves, "numbered")
    inner, subroots = build(leaves.select("tree", "place", "n", "hash"), "nodes")
    subroots = written(subroots, "subroots")
    trees = subroots.count()
    over = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(trees).cast("long").alias("n"), "hash")
    upper, root = build(over, "upper")
    zero = F.lit(0).cast("long").alias("level")
    nodes = inner.union(leaves.where("n > 1").select("tree", zero, "place", "hash")).union(upper).union(over.where("n > 1").select("tree", zero, "place", "hash"))
    parts = written(parts_of(groups.join(subroots.select("tree", F.col("hash").alias("subroot")), "tree").select("tree", "n", "subroot")), "parts")
    at = parts.select("tree", "part", "n", F.col("tree").alias("at"), F.lit(trees).cast("long").alias("trees"))
    proofs = prove(leaves.drop("n", "key"), nodes, at)
    whole = root.first()
    top = F.lit(whole["hash"] if whole else None).cast("string")
    out = leaves.drop("n").join(parts.select("tree", "part", "subroot"), ["tree", "part"]).join(proofs, "row")
    return out.select(F.col("key").alias(key), F.col("hash").alias("leaf"), "subroot", top.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == top).alias("verified"))


def tampered(fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), key: str = "doc_id", text: str = "text") -> Column:
    """The leaf of a row whose text was lower-cased where 3 divides the CRC-32 of its key in decimal; a null key has none."""
    hit = F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 0
    lower = F.when(hit, F.translate(F.col(f"`{text}`"), UPPER, LOWER)).otherwise(F.col(f"`{text}`"))
    return digest(*[lower if f == text else F.col(f"`{f}`") for f in fields])
