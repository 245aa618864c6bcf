import hashlib
import random
import zlib

import numpy as np
import pytest

from tramline.llm import prefix_trie as P

KINDS = "conv_id long, turn long, role string, text string"


def brute(rows):
    given = {}
    for c, t, r, x in rows:
        if c is not None:
            given.setdefault(c, []).append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    given = {c: [v[2:] for v in sorted(turns)] for c, turns in given.items()}
    rebuilt = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = given.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {k: 0 for k in members}
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = {k: 0 for k in members}, {k: 0 for k in members}
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in P.prefix_trie(df).collect())


def made(seed=1):
    rnd = random.Random(seed)
    rows = []
    for c in [*range(60), 100, 103]:
        for t in range(rnd.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, rnd.choice([None, t, t, t]), rnd.choice([None, "u", "a"]), rnd.choice([None, "", "x", "é"])))
    # no conversation, repeated rows, and one that holds a third of all turns
    rows += [(None, 1, "a", "b"), (11, 2, "u", "x"), (11, 2, "u", "x")]
    return rows + [(7, i % 50 if i % 3 else None, "u", f"x{i % 4}") for i in range(300)]


@pytest.mark.parametrize(("most", "pack", "run"), [(4096, 1 << 13, 1024), (6, 12, 16)])
def test_against_brute_force(spark, monkeypatch, most, pack, run):
    """In one task, and by distributed rounds down to components of six nodes."""
    for name, value in (("MOST_NODES", most), ("PACK", pack), ("RUN", run)):
        monkeypatch.setattr(P, name, value)
    rows = made()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KINDS + ", node string, depth int")
    assert found(df) == brute(rows)


def test_empty_table_and_turnless_conversations(spark):
    assert found(spark.createDataFrame([], KINDS)) == []
    # the crc of 1 takes all turns of the absent base 0: nothing is left of it
    rows = [(1, 0, "u", "a"), (6, 0, "u", "a")]
    assert found(spark.createDataFrame(rows, KINDS)) == brute(rows)


def test_rounds_stay_few_on_deep_and_wide_trees():
    rnd = np.random.default_rng(3)
    for n, up in ((3000, lambda i: i - 1), (3000, lambda i: 0), (3000, lambda i: int(rnd.integers(max(0, i - 3), i))), (3000, lambda i: int(rnd.integers(0, i)))):
        parent = np.array([-1, *[up(i) for i in range(1, n)]])
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        order = np.argsort(depth, kind="stable")
        place = np.argsort(order)
        depth, parent = depth[order], np.where(parent[order] < 0, -1, place[parent[order]])
        own = rnd.integers(1, 9, n)
        values = np.stack([own, rnd.integers(0, 100, n)], axis=1)
        want = values.copy()
        for i in range(n - 1, 0, -1):
            want[parent[i]] += want[i]
        assert (P.rolled(depth, parent, want[:, 0], values) == want).all()
