import hashlib
import random
import zlib

import numpy as np
import pytest

from tramline.llm import merkle as M

KINDS = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(level):
    out = [level]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def proof(levels, i):
    out = []
    for level in levels[:-1]:
        b = i // 8 * 8
        out.append((i - b, level[b:i] + level[i + 1 : b + 8]))
        i //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for i, r in enumerate(groups[lang]):
            steps = proof(trees[lang], i) + proof(top, k)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            fold = leaf((*r[:4], lower(r[4])) if hit else r)
            for at, others in steps:
                fold = h("".join(others[:at] + [fold] + others[at:]))
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], h("".join(x for _, s in steps for x in s)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in M.manifest(df, seen=M.tampered()).collect()), key=str)


def made(n, langs, seed=1):
    rnd = random.Random(seed)
    lang = lambda: rnd.choice([None, "é", "a", ""]) if langs == 4 else f"l{rnd.randrange(langs)}"
    return [(rnd.choice([None, i, i, i, 5]), rnd.choice([None, "s", ""]), lang(), rnd.choice([None, 3]), rnd.choice([None, "", "AbÉ", "xyz Q"])) for i in range(n)]


@pytest.mark.parametrize(("n", "langs", "step"), [(300, 4, 4), (300, 4, 1), (150, 70, 2), (1, 1, 4), (9, 1, 1)])
def test_against_brute_force(spark, monkeypatch, n, langs, step):
    """Nulls, repeated keys and rows, trees of one and many tasks, one and many trees."""
    monkeypatch.setattr(M, "STEP", step)
    rows = made(n, langs)
    rows += rows[:3]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], KINDS + ", tree string, place int, hash int")
    assert found(df) == brute(rows)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], KINDS)) == []


def test_what_is_missing_is_the_least():
    """For any subset of leaves, the nodes asked for and the leaves give every proof, and no node asked for can be derived."""
    rnd = np.random.default_rng(2)
    for n in (1, 2, 8, 9, 65, 700):
        levels = tree([h(str(i)) for i in range(n)])
        for some in (1, 2, n // 2 + 1, n):
            at = np.sort(rnd.choice(n, min(some, n), replace=False))
            need = M.missing(at, n)
            fetched = {(k, i): levels[k][i] for k, i in need}
            built = M.interiors({int(i): levels[0][i] for i in at}, fetched, n)
            assert built[-1] == {0: levels[-1][0]}
            for i in at.tolist():
                assert M.siblings(built, i, n) == [s for _, s in proof(levels, i)]
            above = {(k, int(i) // 8**k) for i in at for k in range(len(levels))}
            assert not above & set(need) and len(need) == len(set(need))
