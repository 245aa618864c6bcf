import random

import numpy as np
import pytest

from tests.llm.test_jaccard_join import brute, made
from tramline.llm import minhash_dedup as M
from tramline.llm.jaccard_join import fewest_matches


def lower(t):
    return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def want(rows):
    def size(t):
        w = (t or "").split()
        return len({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}) if w else 0

    rows = [(k, lower(t)) for k, t in rows]
    sizes = sorted((k, size(t)) for k, t in rows)
    return sizes, sorted((k, c) for k, c, _ in brute(rows, threshold=0.85))


def check(spark, rows):
    out = M.mark(spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, node string, label string")).collect()
    sizes, groups = want(rows)
    assert sorted((r.doc_id, r.n_shingles) for r in out) == sizes
    assert sorted((r.doc_id, r.component_id) for r in out) == groups
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_against_brute_force(spark, monkeypatch, chunk):
    """Whole bands in a task, and bands cut into chunks of main and other members."""
    monkeypatch.setattr(M, "CHUNK", chunk)
    check(spark, [(k, t.upper() if t and k % 3 == 0 else t) for k, t in made(4)])


@pytest.mark.parametrize("chunk", [1024, 4])
def test_chains_without_a_common_lead(spark, monkeypatch, chunk):
    """Each text is near the next one only: most links are not to the lead of a band."""
    monkeypatch.setattr(M, "CHUNK", chunk)
    rnd = random.Random(2)
    words, rows = [f"w{rnd.random()}" for _ in range(80)], []
    for k in range(40):
        rows.append((k, " ".join(words)))
        words[(k * 13) % 80] = f"w{rnd.random()}"
    rnd.shuffle(rows)
    check(spark, rows)


def test_one_of_each_component_stays(spark):
    rows = made(6)
    df = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, _stay long")
    assert sorted(r.doc_id for r in M.keep_one(df).collect()) == sorted(k for k, c in want(rows)[1] if k == c)


def test_null_and_repeated_keys_and_empty_table(spark):
    rows = [(None, "a b c d e f g"), (7, "A b c d e f g"), (9, "x y z"), (9, "k l m"), (9, "k l m"), (8, "x y z"), (None, None), (3, "")]
    out = sorted((tuple(r) for r in M.mark(spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=str)
    want = [(None, 3, None, True), (7, 3, None, False), (9, 1, 8, False), (8, 1, 8, True), (9, 1, 9, True), (9, 1, 9, True), (None, 0, None, True), (3, 0, 3, True)]
    assert out == sorted(want, key=str)
    assert M.mark(spark.createDataFrame([], "doc_id int, text string")).collect() == []


def test_batches_drop_no_pair_at_the_threshold():
    """Of 200,000 pairs whose values agree with a chance of 0.85, none goes; of as many at 0.5, all go, most after 32 values."""
    rnd, least = np.random.default_rng(1), fewest_matches(0.85, 1e-9)
    for _ in range(20):
        a = np.zeros((10_000, M.VALUES), np.uint16)
        assert len(M.in_play(a, (rnd.random(a.shape) > 0.85).astype(np.uint16), least)) == len(a)
        apart = (rnd.random(a.shape) > 0.5).astype(np.uint16)
        assert len(M.in_play(a, apart, least)) == 0
