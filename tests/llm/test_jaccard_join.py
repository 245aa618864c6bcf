import random

import numpy as np

from tramline.llm import jaccard_join as J


def brute(rows, n=5, threshold=0.8):
    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()

    sets = [(k, shingles(t)) for k, t in rows]
    group, links = {i: i for i in range(len(sets))}, [0] * len(sets)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                group[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, _) in enumerate(sets):
        least[root(i)] = min(k, least.get(root(i), k))
    return sorted((k, least[root(i)], links[i]) for i, (k, _) in enumerate(sets))


def made(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdef") for _ in range(rnd.randint(2, 6)))
    rows, k = [], 0
    for _ in range(40):
        base = [word() for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
            rows.append((k, " ".join(w)))
            k += rnd.randint(1, 3)
    base = [word() for _ in range(90)]
    for _ in range(90):
        w = list(base)
        w[rnd.randrange(len(w))] = word()
        rows.append((k, " ".join(w)))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "one"), (k + 4, "one"), (k + 5, "a b c d e f"), (k + 5, "a b c d e f")]
    rnd.shuffle(rows)
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = made()
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "doc_id long, text string, node string, label string")
    # whole components in a task, pairs of chunks of a component, pairs of chunks of a band
    for chunk, most in ((2048, 10**6), (16, 10**6), (16, 1)):
        monkeypatch.setattr(J, "CHUNK", chunk)
        monkeypatch.setattr(J, "MOST_CHUNKS", most)
        out = sorted((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(df).collect())
        assert out == brute(rows)


def test_one_of_each_group_stays(spark):
    rows = made(5)
    df = spark.createDataFrame([(k, t, k) for k, t in rows], "doc_id long, text string, _stay long")
    assert sorted(r.doc_id for r in J.keep_one(df).collect()) == sorted(k for k, c, _ in brute(rows) if k == c)


def test_null_keys_and_keys_of_several_texts(spark):
    rows = [(None, "a b c d e f g"), (7, "a b c d e f g"), (9, "x y z"), (9, "k l m"), (9, "k l m"), (8, "x y z"), (None, None), (3, "")]
    out = sorted(((r.doc_id, r.class_id, r.n_links) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()), key=str)
    want = [(None, None, 1), (7, None, 1), (9, 8, 1), (8, 8, 1), (9, 9, 1), (9, 9, 1), (None, None, 0), (3, 3, 0)]
    assert out == sorted(want, key=str)


def test_stars_become_few_edges(spark):
    from tramline.llm.components import hub_components

    # 400 nodes around 3 hubs that they tie together, and one pair apart
    links = [(n, 1000 + h) for n in range(400) for h in range(3)] + [(500, 2000), (501, 2000)]
    out = {r.node: r.label for r in hub_components(spark.createDataFrame(links, "node long, hub long")).collect()}
    assert out == {n: 1000 for n in range(400)} | {500: 2000, 501: 2000}


def test_recall_of_bands_and_pruning():
    """Pairs of similarity 0.8 and more that neither bands nor pruning lose, on random sets: all of them."""
    rnd = np.random.default_rng(5)
    least, lost, seen = J.fewest_matches(0.8, 1e-9), 0, 0
    for size in (20, 60, 200, 1000):
        for swap in (0.0, 0.03, 0.06, 0.1):
            a = [np.unique(rnd.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(60)]
            b = [np.unique(np.concatenate([x[: len(x) - int(swap * len(x))], rnd.integers(0, 2**64, int(swap * len(x)), dtype=np.uint64)])) for x in a]
            full = J.signatures(a + b)
            bands, sig = J.band_hashes(full), full.astype(np.uint16)
            near = J.verified(a, b, np.arange(60), np.arange(60), 0.8)
            band = J.first_common_band(bands[:60], bands[60:], np.arange(60), np.arange(60)) < J.BANDS
            kept = set(zip(*map(np.ndarray.tolist, J.surviving(sig[:60], sig[60:], least)), strict=True))
            seen += int(near.sum())
            lost += sum(1 for k in np.flatnonzero(near).tolist() if not band[k] or (k, k) not in kept)
    assert seen > 500 and lost == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(df).collect() == []


def test_bounds_of_the_posterior():
    least = J.fewest_matches(0.8, 1e-9)
    assert least == sorted(least) and 0 < least[0] < 0.8 * J.STEP and least[-1] < 0.8 * J.VALUES


def test_bands_that_agree_in_stored_bits_only(spark):
    """A pair whose band 2 is its first common one, although the 16 stored bits of band 0 agree as well, counts at band 2."""
    rnd = np.random.default_rng(9)
    a = rnd.integers(0, 2**32, (1, J.VALUES), dtype=np.uint32)
    b = rnd.integers(0, 2**32, (1, J.VALUES), dtype=np.uint32)
    b[:, 2 :: J.BANDS] = a[:, 2 :: J.BANDS]
    b[:, 0 :: J.BANDS] = a[:, 0 :: J.BANDS] ^ np.uint32(1 << 20)
    assert (a.astype(np.uint16)[:, 0 :: J.BANDS] == b.astype(np.uint16)[:, 0 :: J.BANDS]).all()
    assert J.first_common_band(J.band_hashes(a), J.band_hashes(b), np.array([0]), np.array([0])).tolist() == [2]
