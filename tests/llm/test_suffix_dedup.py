import hashlib
import random

import pytest

from tramline.llm import suffix_dedup as S


def brute(rows, length=50):
    seen, out = {}, {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] = min(k, seen.get(b[i : i + length], k))
    for k, t in rows:
        b = (t or "").encode()
        off = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] < k:
                off[i : i + length] = [True] * length
        kept = bytes(c for c, o in zip(b, off) if not o)
        spans = sum(o and not (i and off[i - 1]) for i, o in enumerate(off))
        out.setdefault(k, []).append((len(b), sum(off), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, batch string, bucket string")
    out = {}
    for r in S.remove_repeats(df, **kw).collect():
        out.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
    return {k: sorted(v) for k, v in out.items()}


def test_cover_has_every_difference():
    assert {(a - b) % S.MODULUS for a in S.COVER for b in S.COVER} == set(range(S.MODULUS))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "BATCH_BYTES", 3000)
    monkeypatch.setattr(S, "BUCKET_PLACES", 500)
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcé") for _ in range(rnd.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(6, 40))) for _ in range(12)]
    rows = []
    for k in range(120):
        parts = [rnd.choice(passages)[rnd.randint(0, 20) :] if rnd.random() < 0.5 else " ".join(word() for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(0, 5))]
        rows.append((rnd.randint(-5, 10**6) * 7 + k % 7, " ".join(parts)))
    rows += [(3, None), (5, ""), (9, "x" * 49), (11, "x" * 50), (13, "y" * 300), (15, "y" * 300), (17, "y" * 120 + "z"), (18, rows[4][1]), (19, rows[4][1] + "q")]
    rows += [(10**7 + k, passages[0] * 3) for k in range(40)] + [(21, rows[7][1]), (21, rows[7][1])]
    rnd.shuffle(rows)
    assert got(spark, [(k, t, "b", "c") for k, t in rows]) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short"), (2, "short")]])
def test_small_tables(spark, rows):
    assert got(spark, [(k, t, None, None) for k, t in rows]) == brute(rows)


def test_fingerprints_are_those_of_the_bytes():
    """Equal strings have equal fingerprints wherever they stand; strings that differ in one byte, or in the order of two,
    have others."""
    rnd = random.Random(7)
    base = bytes(rnd.choice(b"ab") for _ in range(50))
    others = {base[:i] + bytes([base[i] ^ 3]) + base[i + 1 :] for i in range(50)} | {base[:i] + base[i : i + 2][::-1] + base[i + 2 :] for i in range(49)}
    for pad in (0, 1, 5, 8):
        t = S.Texts([S.packed([k], [b"p" * pad + x]) for k, x in enumerate([base, *sorted(others - {base})])])
        h = t.strong_prints(t.starts + pad, 50)
        assert len(set(h.tolist())) == len(h) == len(others | {base})
        first = h[0] if pad == 0 else first
        assert h[0] == first


def test_null_keys_come_first(spark):
    text = "a passage that is longer than fifty bytes, as the contract has it, and repeats"
    df = spark.createDataFrame([(None, text), (4, text + " more"), (None, "x" + text)], "doc_id long, text string")
    out = sorted((r.doc_id is None, r.n_bytes, r.n_removed) for r in S.remove_repeats(df).collect())
    assert out == [(False, len(text) + 5, len(text)), (True, len(text), 0), (True, len(text) + 1, 0)]
