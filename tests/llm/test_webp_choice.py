"""The encoder of the query takes what costs least for an image, and the query's decoder meets all of it."""

import hashlib
import random

import numpy as np
import pytest

from tramline.llm import queries as Q
from tramline.llm import webp as W


def walk(rnd, n, step, low=40, high=120):
    out, v = [], 80
    for _ in range(n):
        v = min(max(v + rnd.randint(-step, step), low), high)
        out.append(v)
    return out


def texts():
    rnd = random.Random(8)
    n = 3000
    word = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 8))) for _ in range(400)]
    g = [rnd.randint(40, 120) for _ in range(n)]
    steps = walk(rnd, n, 3, 35, 60)
    ascii_of = lambda *planes: "".join(map(chr, np.stack(planes, axis=1).reshape(-1).tolist()))
    return {
        "words": " ".join(rnd.choices(word, k=2000)),
        "palette": "La La La La " * 700,
        "subtract": ascii_of(np.array(g) + 1, g, np.array(g) + 3, [rnd.randint(40, 120) for _ in range(n)]),
        "predictor": ascii_of(*[walk(rnd, n, 1) for _ in range(4)]),
        "cross": ascii_of(2 * np.array(steps), steps, [50] * n, walk(rnd, n, 1)),
        "both": ascii_of(np.array(steps) + 9, steps, np.array(steps) + 5, walk(rnd, n, 1)),
    }


@pytest.fixture
def met(monkeypatch):
    """What the decoder of each image met."""
    seen = set()

    def watch(name, note):
        plain = getattr(W, name)

        def watched(*a, **k):
            note(a)
            return plain(*a, **k)

        monkeypatch.setattr(W, name, watched)

    watch("predictions", lambda a: a[3] and seen.add("predictor"))
    watch("cross_colour", lambda a: a[3] and seen.add("cross"))
    watch("with_green", lambda a: seen.add("subtract"))
    watch("from_palette", lambda a: seen.add("palette"))
    watch("distance", lambda a: seen.add("reference"))
    watch("read_tokens", lambda a: seen.update((["cache"] if a[4] else []) + (["prefix"] if any(c.fixed is None for c in a[1]) else [])))
    return seen


def test_each_kind_of_text_takes_its_tools(met):
    want = {"words": {"prefix", "reference", "cache"}, "palette": {"palette"}, "subtract": {"subtract"}, "predictor": {"predictor"}, "cross": {"predictor", "cross"}, "both": {"subtract", "predictor"}}
    for kind, text in texts().items():
        payload = W.payload_of(text.encode())
        media = W.stored(payload)
        met.clear()
        assert W.decode(media).tobytes()[: len(payload)] == payload
        assert want[kind] <= met and len(media) < 0.9 * len(payload), (kind, met)


def test_the_query_reads_back_what_each_tool_stored(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([*texts().values(), None, "", "a", "ä" * 40000])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in Q.op2_webp(spark, str(tmp_path)).collect()}
    for i, text in rows:
        payload = W.payload_of((text or "").encode())
        assert (got[i].payload_bytes, got[i].payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert got[i].media_sha256 == hashlib.sha256(W.stored(payload)).hexdigest()


def plain_tokens(bits, codes, width, total, cache_bits):
    """The plain reading of the format, pixel by pixel."""
    g, r, b, a, d = codes
    out, cache = [], [0] * (1 << cache_bits)
    while len(out) < total:
        s = g.read(bits)
        if s < W.LITERALS:
            red, blue = r.read(bits), b.read(bits)
            new = [a.read(bits) << 24 | red << 16 | s << 8 | blue]
        elif s < W.LITERALS + W.LENGTHS:
            length = W.prefix_value(bits, s - W.LITERALS)
            far = W.distance(W.prefix_value(bits, d.read(bits)), width)
            new = []
            for _ in range(length):
                new.append((out + new)[len(out) + len(new) - far])
        else:
            new = [cache[s - W.LITERALS - W.LENGTHS]]
        for v in new:
            cache[(W.HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
        out += new
    return np.array(out, np.uint32)


def test_looked_up_and_plain_reading_agree(monkeypatch):
    rng = np.random.default_rng(3)
    images = [W.encode(rng.integers(0, k, (h, 16, 4)).astype(np.uint8), (), c, ref) for k in (1, 2, 5, 256) for h in (1, 9, 200) for c in (None, 1, 5, 11) for ref in (False, True)]
    # codes of up to 15 bits a channel, over the 57 that a window is sure of
    skewed = np.array([min(int(x), 255) for x in rng.geometric(0.45, 4 * 16 * 9000)], np.uint8).reshape(-1, 16, 4)
    images.append(W.encode(skewed))
    fast = [W.decode(x) for x in images]
    monkeypatch.setattr(W, "read_tokens", plain_tokens)
    assert all((W.decode(x) == y).all() for x, y in zip(images, fast, strict=True))
    assert (fast[-1] == skewed).all()
