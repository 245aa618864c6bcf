"""Images that are written or read together are those of each alone, and small ones share the calls."""

import random

import numpy as np
import pandas as pd
import pytest

from tramline.llm import webp as W

from .test_webp_choice import texts


def payloads():
    rnd = random.Random(4)
    words = ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(2, 8))) for _ in range(300)]
    some = [" ".join(rnd.choices(words, k=rnd.choice((0, 1, 5, 40, 300, 900)))) for _ in range(120)]
    some += [*texts().values(), "ä" * 900, "x", "ab" * 40, some[7], some[7]]
    rnd.shuffle(some)
    return [W.payload_of(t.encode()) for t in some] + [bytes(rnd.randrange(256) for _ in range(64 * 50))]


def alone(data):
    try:
        return W.decode(data)
    except (ValueError, IndexError):
        return None


def same(a, b):
    return (a is None) == (b is None) and (a is None or np.array_equal(a, b))


@pytest.mark.parametrize("most", [16, 900, 20000, 1 << 18])
def test_written_together_and_alone(monkeypatch, most):
    every = payloads()
    want = [W.stored(p) for p in every]
    monkeypatch.setattr(W, "WRITTEN", most)
    assert [*W.stored_all(every)] == want


@pytest.mark.parametrize(("few", "most"), [(0, 1 << 19), (3, 5000), (10, 1 << 19)])
def test_read_together_and_alone(monkeypatch, few, most):
    rng = np.random.default_rng(2)
    files = [W.stored(p) for p in payloads()]
    images = [rng.integers(0, k, (h, w, 4)).astype(np.uint8) for k in (1, 2, 5, 256) for h, w in ((1, 1), (9, 16), (60, 33))]
    files += [W.encode(x, (), c, ref) for x in images for c in (None, 1, 11) for ref in (False, True)]
    files += [W.encode(np.array([min(int(x), 255) for x in rng.geometric(0.45, 4 * 16 * 3000)], np.uint8).reshape(-1, 16, 4))]
    # cut files, and files with a wrong bit
    for data in files[:150]:
        files.append(data[: int(rng.integers(0, len(data)))])
        flipped = bytearray(data)
        flipped[int(rng.integers(25, len(data)))] ^= 1 << int(rng.integers(0, 8))
        files.append(bytes(flipped))
    files += [None, b"", b"no image"]
    monkeypatch.setattr(W, "FEW", few)
    monkeypatch.setattr(W, "READ", most)
    got = [*W.decode_all(files)]
    assert len(got) == len(files)
    assert all(same(x, None if f is None else alone(f)) for x, f in zip(got, files, strict=True))


def test_small_documents_share_the_calls(monkeypatch):
    rnd = random.Random(6)
    every = pd.Series(["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=rnd.randint(300, 900))) for _ in range(600)])
    calls = dict.fromkeys(("cost_of", "earlier", "joined", "read_tokens"), 0)
    for name in calls:
        plain = getattr(W, name)

        def counted(*a, name=name, plain=plain):
            calls[name] += 1
            return plain(*a)

        monkeypatch.setattr(W, name, counted)
    media = pd.concat([*W.media_of.func(iter([every]))])
    assert calls["cost_of"] < 60 and calls["earlier"] < 10 and calls["joined"] < 10
    pixels = W.pixels_of.func(media)
    assert calls["read_tokens"] <= W.FEW
    assert [p.rstrip(b"\0").decode() for p in pixels["pixels"]] == every.tolist()
