"""Word shingles of texts as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX_B
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the joined texts, and the number of words before each text and in all.

    A word's hash is the sum of a hash of each byte and its place."""
    joined = b"".join(t + b"\n" for t in texts)
    data = np.frombuffer(joined, np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    begin = edge[::2]
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    before = np.concatenate([[0], np.searchsorted(begin, ends)])
    if not len(begin):
        return np.zeros(0, np.uint64), before
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(data)]])))
    each = mixed((data.astype(np.uint64) + np.uint64(1) + (place.astype(np.uint64) << np.uint64(8))) * MIX_A)
    each[blank] = 0
    return mixed(np.add.reduceat(each, begin)), before


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of the n-word windows of each text; a text of fewer words has one window, of all of
    them, and one without words none."""
    words, before = word_hashes(texts)
    out = []
    for i in range(len(texts)):
        w = words[before[i] : before[i + 1]]
        k = len(w)
        if not k:
            out.append(w)
            continue
        m = min(n, k)
        h = np.full(k - m + 1, m, np.uint64)
        for j in range(m):
            h = mixed(h * MIX_A + w[j : k - m + 1 + j])
        out.append(np.unique(h))
    return out
