"""A quality classifier learned from trusted positives and unlabelled text (non-negative unbiased risk)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import in_slices, utf8

SLICE = 1 << 22
#: Byte classes by first fit: small, capital, digit, blank, line end, pause marks, symbols, other ASCII, beyond ASCII.
CLASSES = (b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"#*$%&|<>!?@^~_=+/\\[]{}`")
NAMES = ("lower", "upper", "digit", "blank", "line", "pause", "symbol", "other", "wide", "word_length", "log_words", "same_next_word", "distinct_words", "word_entropy", "symbol_ends", "log_line")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float


def features(texts: list[bytes]) -> np.ndarray:
    """[text, feature] of a few texts at once, all from arrays over their joined bytes; an empty text gets zeros."""
    n = len(texts)
    out = np.zeros((n, len(NAMES)))
    joined = b"".join(t + b"\n" for t in texts)  # a text's last line end is not counted below
    data = np.frombuffer(joined, np.uint8)
    lengths = np.array([len(t) for t in texts]) + 1
    owner = np.repeat(np.arange(n, dtype=np.int32), lengths)
    kind = np.full(256, 8, np.int8)
    kind[:128] = 7
    for k, chars in enumerate(CLASSES):
        kind[list(chars)] = k
    of = kind[data]
    counts = np.bincount(owner * np.int64(9) + of, minlength=9 * n).reshape(n, 9).astype(float)
    counts[:, 4] -= 1
    size = np.maximum(lengths - 1, 1)[:, None]
    out[:, :9] = counts / size
    blank = (of == 3) | (of == 4)
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank])))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return out
    who = owner[begin]
    words = np.bincount(who, minlength=n).astype(float)
    some = np.maximum(words, 1)
    out[:, 9] = np.bincount(who, end - begin, minlength=n) / some
    out[:, 10] = np.log1p(words)
    # a word's hash: differences of the running sum of byte x odd powers would need place shifts; a hash of (byte, place in word) sums instead
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(data)]])))
    mixed = (data.astype(np.uint64) + np.uint64(257) * place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed[blank] = 0
    word = np.add.reduceat(mixed, begin)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (who[1:] == who[:-1])
    out[:, 11] = np.bincount(who, again, minlength=n) / some
    order = np.lexsort((word, who))
    w, o = word[order], who[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (o[1:] != o[:-1])])
    times = np.diff(np.concatenate([np.flatnonzero(new), [len(w)]]))
    whose = o[new]
    # the share of distinct words falls with length in any text (about as n^-0.2), which is taken out
    out[:, 12] = np.bincount(whose, minlength=n) / some * some**0.2
    part = times / some[whose]
    out[:, 13] = np.bincount(whose, -part * np.log(part), minlength=n) / np.maximum(np.log(some), 1)
    out[:, 14] = np.bincount(who, of[end - 1] == 6, minlength=n) / some
    out[:, 15] = np.log1p(words / (counts[:, 4] + 1))
    out[words == 0, 9:] = 0
    return out


def class_prior(score_u: np.ndarray, score_p: np.ndarray, least: float = 0.3) -> float:
    """The share of positives among the unlabelled: the lowest ratio U(A) / P(A) over the sets A = {score >= t} that hold
    ``least`` of the positives, each share moved by its standard error, so that small samples do not pull it down. On a
    set without negatives the ratio is the prior itself. The scores must be of rows that the score did not learn from."""
    t = np.quantile(score_p, np.linspace(0.0, 1 - least, 71))
    p, u = (np.array([(s >= x).mean() for x in t]) for s in (score_p, score_u))
    error = lambda v, n: np.sqrt(np.maximum(v * (1 - v), 0) / max(n, 1))
    ratio = (u + error(u, len(score_u))) / np.maximum(p - error(p, len(score_p)), 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.98))


def estimated_prior(x_p: np.ndarray, x_u: np.ndarray, folds: int = 3) -> float:
    """The median of the priors found on parts held out from a score learned on the rest."""
    found = []
    for k in range(min(folds, len(x_p), len(x_u))):
        out_p, out_u = (np.arange(len(x)) % folds == k for x in (x_p, x_u))
        if out_p.all() or out_u.all():
            break
        w, b = descend(x_p[~out_p], x_u[~out_u], 0.5)  # any prior ranks
        found.append(class_prior(x_u[out_u] @ w + b, x_p[out_p] @ w + b))
    return float(np.median(found)) if found else 0.5


def descend(x_p: np.ndarray, x_u: np.ndarray, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """A linear score by Adam on the non-negative risk with the logistic loss:

    prior E_P[l(+)] + max(0, E_U[l(-)] - prior E_P[l(-)]); where the bracket is negative its gradient is reversed, as
    the unlabelled part then has begun to fit the positives in it."""
    w = np.zeros(x_p.shape[1] + 1)
    xp, xu = np.hstack([x_p, np.ones((len(x_p), 1))]), np.hstack([x_u, np.ones((len(x_u), 1))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for i in range(1, steps + 1):
        zp, zu = xp @ w, xu @ w
        rest = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = -prior * (xp * (1 - sig(zp))[:, None]).mean(axis=0)
        down = (xu * sig(zu)[:, None]).mean(axis=0) - prior * (xp * sig(zp)[:, None]).mean(axis=0)
        g = up + down if rest >= 0 else -down
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return w[:-1], float(w[-1])


def lifted(x: np.ndarray) -> np.ndarray:
    """The features and their squares: a text can be odd by too much and by too little."""
    return np.hstack([x, x * x])


def fit(docs: DataFrame, positives: DataFrame, key: str = "doc_id", text: str = "text", most_positive: int = 3000, most_unlabelled: int = 6000) -> Model:
    """Learns from at most ``most_positive`` rows of ``docs`` whose key is in ``positives`` and at most
    ``most_unlabelled`` rows of all ``docs``; both are picked by a hash of key and text, so reruns agree and a key of many rows
    is no single draw. No more than that many rows come to the driver.

    Null texts count as empty. Without a positive the model scores every text 0.5."""

    def some(rows: DataFrame, most: int, seed: int) -> np.ndarray:
        n = rows.count()
        at = F.xxhash64(F.col(key), F.col(text), F.lit(seed)).cast("double") / 2.0**64 + 0.5
        few = rows.select(F.col(text).alias("t"), at.alias("at")).where(F.col("at") < 1.2 * most / max(n, 1)) if n > most else rows.select(F.col(text).alias("t"), at.alias("at"))
        got = few.select("at", _features("t").alias("f")).orderBy("at").limit(most).toPandas()
        return np.array(got["f"].tolist()).reshape(len(got), len(NAMES))

    ids = positives.select(F.col(key)).distinct()
    x_p = some(docs.join(ids, key, "left_semi"), most_positive, 5)
    x_u = some(docs, most_unlabelled, 6)
    if not len(x_p) or not len(x_u):
        k = 2 * len(NAMES)
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0, 0.5)
    # centred on the positives, with a floor under the spread so that a feature they never show cannot explode
    mid, wide = x_p.mean(axis=0), np.maximum(x_p.std(axis=0), 1e-2)
    z_p, z_u = (lifted(np.clip((x - mid) / wide, -8, 8)) for x in (x_p, x_u))
    scale = np.maximum(z_u.std(axis=0), 1e-3)
    z_p, z_u = z_p / scale, z_u / scale
    prior = estimated_prior(z_p, z_u)
    w, b = descend(z_p, z_u, prior)
    return Model(np.concatenate([mid, wide]), scale, w, b, prior)


def _features(text: str):
    @F.pandas_udf("array<double>")
    def get(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = utf8(batch)
            yield pd.Series([row for part in in_slices(texts, SLICE) for row in features(texts[part])], dtype=object)

    return get(F.col(text))


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    k = len(NAMES)
    z = lifted(np.clip((x - model.mean[:k]) / np.maximum(model.mean[k:], 1e-9), -8, 8)) / model.scale if model.weight.any() else np.zeros((len(x), 2 * k))
    return 1 / (1 + np.exp(-np.clip(z @ model.weight + model.bias, -30, 30)))


def score(docs: DataFrame, model: Model, text: str = "text", value: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality of each whole text; other columns and rows stay. Null counts as
    empty, and an empty text is scored like any other. Equal texts get equal scores."""
    if value in docs.columns:
        raise ValueError(f"column {value} exists")
    ship = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            texts = utf8(batch)
            parts = [probability(ship.value, features(texts[part])) for part in in_slices(texts, SLICE)]
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(value, rate(F.col(text)))
