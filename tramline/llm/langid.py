"""Language identification by cross-parsing entropy with suffix automata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import fresh, in_slices, utf8

#: Bytes a lane of the parse has. A longer text has several, which are joined to one parse (``joined_lanes``).
BLOCK = 512
#: Bytes of text parsed at once in a task.
SLICE = 1 << 21
#: Bytes of letters from which on a text's entropy tells whether it is in a taught language at all.
LEAST_BYTES = 120


@dataclass
class Model:
    """Suffix automata as transition tables over the bytes seen in training: ``step[lang][state, code]``, -1 for none."""

    langs: list[str]
    code: np.ndarray
    step: list[np.ndarray]
    #: Bytes of text behind each automaton.
    taught: np.ndarray
    #: Of each language the mean entropy of texts that it was not taught with.
    usual: np.ndarray


def suffix_automaton(codes: np.ndarray, width: int) -> np.ndarray:
    """The transition table of the suffix automaton of a sequence of codes 1 .. width - 1 (0 is for unseen bytes)."""
    most = 2 * len(codes) + 2
    step = [-1] * (most * width)
    link, longest = [-1] * most, [0] * most
    last, size = 0, 1
    for c in codes.tolist():
        cur, size = size, size + 1
        longest[cur] = longest[last] + 1
        p = last
        while p >= 0 and step[p * width + c] < 0:
            step[p * width + c] = cur
            p = link[p]
        if p < 0:
            link[cur] = 0
        else:
            q = step[p * width + c]
            if longest[p] + 1 == longest[q]:
                link[cur] = q
            else:
                clone, size = size, size + 1
                step[clone * width : (clone + 1) * width] = step[q * width : (q + 1) * width]
                link[clone], longest[clone] = link[q], longest[p] + 1
                while p >= 0 and step[p * width + c] == q:
                    step[p * width + c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return np.array(step[: size * width], dtype=np.int32).reshape(size, width)


def letters(text: Column) -> Column:
    """A text in small letters, with the marks that scripts join to them, and one blank for each run of anything else, so that markup
    and numbers have no say."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def chosen(texts: list[bytes], most: int) -> list[bytes]:
    """Whole texts, in order, as long as they fit in ``most`` bytes together; one that does not fit is passed over."""
    out, size = [], 0
    for t in texts:
        if size + len(t) + 1 <= most:
            out.append(t)
            size += len(t) + 1
    return out


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts_per_lang: int = 96, bytes_per_lang: int = 49_152, most_langs: int = 64) -> Model:
    """Learns from a bounded sample of rows: of each language the ``texts_per_lang`` texts lowest by a hash of key and
    text, whole, reduced to ``letters``. Every other one teaches the automaton, until ``bytes_per_lang`` are full; the
    others tell how well texts of the language usually fit.

    Null langs, null and empty texts and those of over a quarter of ``bytes_per_lang`` do not teach; rows that repeat key
    and text count once. Beyond ``most_langs`` languages each gets less, in texts and bytes, so that all together take no more
    than that many would: what comes to the driver is about twice ``most_langs * texts_per_lang`` texts of that length at
    most, and one row a language."""
    labels = labelled.select(F.countDistinct(F.col(lang).cast("string"))).first()[0]
    if labels > most_langs:
        texts_per_lang, bytes_per_lang = max(2, texts_per_lang * most_langs // labels), max(256, bytes_per_lang * most_langs // labels)
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), letters(F.col(text)).alias("text"), F.xxhash64(F.col(key), F.col(text)).alias("at"))
    rows = rows.where(F.col("lang").isNotNull() & (F.octet_length("text") > 1) & (F.octet_length("text") <= bytes_per_lang // 4))
    found = rows.groupBy("lang").count().collect()
    if not found:
        return Model([], np.zeros(256, np.int64), [], np.zeros(0), np.zeros(0))
    size = rows.sparkSession.createDataFrame(found, "lang string, count long")
    # a hash threshold that leaves about four times the texts wanted of each language, then the lowest of those; the side
    # that is broadcast are the rows just collected
    few = rows.join(F.broadcast(size), "lang").where(F.col("at").cast("double") / 2.0**64 + 0.5 < 4.0 * texts_per_lang / F.col("count"))
    got = few.groupBy("lang", "at").agg(F.min("text").alias("text")).toPandas().sort_values(["lang", "at"])
    texts = {name: utf8(own[:texts_per_lang]) for name, own in got.groupby("lang")["text"]}
    sample = {name: b"\n".join(chosen(own[::2], bytes_per_lang)) for name, own in texts.items()}
    seen = sorted(set(b"".join(sample.values())))
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, len(seen) + 1)
    # the most frequent first: a tie goes to the likelier language
    rank = {r["lang"]: -r["count"] for r in found}
    langs = sorted(sample, key=lambda x: (rank[x], x))
    step = [suffix_automaton(code[np.frombuffer(sample[x], np.uint8)], len(seen) + 1) for x in langs]
    model = Model(langs, code, step, np.array([len(sample[x]) for x in langs]), np.zeros(len(langs)))
    for k, x in enumerate(langs):
        apart = [t for t in texts[x][1::2] if len(t) >= LEAST_BYTES]
        if apart:
            model.usual[k] = entropy(model, apart)[:, k].mean()
    return model


def phrases(model: Model, texts: list[bytes]) -> np.ndarray:
    """[text, language] phrases of the cross parse: each phrase is the longest match with the language's text, walked in
    its automaton; a byte that no match starts with is a phrase of its own.

    Texts are cut to lanes that step through their bytes together, one table look-up a byte and language; then the lanes
    of a text are joined, so the parse is that of the whole text."""
    lengths = np.array([len(t) for t in texts], np.int64)
    blocks = -(-lengths // BLOCK)
    lanes = int(blocks.sum())
    out = np.zeros((len(texts), len(model.langs)), np.int64)
    if not lanes or not model.langs:
        return out
    owner = np.repeat(np.arange(len(texts)), blocks)
    grid = np.full((lanes, BLOCK), 255, np.int16)  # 255 stands behind the end; the codes are fewer
    codes = model.code.astype(np.int16)
    row = 0
    for t, n in zip(texts, blocks.tolist(), strict=True):
        if n:
            flat = grid[row : row + n].reshape(-1)
            flat[: len(t)] = codes[np.frombuffer(t, np.uint8)]
            row += n
    used = np.where(np.arange(lanes) == np.cumsum(blocks)[owner] - 1, lengths[owner] - (blocks[owner] - 1) * BLOCK, BLOCK)
    order = np.argsort(-used, kind="stable")
    columns, used = np.ascontiguousarray(grid[order].T).astype(np.int32), used[order]
    alive = np.searchsorted(-used, -np.arange(BLOCK), side="left")  # lanes that have a byte at each step
    place = np.empty(lanes, np.int64)
    place[order] = np.arange(lanes)
    later = np.flatnonzero(np.concatenate([[False], owner[1:] == owner[:-1]]))  # lanes that go on a text
    for k, table in enumerate(model.step):
        width = table.shape[1]
        # a state is named by where its row begins, so that a step is one sum and one look-up
        flat = np.where(table < 0, -1, table * np.int32(width)).reshape(-1)
        again = np.maximum(flat[:width], 0)
        state = np.zeros(lanes, np.int32)
        starts = np.zeros((BLOCK, lanes), bool)
        for i in range(BLOCK):
            n = alive[i]
            if not n:
                break
            c, s = columns[i, :n], state[:n]
            go = flat.take(s + c)
            stuck = go < 0
            # a new phrase starts at the byte that did not fit; if nothing starts with it, it stands alone
            np.logical_or(stuck, s == 0, out=starts[i, :n])
            np.copyto(s, go)
            at = np.flatnonzero(stuck)
            s[at] = again.take(c.take(at))
        count = starts.sum(axis=0, dtype=np.int64)
        if len(later):
            joined_lanes(flat, width, columns, used, starts, state, count, place[later], place[later - 1])
        total = np.zeros(len(texts), np.int64)
        np.add.at(total, owner[order], count)
        out[:, k] = total
    return out


def joined_lanes(flat: np.ndarray, width: int, columns: np.ndarray, used: np.ndarray, starts: np.ndarray, state: np.ndarray, count: np.ndarray, later: np.ndarray, before: np.ndarray) -> None:
    """Corrects ``count`` of the lanes ``later`` that go on the lanes ``before``: from the state in which the lane before
    ends the parse goes on until it starts a phrase where the lane's own parse starts one; from there both are the same.

    A lane in which they never meet ends in another state, and its successor is done again."""
    first = flat[:width]
    follows = np.full(len(state), -1, np.int64)
    follows[before] = later
    comes_after = np.full(len(state), -1, np.int64)
    comes_after[later] = before
    own_end = state.copy()
    behind = np.zeros((columns.shape[0] + 1, len(later)), np.int16)  # own starts from each byte on
    behind[:-1] = np.cumsum(starts[::-1, later], axis=0, dtype=np.int16)[::-1]
    column_of = np.full(len(state), -1, np.int64)
    column_of[later] = np.arange(len(later))
    todo = later[state[before] > 0]
    while len(todo):
        lane = todo
        at = state[comes_after[lane]]  # the state that each lane takes over
        new_count, new_end = np.zeros(len(lane), np.int64), own_end[lane].copy()
        open_ = np.arange(len(lane))
        for i in range(columns.shape[0]):
            done = used[lane[open_]] <= i
            new_end[open_[done]] = at[open_[done]]
            open_ = open_[~done]
            if not len(open_):
                break
            s, c = at[open_], columns[i, lane[open_]]
            go = flat.take(s + c)
            new = (go < 0) | (s == 0)
            meets = new & starts[i, lane[open_]]
            met = open_[meets]
            new_count[met] += behind[i, column_of[lane[met]]]
            new_count[open_[new & ~meets]] += 1
            at[open_] = np.where(go < 0, np.maximum(first[c], 0), go)
            open_ = open_[~meets]
        new_end[open_] = at[open_]
        count[lane] = new_count
        changed = lane[new_end != state[lane]]
        state[lane] = new_end
        todo = follows[changed]
        todo = todo[todo >= 0]


def entropy(model: Model, texts: list[bytes]) -> np.ndarray:
    """[text, language] cross-parsing entropy in bits a byte: phrases times the bits that name a place in the language's
    text, over the bytes. So a language taught with less text, whose matches are shorter, pays less for each phrase."""
    length = np.array([max(len(t), 1) for t in texts])[:, None]
    return phrases(model, texts) * np.log2(np.maximum(model.taught, 2))[None, :] / length


def score(model: Model, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Of each text the language of lowest entropy, a score of 0 to 1, and how the entropy compares with that of other
    texts of the language (1: as they; 0 for texts of under ``LEAST_BYTES``, which are too short to tell).

    The score is the softmax of the entropies, scaled to their mean over the languages by a sharpness of 40: the share at
    the winner. Ties go to the model's first language, the most frequent in training."""
    if not model.langs:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    n = entropy(model, texts)
    rate = n / np.maximum(n.mean(axis=1, keepdims=True), 1e-9)
    best = rate.argmin(axis=1)
    weight = np.exp(-40 * (rate - rate.min(axis=1, keepdims=True)))
    usual = model.usual[best]
    long = (np.array([len(t) for t in texts]) >= LEAST_BYTES) & (usual > 0)
    misfit = np.where(long, n[np.arange(len(texts)), best] / np.where(usual > 0, usual, 1), 0.0)
    return [model.langs[i] for i in best], weight.max(axis=1) / weight.sum(axis=1), misfit


def identify(docs: DataFrame, model: Model, text: str = "text", pred: str = "lang_pred", value: str = "lang_score", misfit: str | None = None) -> DataFrame:
    """``docs`` with the language of ``text`` and its score, and with ``misfit`` a column of that name: the entropy of the
    text over the usual one of its language. All other columns and rows stay as they are.

    The whole text counts, reduced to ``letters``. ``und`` with score 0 for a null or empty text and one without a letter;
    misfit is 0 for these and for texts of under ``LEAST_BYTES`` bytes. Only ``text`` decides; equal texts get equal
    answers. An empty table gives an empty result."""
    for c in (pred, value, misfit):
        if c in docs.columns:
            raise ValueError(f"column {c} exists")
    ship = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<l string, s double, m double>")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = ship.value
        for batch in batches:
            texts = utf8(batch)
            parts = [score(own, texts[part]) for part in in_slices(texts, SLICE)]
            yield pd.DataFrame({
                "l": [x for p in parts for x in p[0]],
                "s": np.concatenate([p[1] for p in parts]) if parts else [],
                "m": np.concatenate([p[2] for p in parts]) if parts else [],
            })

    lettered = F.col(text).rlike(r"\p{L}")
    name = fresh(docs, "_guess")
    out = docs.withColumn(name, guess(letters(F.col(text))))
    found = [F.when(lettered, F.col(name)["l"]).otherwise(F.lit("und")).alias(pred), F.when(lettered, F.col(name)["s"]).otherwise(F.lit(0.0)).alias(value)]
    if misfit:
        found.append(F.when(lettered, F.col(name)["m"]).otherwise(F.lit(0.0)).alias(misfit))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *found)
