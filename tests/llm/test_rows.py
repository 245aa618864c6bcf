"""Sharding, mixing, quality rules and packing against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tramline.llm import mixing, packing, quality_rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string, size long, shard int"


def made(n=300, seed=1):
    rnd = random.Random(seed)
    words = ["the", "of", "and", "der", "la", "que", "x#y", "é", "loooong" * 20, "a", "b", "c"]
    rows = []
    for k in range(n):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", "\t ", " "]) for _ in range(rnd.choice([0, 1, 4, 12, 80, 300])))
        rows.append((k * 3, rnd.choice([text, text, text, None, ""]) if k % 7 == 0 else text, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s0", "s1", "s2", None]), k, 0))
    return rows + rows[:3] + [(5, "the " * 4000, "en", "s1", 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA)


def test_shards(docs):
    out = sharding.shard_by_key(docs, rows_per_bucket=2).collect()
    rows = made()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t, *_ in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.doc_id: r.shard for r in out} == {r.doc_id: r.shard for r in sharding.shard_by_key(docs.repartition(3)).collect()}


def highest(key, n):
    """The shard of a key, by the definition: the highest -1 / ln u, where u is from the MD5 of seed, key and shard."""
    u = lambda i: (int(hashlib.md5(f"0:{'' if key is None else key}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return max(range(n), key=lambda i: (-1 / math.log(u(i)), i))


def test_shards_against_plain_python(spark):
    """Every shard recomputed, with null keys and one key for a third of all rows, equal texts among them."""
    rows = [(k, f"t{k}") for k in range(300)] + [(None, None)] * 40 + [(None, "x")] * 3 + [(7, f"v{k % 50}") for k in range(150)]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, shard int, size int")
    out = sharding.shard_by_key(df, rows_per_bucket=1).collect()
    assert sorted((str(r.doc_id), r.size) for r in out) == sorted((str(k), len(t or "") + 1) for k, t in rows)
    for r in out:
        assert (r.shard, r.grown_shard) == (highest(r.doc_id, 16), highest(r.doc_id, 17))
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_weights_decide_how_many_rows_a_shard_gets(spark):
    n = spark.range(20_000).select(sharding.rendezvous(F.col("id"), [1.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r.s: r["count"] / 20_000 for r in n}
    assert abs(share[1] - 0.75) < 0.02


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, out = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in out]
        if not open_:
            return out
        left = total - sum(out.values())
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 2 * sizes[s]]
        if not over:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}


def test_mixture(docs):
    rows = made()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    out = mixing.curriculum(docs).collect()
    assert sorted((r.doc_id, r.size) for r in out) == sorted((k, size(t)) for k, t, *_ in rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken <= 2 * r.size and all(0 < x <= 1 for x in r.positions)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)
    assert sorted(map(str, out)) == sorted(map(str, mixing.curriculum(docs.repartition(5)).collect()))


def test_mixed_rows_come_as_often_as_taken(docs):
    one = docs.dropDuplicates(["doc_id"])
    plan = {r.doc_id: r.taken // r.size for r in mixing.curriculum(one).collect() if r.size}
    out = defaultdict(int)
    for r in mixing.mix(one).collect():
        out[r.doc_id] += 1
    assert out == {k: n for k, n in plan.items() if n}


def test_schedule_inverse(spark):
    for a, b in ((1.0, 1.0), (1.0, 0.5), (0.2, 2.0)):
        x = spark.range(1, 10).select(mixing.position_of_share(F.col("id") / 10, F.lit(a), F.lit(b)).alias("x"), (F.col("id") / 10).alias("u")).collect()
        assert all(abs((a * r.x + (b - a) * r.x**2 / 2) / ((a + b) / 2) - r.u) < 1e-9 for r in x)


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    places, seen = set(), defaultdict(list)
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            places |= {i + k for i in at for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(places)


def test_rules(docs):
    out = {}
    for r in quality_rules.rules(docs, least_docs=1).collect():
        out[r.doc_id] = r
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    for k, t, *_ in made():
        r = out[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(t), (k, t)


def test_words_decide(spark):
    """Of texts of 60 words an ordinary one stays and one without a common word goes; a short one is not judged by words."""
    rnd = random.Random(2)
    rare = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    prose = lambda n: " ".join(rnd.choice(["the", "of", "and", "to", "in", "a"]) if rnd.random() < 0.4 else rare() for _ in range(n))
    rows = [(k, prose(60 + k), "en", "s", 0, 0) for k in range(200)]
    rows += [(1000, " ".join(rare() for _ in range(60)), "en", "s", 0, 0), (1001, prose(60), "en", "s", 0, 0), (1002, " ".join(rare() for _ in range(59)), "en", "s", 0, 0), (1003, " ".join(rare() for _ in range(60)), "xx", "s", 0, 0)]
    out = {r.doc_id: r for r in quality_rules.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(out[k].kept for k in (*range(200), 1001, 1002, 1003))
    assert not out[1000].base_failed and not out[1000].kept and out[1000].word_distance > 0.95 and out[1003].word_distance is None


def test_distance(spark):
    p, q = np.array([0.2, 0.8, 0.0]), np.array([0.5, 0.25, 0.25])
    m = (p + q) / 2
    kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x)
    got = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p.tolist())), F.array(*map(F.lit, q.tolist())))).first()[0]
    assert abs(got - np.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_packing(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    extra = [(10**6 + i, t, "en", "s", 0, 0) for i, t in enumerate(["<|endoftext|> a", "x<|endoftext|><|endoftext|>\n <|endoftext|", "", "x" * 9000, "naïve  \U0001f600", "word " * 9000])]
    rows = made(120) + extra
    df = docs.sparkSession.createDataFrame(rows, SCHEMA)
    out = packing.pack(df, path, per_group=50).collect()
    want = defaultdict(list)
    for k, t, *_ in rows:
        want[k].append(ids(t))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in want[r.doc_id])
    assert all(sum(r.length for r in pieces[k]) == sum(map(len, v)) for k, v in want.items())
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    used = sum(r.length for r in out)
    assert used == sum(len(x) for v in want.values() for x in v)
    assert len(sequences) * 2048 - used < 2048 * 8


def plainly_packed(lengths, size, linear, quadratic):
    """(piece, start, length, sequence) by the rule: dearest first, cheapest sequence with room, cut where none has."""
    n = -(-sum(lengths) // size)
    spent, room, out = [0.0] * n, [size] * n, []
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        at = 0
        while at < lengths[k]:
            left = lengths[k] - at
            open_ = [i for i in range(n) if room[i] >= left] or [i for i in range(n) if room[i]]
            i = min(open_, key=lambda i: (spent[i], i))
            take = min(left, room[i])
            out.append((k, at, take, i))
            spent[i] += linear * take + quadratic * take * take
            room[i] -= take
            at += take
    return out, spent


def test_packing_by_cost():
    rnd = random.Random(9)
    lengths = [rnd.randint(20, 1500) for _ in range(900)]
    rows = [(k, 0, n, n, np.zeros(n, "<u2").tobytes()) for k, n in enumerate(lengths)]
    got = [(k, at, n, i) for k, at, n, _, _, i, _ in packing.pack_group(rows, 2048, 1.0, 1 / 1024)]
    want, spent = plainly_packed(lengths, 2048, 1.0, 1 / 1024)
    assert got == want
    # first-fit in order of length would leave some sequences twice as dear as others
    assert max(spent) - min(spent[:-1]) < 0.5 * np.mean(spent)


def test_packing_in_order_of_files(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.range(500).selectExpr("id AS doc_id", "repeat('word ', 1 + id % 40) AS text").repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id")
    df.write.parquet(str(tmp_path / "t"))
    out = packing.pack(spark.read.parquet(str(tmp_path / "t")), path, per_group=50, in_order=True).collect()
    assert sorted(r.doc_id for r in out if r.start == 0) == list(range(500))
    spans = defaultdict(list)
    for r in out:
        spans[r.sequence_id >> packing.SEQUENCE_BITS].append(r.doc_id)
    ranges = [(min(v), max(v)) for _, v in sorted(spans.items())]
    assert len(ranges) >= 10 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    # rows without a file are dealt by hash
    assert packing.pack(spark.createDataFrame([(None, None), (1, "a")], "doc_id long, text string"), path, in_order=True).count() == 2


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_by_key(empty).collect() == mixing.curriculum(empty).collect() == mixing.mix(empty).collect() == quality_rules.rules(empty).collect() == []
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []
