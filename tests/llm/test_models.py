"""Language identification, the quality classifier and the pipeline against plain Python and held-out labels."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.llm import langid as L
from tramline.llm import quality_pu as P
from tramline.llm import queries as Q

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def cross_parse(text: bytes, source: bytes) -> int:
    """Phrases of the greedy parse of a whole text: each the longest piece that the source has, one byte at least."""
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and text[i : j + 1] in source and text[i:j] in source:
            j += 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("block", [5, 64, 1024])
def test_phrases_are_those_of_the_greedy_parse(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rnd = random.Random(8)
    sources = [*[bytes(rnd.choice(b"abcd ") for _ in range(400)) for _ in range(3)], b"abababab cc"]
    seen = sorted(set(b"".join(sources)))
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, len(seen) + 1)
    m = L.Model(list("abcd"), code, [L.suffix_automaton(code[np.frombuffer(s, np.uint8)], len(seen) + 1) for s in sources], np.array([400, 400, 400, 11]), np.ones(4))
    texts = [b"", b"a", b"zz", b"ab" * 2000, b"z" + b"ab" * 1111 + b"zz", b"a" * 3000, *[bytes(rnd.choice(b"abcd ez") for _ in range(rnd.choice([3, 40, 1023, 1024, 1025, 3000]))) for _ in range(25)]]
    got = L.phrases(m, texts)
    assert got.tolist() == [[cross_parse(t, s) for s in sources] for t in texts]


def test_less_text_is_no_disadvantage():
    """Phrases alone prefer the language with more text; entropies are of like size for texts of either language."""
    rnd = random.Random(3)
    make = lambda letters, n: b" ".join(bytes(rnd.choice(letters) for _ in range(rnd.randint(2, 6))) for _ in range(n))
    a, b = b"etaoinsh", b"etaoinrd"  # two languages that differ in two letters
    large, small = make(a, 6000), make(b, 250)
    seen = sorted(set(large + small))
    code = np.zeros(256, np.int64)
    code[seen] = np.arange(1, len(seen) + 1)
    m = L.Model(["a", "b"], code, [L.suffix_automaton(code[np.frombuffer(s, np.uint8)], len(seen) + 1) for s in (large, small)], np.array([len(large), len(small)]), np.ones(2))
    texts = [make(b, 60) for _ in range(60)]
    by_phrases, by_entropy = (int((x.argmin(axis=1) == 1).sum()) for x in (L.phrases(m, texts), L.entropy(m, texts)))
    assert by_entropy >= by_phrases and by_entropy >= 57


def test_small_tables_of_language(spark):
    rows = [(1, "das ist der Hund " * 9, "de"), (2, "this is the dog " * 9, "en"), (3, None, None), (4, "", "en"), (5, "12 !?", "en"), (6, "the dog is this", None), (7, "der Hund ist das " * 900, None), (7, "der Hund ist das " * 900, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    m = L.fit(df)
    out = sorted((r.doc_id, r.lang_pred, r.lang_score) for r in L.identify(df, m).collect())
    assert [x[1] for x in out] == ["de", "en", "und", "und", "und", "en", "de", "de"] and all(0 <= x[2] <= 1 for x in out) and out[6] == out[7]
    none = L.fit(df.where("doc_id = 3"))
    assert {r.lang_pred for r in L.identify(df, none).collect()} == {"und"}
    assert L.identify(df.limit(0), m).collect() == []
    with pytest.raises(ValueError):
        L.identify(df.withColumnRenamed("score", "lang_pred"), m)


def test_texts_in_no_taught_language_do_not_fit(spark):
    rnd = random.Random(1)
    english = ["the dog", "a house", "is in", "this small", "of the old", "was there", "and then it", "we have seen", "on that day", "with some", "people", "from there"]
    rows = [(k, " ".join(rnd.choice(english) for _ in range(60)), "en") for k in range(60)] + [(k, " ".join(rnd.choice(["der hund", "ein haus", "ist im", "und dann", "das kleine", "wir haben", "gesehen"]) for _ in range(60)), "de") for k in range(60, 120)]
    other = ["kaikki ihmiset syntyvat vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu jarki ja omatunto ja heidan on toimittava toisiaan kohtaan veljeyden hengessa", "zqx"]
    df = spark.createDataFrame(rows + [(k, t, None) for k, t in enumerate([*other, None, ""], 200)], "doc_id long, text string, lang string")
    out = {r.doc_id: r.misfit for r in L.identify(df, L.fit(df), misfit="misfit").collect()}
    assert all(out[k] < 1.5 for k in range(120)) and out[200] > 2.5 and out[201] == out[202] == out[203] == 0.0


@tables
def test_held_out_language(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = Q.op3_language(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


@tables
def test_held_out_quality(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    r = Q.op4_quality_pu(spark, FOLDER).join(labels, "doc_id").where("held_out").toPandas()
    assert ((r.score >= 0.7) == (r.predicted == 1)).all() and r.score.between(0, 1).all()
    rank, good = r.score.rank(), r.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.98 and (r.predicted == r.quality).mean() > 0.9


def test_risk_is_not_negative_and_prior_is_found():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1.5, 1, (3000, 2)), rng.normal(-1.5, 1, (3000, 2))
    unlabelled = np.vstack([good[:1400], bad[:600]])
    prior = P.estimated_prior(good[1500:], rng.permutation(unlabelled))
    assert abs(prior - 0.7) < 0.08
    w, b = P.descend(good[1500:], unlabelled, prior)
    assert ((good[:1400] @ w + b > 0).mean() > 0.93) and ((bad[:600] @ w + b < 0).mean() > 0.93)


def test_small_tables_of_quality(spark):
    rows = [(k, ("some plain words of a text " * (k % 5 + 1)), 0.0) for k in range(40)] + [(40, None, 0.0), (41, "", 0.0), (42, "# $ % " * 5000, 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, f double")
    m = P.fit(df, df.where("doc_id < 20").select("doc_id"))
    out = {r.doc_id: r.score for r in P.score(df, m).collect()}
    assert len(out) == 43 and all(0 <= s <= 1 for s in out.values()) and out[40] == out[41]
    flat = P.fit(df, df.limit(0))
    assert {r.score for r in P.score(df, flat).collect()} == {0.5}
    assert P.score(df.limit(0), m).collect() == []


@tables
def test_pipeline(spark, tmp_path):
    import corpus_pipeline as C
    from tests.llm.test_jaccard_join import brute
    from tramline.llm import mixing, pii
    from tramline.llm.common import written

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    n = docs.count()
    again = docs.orderBy("doc_id").limit(1)
    polish = "wszystkie ludzkie istoty rodzą się wolne i równe w swojej godności i w swoich prawach są one obdarzone rozumem i sumieniem i powinny postępować wobec innych w duchu braterstwa"
    odd = [(10**6, "12 34 !!", "en", "src0", 8), (10**6 + 1, polish, None, "src0", len(polish)), (10**6 + 2, None, "en", None, None), (10**6 + 3, "", None, None, 0), (None, "a short text without a number", None, None, 29)]
    folder = str(tmp_path)
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(again).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in C.STAGES[:-1]:
        out = written(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        kept.append(out)
        docs = out
    language, near, private, mixed = kept
    assert language.where("doc_id >= 1000000").isEmpty() and language.count() == n + 2
    rows = [(-1 if r.doc_id is None else r.doc_id, r.text) for r in language.collect()]
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in near.collect()) == sorted(k for k, c, _ in brute(rows) if k == c)
    before, after = ({r.doc_id: r.text for r in t.collect()} for t in (near, private))
    found = {r.doc_id: r.pii_found for r in pii.pseudonymise(near).collect()}
    assert all((before[k] != after[k]) == bool(found[k]) for k in before) and any(found.values())
    assert {r.doc_id: r.n_chars for r in private.collect()} == {k: len(t) for k, t in after.items()}
    plan = defaultdict(int)
    for r in mixing.curriculum(private).collect():
        plan[r.doc_id] += len(r.positions)
    times = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert times == {k: n for k, n in plan.items() if n}
    packed = C.STAGES[-1][1](spark, mixed, folder)
    assert sorted(map(str, packed.collect())) == sorted(map(str, C.run(spark, folder).collect()))
    pieces = packed.where("doc_id IS NOT NULL").toPandas()
    times.pop(None, None)
    tokens = {k: n for k, n in zip(pieces.doc_id, pieces.doc_tokens, strict=True)}
    assert pieces.length.sum() == sum(tokens[k] * n for k, n in times.items())
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all()


def test_more_languages_than_most_share_the_sample(spark):
    """Nothing stops at the 65th language; each has less to learn from."""
    rnd = random.Random(7)
    rows, k = [], 0
    for lang in range(70):
        letters = [chr(0x4E00 + 40 * lang + i) for i in range(12)]
        for _ in range(6):
            rows.append((k, " ".join("".join(rnd.choice(letters) for _ in range(4)) for _ in range(12)), f"l{lang:02d}"))
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(df, most_langs=64)
    assert len(model.langs) == 70 and model.taught.sum() <= 64 * 49_152
    got = {r.doc_id: r.lang_pred for r in L.identify(df.drop("lang"), model).collect()}
    assert sum(got[k] == lang for k, _, lang in rows) >= 0.9 * len(rows)


def test_marks_belong_to_words(spark):
    df = spark.createDataFrame([("हिन्दी में",), ("été 1x",)], "t string")
    assert [r[0] for r in df.select(L.letters(F.col("t"))).collect()] == ["हिन्दी में", "été x"]


@pytest.mark.parametrize("share", [1, 3])
def test_a_key_of_many_rows_is_sampled_like_others(spark, monkeypatch, share):
    """One key for all or for a third of the rows: the driver gets no more than it asks for, and still learns."""
    rnd = random.Random(2)
    good = lambda: " ".join(rnd.choice(["the", "house", "of", "a", "river", "runs"]) for _ in range(30)) + "."
    bad = lambda: "".join(rnd.choice("#$%&!0123456789 ") for _ in range(150))
    rows = [(1 if i % share == 0 else i + 10, good() if i % 2 else bad()) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    positives = spark.createDataFrame([(1,)] + [(i + 10,) for i in range(900) if i % 2], "doc_id long")
    seen = []
    plain = P.descend
    monkeypatch.setattr(P, "descend", lambda p, u, prior: seen.append((len(p), len(u))) or plain(p, u, prior))
    model = P.fit(df, positives, most_positive=100, most_unlabelled=200)
    assert model.weight.any() and seen and all(50 <= p <= 100 and 100 <= u <= 200 for p, u in seen[-1:])
