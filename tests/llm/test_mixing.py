"""The order of a mixture against its schedules."""

from collections import defaultdict

import pytest

from tramline.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    # weights 3, 1, 2 by name: "a" is taken twice, "b" in part, "c" once and in part again
    rows = [(k, "w " * (5 + k % 11), "abbcc"[k % 5]) for k in range(1500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


def schedule(x, weight):
    """The share of a source that is read up to training position x."""
    last = weight * (1 + weight / 3) / 2
    return (weight * x + (last - weight) * x * x / 2) / ((weight + last) / 2)


def test_every_copy_follows_its_schedule(docs):
    rows = mixing.curriculum(docs).collect()
    target = {r.source: r.target for r in rows}
    assert {r.source: round(r.target / r.source_size, 1) for r in rows}["a"] == 2.0
    words = defaultdict(list)
    for r in rows:
        assert len(r.positions) == r.taken // r.size and list(r.positions) == sorted(r.positions)
        words[r.source] += [(x, r.size) for x in r.positions]
    for source, weight in (("a", 3.0), ("b", 1.0), ("c", 2.0)):
        read = 0
        for x, n in sorted(words[source]):
            assert abs(schedule(x, weight) - (read + n / 2) / target[source]) < 1e-9
            read += n
        assert abs(read - target[source]) <= 15
        # the words of each tenth of the training are those of the integrated schedule, but for a document at each end
        for k in range(10):
            a, b = k / 10, (k + 1) / 10
            got = sum(n for x, n in words[source] if a < x <= b)
            assert abs(got - target[source] * (schedule(b, weight) - schedule(a, weight))) <= 15
    order = [(r.positions[0] if r.positions else 2.0, r.doc_id) for r in rows]
    assert order == sorted(order)


def test_mixed_rows_stand_in_order_of_position(docs):
    want = [k for _, k in sorted((x, r.doc_id) for r in mixing.curriculum(docs).collect() for x in r.positions)]
    got = mixing.mix(docs).collect()
    assert [r.doc_id for r in got] == want
    # every source is there to the end, repeats among the first passes of others
    tail = {r.source for r in got[-len(got) // 20 :]}
    assert tail == {"a", "b", "c"}


def test_repeated_keys_and_clashing_columns(spark):
    names = "doc_id long, text string, source string, position double, row string, _k int, positions string, size int"
    rows = [(1, "a b c", "s", 0.5, "x", 7, "p", 1), (1, "a b c d e f", "s", 0.6, "y", 8, "q", 2), (1, "a b c", "s", 0.7, "z", 9, "r", 3), (None, "u v", None, None, None, None, None, None), (2, None, "s", None, None, 1, None, 4), (3, "", None, None, None, 1, None, 5)]
    df = spark.createDataFrame(rows, names)
    plan = defaultdict(int)
    for r in mixing.curriculum(df).collect():
        plan[r.doc_id] += len(r.positions)
    out = mixing.mix(df).collect()
    assert mixing.mix(df).columns == df.columns and {tuple(r) for r in out} <= set(rows)
    got = defaultdict(int)
    for r in out:
        got[r.doc_id] += 1
    assert got == {k: n for k, n in plan.items() if n} and plan[2] == plan[3] == 0
    # of the rows of one key each is read as often as its own plan says
    assert sum(len(r.text.split()) for r in out) == sum(r.taken for r in mixing.curriculum(df).collect())
