import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from rowlens.llm.mixing import flight, landing, mix, source_targets, targets


def test_targets_by_hand():
    assert targets({"b": 100, "a": 100, None: 100}) == {"a": 200.0, "b": 83.33333333333333, None: 166.66666666666666}
    assert targets({}) == {} and targets({"a": 0}) == {"a": 0.0}


@given(st.dictionaries(st.text(max_size=3), st.integers(0, 1000), min_size=1, max_size=9))
def test_targets_share_all_and_respect_the_bound(sizes):
    got = targets(sizes)
    assert abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6 * (1 + sum(sizes.values()))
    assert all(got[s] <= 2 * n + 1e-9 for s, n in sizes.items())


@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(1, 500)), min_size=1, max_size=60), st.integers(0, 9))
def test_flight_keeps_both_totals(rows, seed):
    p, size = (np.array(x, dtype=float) for x in zip(*rows, strict=True))
    out = flight(p, size, np.random.default_rng(seed))
    assert ((out == 0) | (out == 1)).sum() >= len(p) - 2
    assert abs(out.sum() - p.sum()) < 1e-5 * len(p) and abs(out @ size - p @ size) < 1e-4 * size.sum()
    assert set(landing(out, size)) <= {0.0, 1.0}


def test_flight_is_unbiased():
    p, size = np.array([0.2, 0.5, 0.7, 0.4, 0.6]), np.array([3.0, 5.0, 8.0, 2.0, 9.0])
    mean = np.mean([flight(p, size, np.random.default_rng(i)) for i in range(3000)], axis=0)  # the landing alone favours words
    assert np.abs(mean - p).max() < 0.03


def test_mix(spark, scratch):
    rng = random.Random(1)
    rows = [(i, " ".join("w" * rng.randint(1, 60) for _ in range(rng.randint(1, 80))), f"s{min(i % 9, 3)}" if i % 17 else None, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long").repartition(5)
    got = {r["doc_id"]: r for r in mix(df, scratch, group=256).collect()}
    size = {d: len(t.split()) for d, t, *_ in rows}
    assert {d: r["size"] for d, r in got.items()} == size
    sources = {}
    for d, _, s, _ in rows:
        sources[s] = sources.get(s, 0) + size[d]
    want = targets(sources)
    for s in sources:
        mine = [r for r in got.values() if r["source"] == s]
        assert all(r["target"] == want[s] and r["source_size"] == sources[s] and r["taken"] in (0, r["size"], 2 * r["size"]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= 0.005 * want[s]
    again = {r["doc_id"]: r for r in mix(df.repartition(2), scratch, group=256).collect()}
    assert again == got


def test_hard_rows(hard_docs, hard_rows, no_docs, scratch):
    got = mix(hard_docs, scratch).collect()
    assert len(got) == len(hard_rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (100, 101, 102, 103)} == {0}
    assert mix(no_docs, scratch).count() == 0


def test_no_words(spark, scratch):
    df = spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mix(df, scratch).collect()] == [(0.0, 0), (0.0, 0)]


def test_targets_of_many_sources(spark, scratch):
    rng = random.Random(2)
    for some in ([], ["a"], [f"h{i}é\U0001f600"[: rng.randint(1, 9)] + str(i) for i in range(300)]):
        sizes = {s: rng.choice([0, 1, 5, 1000, 10**6]) for s in some} | ({None: 50} if len(some) > 1 else {})
        df = spark.createDataFrame([(s, n, 1) for s, n in sizes.items()], "source string, n long, docs long").repartition(4)
        assert {r["source"]: r["target"] for r in source_targets(df, scratch).collect()} == targets(sizes)


def test_equal_rows_do_not_share_a_flight(spark, scratch):
    df = spark.range(3000).selectExpr("cast(null as long) as doc_id", "'s' as source", "'a b c' as text").union(spark.range(2000).selectExpr("id", "'t'", "'a b'"))
    seen = []
    got = mix(df, scratch, group=64).collect()
    assert len(got) == 5000
    for s, n in (("s", 3), ("t", 2)):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 2 * n and {r["taken"] for r in mine} <= {0, n, 2 * n}
        seen.append(mine[0]["target"])
    assert abs(sum(seen) - 1.5 * 13000) < 1e-6


def test_sources_of_any_kind(spark, scratch):
    df = spark.createDataFrame([(1, "a b", 3, 5), (2, "c", None, 5), (3, "d e f", 1, 5)], "doc_id long, text string, source int, n long")
    assert sorted(r["source_size"] for r in mix(df, scratch).collect()) == [1, 2, 3]
