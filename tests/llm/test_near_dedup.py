import random

import numpy as np
import pytest

from rowlens.llm import near_dedup as nd


def model(rows, size, percent=80):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    part = {d: d for d in sets}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_hard_rows(hard_docs, hard_rows, scratch, size):
    got = nd.near_dedup(hard_docs, scratch, size=size).collect()
    want = model([r[:2] for r in hard_rows if r[0] is not None], size)
    assert len(got) == len(hard_rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])


def chains(rng, groups=6, each=40):
    """Groups of texts that drift: neighbours are close, ends are not."""
    rows, k = [], 0
    for _ in range(groups):
        w = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(30, 120))]
        for _ in range(each):
            w = list(w)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [2048, 7])
def test_drifting_groups(spark, scratch, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = chains(random.Random(8))
    got = nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), scratch, size=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == model(rows, 2)


def test_units_hold_all_pairs_that_may_link(spark, scratch, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 5)
    rng = random.Random(3)
    rows = [(b, i, rng.choice([i, 0, 1]), rng.randint(1, 60)) for b in range(4) for i in rng.sample(range(200), 60)]
    sizes = {i: n for _, i, _, n in rows}
    labelled = spark.createDataFrame([(b, i, c, sizes[i]) for b, i, c, _ in rows], "bucket long, id long, component long, n long")
    units = nd._units(labelled, 80, scratch).collect()
    held = {}
    for u in units:
        held.setdefault(tuple(u[c] for c in nd.UNIT), ([], []))[u["side"]].append((u["id"], u["component"]))
    assert all(len(x) <= 60 for x in held.values())
    met = []
    for (b, _, step, i, j), (left, right) in held.items():
        pairs = [(x, y) for k, x in enumerate(left) for y in (left[k + 1 :] if step == 0 and i == j else right)]
        met += [(b, *sorted((x[0], y[0]))) for x, y in pairs if x[1] != y[1]]
    assert len(met) == len(set(met))  # none twice
    want = {(b, *sorted((x, y))) for b, x, p, _ in rows for c, y, q, _ in rows if b == c and x < y and p != q and 100 * min(sizes[x], sizes[y]) >= 80 * max(sizes[x], sizes[y])}
    assert want <= set(met)


def test_groups_over_batches():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 5, (500, 2))
    keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
    whole = nd.pa.RecordBatch.from_pydict({"a": keys[:, 0], "b": keys[:, 1], "v": np.arange(500)})
    got = list(nd._groups((whole.slice(lo, 37) for lo in range(0, 500, 37)), ["a", "b"]))
    assert [x for g in got for x in g["v"]] == list(range(500)) and len(got) == len({tuple(k) for k in keys.tolist()})
    assert all(len(set(zip(g["a"], g["b"], strict=True))) == 1 for g in got)


def test_threshold_is_inclusive(spark, scratch):
    a = " ".join(f"a{i}" for i in range(10))  # 9 shingles of two words
    rows = [(1, a), (2, " ".join(a.split()[:9]) + " z"), (3, a + " b c")]  # 8 of 10, 9 of 11
    got = {r["doc_id"]: r["component_id"] for r in nd.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), scratch, size=2).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_posterior_bounds():
    least = nd.least_matches(0.8)
    assert all(0 < least[n] < 0.8 * n for n in least) and least[nd.SIGNATURE] > 50
    rng = np.random.default_rng(0)
    kept = 0
    for _ in range(200):
        shared = rng.integers(0, 1 << 63, 800).astype(np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 100).astype(np.uint64)])) for _ in "ab")
        kept += len(nd.likely(nd.signature(a)[None], nd.signature(b)[None], least))
    assert kept == 200


def test_empty(no_docs, scratch):
    assert nd.near_dedup(no_docs, scratch).count() == 0
