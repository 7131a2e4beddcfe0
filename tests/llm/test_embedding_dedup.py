import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowlens.llm import embedding_dedup as ed


def model(rows, least=0.9):
    ids = [r[0] for r in rows]
    units = []
    for _, v in rows:
        ok = v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        units.append(np.array(v, dtype=float) / max(abs(x) for x in v) if ok else None)
    n = len(rows)
    links, part = [0] * n, list(range(n))
    for i in range(n):
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                links[i] += 1
                links[j] += 1
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    out = []
    for i in range(n):
        known = [ids[k] for k in range(n) if part[k] == part[i] and ids[k] is not None]
        low = min(known) if known else None
        out.append((ids[i], links[i], low, ids[i] == low))
    return sorted(out, key=str)


def data():
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for spread, n in ((0.0, 20), (0.05, 60), (0.25, 60), (0.4, 60), (1.0, 80)):
        center = rng.normal(size=24)
        center /= np.linalg.norm(center)
        for _ in range(n):
            v = center + spread * rng.normal(size=24) / np.sqrt(24) * 1.2 if spread < 1 else rng.normal(size=24)
            rows.append((k, (v * rng.uniform(0.1, 9)).tolist()))
            k += 1
    nan, inf = float("nan"), float("inf")
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [nan] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [inf] + [1.0] * 23), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [5.0]), (909, [3.0]), (910, [1e300] * 24), (911, [1e-300] * 24), (None, rows[0][1]), (None, None), (3, rows[3][1]), (30, rows[30][1])]
    order = rng.permutation(len(rows))
    return [rows[i] for i in order]


def test_against_all_pairs(spark, scratch):
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4).withColumn("ball", F.lit(1)).withColumn("rid", F.lit(7)).withColumn("bucket", F.lit("x"))
    got = sorted((tuple(r) for r in ed.embedding_dedup(df, scratch).collect()), key=str)
    assert got == model(rows)


def test_blocks(spark, scratch, monkeypatch):
    monkeypatch.setattr(ed, "BLOCK", 5)
    monkeypatch.setattr(ed, "SPOTS", 3)
    rows = data()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in ed.embedding_dedup(df, scratch).collect()), key=str) == model(rows)


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a, z = rng.normal(size=(2, 400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = 0.9 * a + np.sqrt(1 - 0.81) * z
    met = sum(np.array([bool(set(x) & set(y)) for x, y in zip(ed.table_buckets(a, t), ed.table_buckets(b, t), strict=True)]).astype(int) for t in range(ed.TABLES))
    assert (met >= ed.MEET).mean() == 1.0


def pairs_at(rng, n, d, cosine=0.9):
    a, z = rng.normal(size=(2, n, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * z


@pytest.mark.parametrize(("functions", "d"), [*((f, 8) for f in range(3, 9)), *((f, 64) for f in range(3, 9)), *((f, 384) for f in range(3, 6))])
def test_recall_of_any_number_of_functions(functions, d):
    n = next(n for n in (10**k // 2 for k in range(1, 26)) if ed.parameters(max(1, n), d)[0] >= functions) if d > 8 or functions > 3 else 1
    functions, tables = ed.parameters(n, d)
    a, b = pairs_at(np.random.default_rng(29), 60, d)
    met = sum((ed.table_buckets(a, t, functions)[:, :, None] == ed.table_buckets(b, t, functions)[:, None, :]).any(axis=(1, 2)).astype(int) for t in range(tables))
    assert (met >= ed.MEET).mean() >= 0.99


def test_probes_are_the_cheapest():
    rng = np.random.default_rng(2)
    for functions in (1, 2, 3, 5):
        falls = np.sort(rng.random((functions, ed.NEAR)), axis=1)
        falls -= falls[:, :1]
        every = sorted(sum(falls[f][w[f]] for f in range(functions)) for w in itertools.product(range(ed.NEAR), repeat=functions))
        some = sorted(sum(falls[f][w[f]] for f in range(functions)) for w in ed._ways(functions, ed.NEAR, ed.PROBES))
        assert np.allclose(every[: ed.PROBES], some[: ed.PROBES])
    assert len(ed._ways(8, ed.NEAR, ed.PROBES)) < 200


def test_signs_lose_no_pair_at_the_threshold():
    a, b = pairs_at(np.random.default_rng(4), 20_000, 64)
    apart = np.unpackbits((ed.simhash(a) ^ ed.simhash(b)).view(np.uint8), axis=1).sum(axis=1)
    share = math.acos(0.9) / math.pi
    assert (apart <= ed.SIGNS * share + ed.SIGMAS * math.sqrt(ed.SIGNS * share * (1 - share))).all()


def test_cosines_at_the_threshold(spark, scratch):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(150):  # pairs within a few units in the last place of the threshold, on either side
        a, b = pairs_at(rng, 1, 16, 0.9 + rng.choice([-1, 0, 1]) * 1e-15)
        rows += [(2 * k, a[0].tolist()), (2 * k + 1, b[0].tolist())]
    got = {r["vec_id"]: r["n_links"] for r in ed.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect()}
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    cos = np.einsum("ij,ij->i", x[::2], x[1::2])
    assert [got[2 * k] for k in range(150)] == [int(c >= 0.9) for c in cos]


def test_hadamard():
    x = np.eye(8)
    h = ed.hadamard(x)
    assert (h @ h.T == 8 * np.eye(8)).all() and ed.parameters(10**9, 64) > ed.parameters(1000, 64)


def test_empty(spark, scratch):
    assert ed.embedding_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>"), scratch).count() == 0


def test_tables_keep_the_recall_of_more_functions_and_wide_vectors():
    for n, d in ((65_536, 64), (8_400_000, 64), (1000, 256), (100_000, 300)):
        functions, tables = ed.parameters(n, d)
        rng = np.random.default_rng(17)
        a, z = rng.normal(size=(2, 300, d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        z -= (z * a).sum(axis=1, keepdims=True) * a
        z /= np.linalg.norm(z, axis=1, keepdims=True)
        b = 0.9 * a + np.sqrt(1 - 0.81) * z
        met = [(ed.table_buckets(a, 100 + t, functions)[:, :, None] == ed.table_buckets(b, 100 + t, functions)[:, None, :]).any(axis=(1, 2)).mean() for t in range(6)]
        p = np.mean(met)
        assert (1 - p) ** tables + tables * p * (1 - p) ** (tables - 1) < 3e-5, (n, d, functions, tables, p)


def test_more_tables_than_a_mask_holds(spark, scratch, monkeypatch):
    monkeypatch.setattr(ed, "parameters", lambda *_: (ed.FUNCTIONS, 70))
    rows = data()
    assert sorted((tuple(r) for r in ed.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), scratch).collect()), key=str) == model(rows)
