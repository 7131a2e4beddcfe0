import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from rowlens.llm import language_model as lm


def base_model(rows):
    c, toks = Counter(), []
    for d, t in rows:
        w = [*(t or "").encode().lower().split(), None]
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
        toks.append((d, held, w))
        if not held:
            c.update(w)
    n, v = sum(c.values()), len(c)
    return sorted(((d, held, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for d, held, w in toks), key=str)


def test_base_scores(hard_docs, hard_rows, scratch):
    got = sorted((tuple(r) for r in lm.score_texts(hard_docs, scratch).collect()), key=str)
    want = base_model([r[:2] for r in hard_rows])
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want]) and all(math.isfinite(g[6]) and g[6] < 0 for g in got)


@pytest.fixture
def made(monkeypatch):
    """Models as they are normalised."""
    seen, real = [], lm.normalise
    monkeypatch.setattr(lm, "normalise", lambda spark, model: (real(spark, model), seen.append(model)))
    return seen


def test_scores_by_brute_force(spark, hard_rows, scratch, made, monkeypatch):
    monkeypatch.setattr(lm, "VOCABULARY", 3)  # few words, so that tails and contexts that share a row matter
    monkeypatch.setattr(lm, "CONTEXTS", 4)
    rows = [r[:2] for r in hard_rows]
    got = sorted((tuple(r) for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch).collect()), key=str)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    split = lambda t: (t or "").encode().lower().split()
    c = Counter(w for d, t in rows if not held(d) for w in split(t))
    n = sum(c.values()) + sum(not held(d) for d, _ in rows)
    frequent = scratch.spark.createDataFrame([(bytearray(w), k) for w, k in c.items()], "word binary, n long")
    own = sorted((bytes(r[0]) for r in frequent.filter(lm._frequent(frequent, lm.vocabulary_size(n))[0]).collect()), key=lambda w: (-c[w], w))
    contexts = min(len(own), lm.context_size(n))
    assert 0 < contexts < len(own) < len(c)
    (model,) = made
    near, far, q = (x.astype(float) for x in model.parts(model.flat))
    mass = [0.5 + sum(k + 0.5 for w, k in c.items() if w not in own and lm.tail_of(w) == t) for t in range(lm.TAIL)]

    def entry(w):
        return len(q) - 1 if w is None else own.index(w) if w in own else len(own) + lm.tail_of(w)

    def row(w):
        return contexts + lm.TAIL if w is None else own.index(w) if w in own[:contexts] else contexts + lm.tail_of(w)

    def log_p(far_word, near_word, w):
        z = (near[row(near_word)] + far[row(far_word)]) @ q.T
        share = 0.0 if w is None or w in own else math.log10((c[w] + 0.5) / mass[lm.tail_of(w)])
        return (z[entry(w)] - math.log(np.exp(z).sum())) / math.log(10) + share

    def score(t):
        ws = [None, None, *split(t), None]
        return sum(log_p(*ws[i - 2 : i + 1]) for i in range(2, len(ws)))

    short = [(d, t) for d, t in rows if len(t or "") < 5000]
    want = {str((d, len(split(t)) + 1)): score(t) for d, t in short}
    assert len(want) > 40 and all(math.isclose(g[6], want[str((g[0], g[2]))], rel_tol=1e-4) for g in got if str((g[0], g[2])) in want)
    # All known words, the unknown ones (a half count in each tail) and the end sum to one.
    for a, b in ((None, None), (own[0], own[1]), (b"never met", own[-1])):
        known = sum(10 ** log_p(a, b, w) for w in [*c, None])
        z = (near[row(b)] + far[row(a)]) @ q.T
        unknown = sum(math.exp(z[len(own) + t]) / np.exp(z).sum() * 0.5 / mass[t] for t in range(lm.TAIL))
        assert math.isclose(known + unknown, 1, rel_tol=1e-9)


def test_words_beyond_the_lookup(hard_docs, hard_rows, scratch, monkeypatch):
    scored = lambda: sorted((tuple(r) for r in lm.score_texts(hard_docs, scratch).collect()), key=str)
    monkeypatch.setattr(lm, "VOCABULARY", 5)
    before = scored()
    monkeypatch.setattr(lm, "LOOKUP_WORDS", 5)
    got, want = scored(), base_model([r[:2] for r in hard_rows])
    assert [g[3] for g in got] == [w[3] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])
    assert np.allclose([g[6] for g in got], [g[6] for g in before])


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(0)
    k = 13
    rule = rng.dirichlet(np.full(k - 1, 0.2), size=(k, k))
    ids = [k - 1, k - 1]
    for _ in range(60_000):
        ids.append(int(rng.choice(k - 1, p=rule[ids[-2], ids[-1]])))
    ids, at = np.array(ids), np.arange(2, 50_000)
    counts = np.bincount(ids, minlength=k) + 0.5
    model = lm.LogBilinear(counts, np.arange(k), width=12)
    flat, squares = model.flat.copy(), np.zeros_like(model.flat)
    for _ in range(5):
        model.learn(flat, squares, ids, at, rng)
    model.flat = flat
    model.log_z = np.concatenate([model.normalisers(lo, min(lo + 5, k)) for lo in range(0, k, 5)])
    for a, b in ((0, 0), (3, 5), (k - 1, 2)):
        assert math.isclose((10 ** model.log_p(np.concatenate([[a, b, w] for w in range(k)]), np.arange(2, 3 * k, 3))).sum(), 1, rel_tol=1e-5)
    held = np.arange(50_000, len(ids))
    assert model.log_p(ids, held).mean() > np.log10(counts / counts.sum())[ids[held]].mean() + 0.03


def test_held_out_texts_of_a_language_score_above_the_base(spark, scratch):
    rng = random.Random(5)
    tongues = [[f"{p}{i}" for i in range(40)] for p in ("ka", "lo", "mi")]
    rows = [(i, " ".join(rng.choices(tongues[i % 3], k=60))) for i in range(600)]
    got = [r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch).collect() if r["held_out"]]
    assert len(got) > 80 and all(r["score"] > r["base_score"] for r in got)
    shuffled = [(i + 10_000, " ".join(rng.choices(sum(tongues, []), k=60))) for i in range(50)]
    mixed = [r for r in lm.score_texts(spark.createDataFrame(rows + shuffled, "doc_id long, text string"), scratch).collect() if r["held_out"]]
    odd, even = ([r["score"] / r["n_tokens"] for r in mixed if (r["doc_id"] >= 10_000) == x] for x in (True, False))
    assert max(odd) < min(even)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)]])
def test_nothing_to_learn(spark, scratch, rows):
    got = [tuple(r) for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()]
    assert [g[:5] for g in got] == [w[:5] for w in base_model(rows)] and np.allclose([g[5] for g in got], [w[5] for w in base_model(rows)])


def test_words_of_one_tail_class_are_told_apart(spark, scratch):
    rng = random.Random(8)
    frequent = [f"f{i}" for i in range(63)]
    pairs = [("oneqa", "firstzz"), ("twoqa", "otherzz")]  # the words of a column end in the same two bytes

    def text(swap):
        out = []
        for _ in range(12):
            i = rng.randrange(2)
            out += [*rng.choices(frequent, k=8), pairs[i][0], pairs[1 - i if swap else i][1]]
        return " ".join(out)

    rows = [(i, text(False)) for i in range(1500)]
    rows += [(10_000 + i, text(True)) for i in range(400) if zlib.crc32(str(10_000 + i).encode()) % 5 == 1]
    got = [r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), scratch).collect() if r["held_out"]]
    swapped, right = (np.mean([r["score"] for r in got if (r["doc_id"] >= 10_000) == x]) for x in (True, False))
    assert right > swapped + 1


def test_vocabulary_grows(spark, monkeypatch):
    for size in (lm.vocabulary_size, lm.context_size):
        sizes = [size(n) for n in (0, 10**6, 10**8, 10**10)]
        assert sizes == sorted(set(sizes))
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), 1 + i % 3) for i in range(3000)], "word binary, n long")
    small, large = ({bytes(r["word"]) for r in counts.filter(c).collect()} for c in lm._frequent(counts, 1300, 2500))
    assert small < large and all(abs(len(x) - k) < 120 for x, k in ((small, 1300), (large, 2500)))
    assert {f"w{i}".encode() for i in range(3000) if i % 3 == 2} <= small


def test_changes_of_many_tasks_are_joined(spark, scratch, monkeypatch):
    monkeypatch.setattr(lm, "TASK_TOKENS", 0.1)
    monkeypatch.setattr(lm, "FAN", 2)
    monkeypatch.setattr(lm, "BLOCK", 1000)
    rng = random.Random(5)
    tongues = [[f"{p}{i}" for i in range(40)] for p in ("ka", "lo", "mi")]
    rows = [(i, " ".join(rng.choices(tongues[i % 3], k=60))) for i in range(1500)]
    got = [r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), scratch).collect() if r["held_out"]]
    assert len(got) > 200 and all(r["score"] > r["base_score"] for r in got)
