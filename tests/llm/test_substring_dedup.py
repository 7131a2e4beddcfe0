import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rowlens.llm import substring_dedup as sd

N = sd.LENGTH


def model(texts):
    seen = Counter(t[i : i + N] for t in texts for i in range(len(t) - N + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - N + 1):
            if seen[t[i : i + N]] > 1:
                gone[i : i + N] = True
        gone = gone[:-1]
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def check(df, texts, scratch):
    got = sd.substring_dedup(df, scratch, with_text=True).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == model(texts)
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


def test_hard_rows(hard_docs, hard_rows, scratch):
    check(hard_docs.filter("doc_id is null or doc_id != 107"), [(r[1] or "").encode() for r in hard_rows if r[0] != 107], scratch)


def planted(rng):
    letters = "abcdefghij klmnop qrst"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [text(n) for n in (199, 200, 201, 260, 700)]
    docs = [text(rng.randint(0, 900)) for _ in range(40)]
    for _ in range(60):
        i, s = rng.randrange(len(docs)), rng.choice(shared)
        at = rng.randint(0, len(docs[i]))
        docs[i] = docs[i][:at] + s[rng.randint(0, 5) :] + docs[i][at:]
    docs += [docs[0], "ab" * 400, "ab" * 150 + "c", "é" * 120, "é" * 99 + "x", "z" * 199, "z" * 200, "z" * 201, "\x00" * 450]
    return docs


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_planted_repeats(spark, scratch, monkeypatch, crowd):
    monkeypatch.setattr(sd, "CROWD", crowd)
    docs = planted(random.Random(6))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    check(df, [d.encode() for d in docs], scratch)


def test_segments_of_long_texts(spark, scratch, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(sd, "SEGMENT", 1000)
    monkeypatch.setattr(sd, "_powers", sd._powers.__wrapped__)
    long = "".join(rng.choice("abcdefgh") for _ in range(6000))
    parts = [sd.tiles(t.encode()) for t in (long, "pre" + long[700:3100])]
    assert [int(p[4].sum()) for p in parts] == [len(long) - N + 1, 2403 - N + 1]
    # Every string has the same anchor wherever it starts in a segment.
    anchors = [np.repeat(p[0], p[4]) for p in parts]
    assert (anchors[0][700 : 700 + len(anchors[1]) - 3] == anchors[1][3:]).all()


@pytest.mark.parametrize("shard", [1, 3, 1000])
def test_merged_shards_against_sorted_rows(shard):
    rng = random.Random(2)
    anchor = bytes(rng.choice(b"pq") for _ in range(sd.KGRAM))
    most = N - sd.KGRAM
    befores, afters = ([bytes(rng.choice(b"xy") if rng.random() < 0.03 else 120 for _ in range(most)) for _ in range(6)] for _ in "ba")
    rows, left, n = [], [], []
    for _ in range(40):
        a, k = rng.randint(0, most), rng.randint(1, most + 1)
        k = min(k, a + 1)
        body = (rng.choice(befores)[most - a :] + anchor + rng.choice(afters))[: k - 1 + N]
        if len(body) == k - 1 + N:
            rows.append(body), left.append(a), n.append(k)
    got = sd.repeated(rows, np.array(left), np.array(n), shard)
    strings = Counter((most - a + i, r[i : i + N]) for r, a, k in zip(rows, left, n, strict=True) for i in range(k))
    for r, a, k, flags in zip(rows, left, n, got, strict=True):
        assert [strings[most - a + i, r[i : i + N]] > 1 for i in range(k)] == flags[most - a : most - a + k].tolist() and flags.sum() == flags[most - a : most - a + k].sum()
    # The transform: rows sorted by their reversed prefixes, ties in the order given.
    symbols = np.array([[rng.randint(0, 2) for _ in range(2 * N - sd.KGRAM)] for _ in range(30)], dtype=np.uint16)
    out, orders = sd.transform(symbols)
    for c in (0, 1, 250, symbols.shape[1] - 1):
        order = sorted(range(30), key=lambda r: symbols[r, :c][::-1].tolist())
        assert symbols[order, c].tolist() == out[c].tolist()
    assert orders[-1].tolist() == sorted(range(30), key=lambda r: symbols[r][::-1].tolist())


def test_tiles_that_come_again_in_their_text():
    for text in (b"-" * 100_000, b"ab" * 5000 + bytes(range(256)) * 3 + b"ab" * 400, random.Random(1).randbytes(3000)):
        found = sd.tiles(text)
        rows, again, starts, counts = sd.folded(found)
        kinds = Counter(zip(*(x.tolist() for x in found[:3]), strict=True))
        assert sorted(kinds) == sorted(zip(*(x[rows].tolist() for x in found[:3]), strict=True))
        assert [kinds[k] > 1 for k in zip(*(x[rows].tolist() for x in found[:3]), strict=True)] == again.tolist()
        want = {i for *k, s, m in zip(*(x.tolist() for x in found[:5]), strict=True) if kinds[tuple(k)] > 1 for i in range(s, s + m)}
        assert {i for s, m in zip(starts, counts, strict=True) for i in range(s, s + m)} == want and sum(counts) == len(want)
    assert len(sd.folded(sd.tiles(b"-" * 100_000))[0]) < 5


def test_long_texts_of_one_byte(spark, scratch):
    texts = ["-" * 3_000_000, "-" * 250 + "abc", "-" * 150]
    got = {r["doc_id"]: r for r in sd.substring_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scratch).collect()}
    assert [got[i]["n_removed"] for i in range(3)] == [3_000_000, 250, 0] and [got[i]["n_spans"] for i in range(3)] == [1, 1, 0]


def test_remove_runs():
    text = bytes(range(256)) * 4
    assert sd.remove_runs(text, []) == (text, 0)
    assert sd.remove_runs(text, [(0, 1), (200, 1)]) == (text[400:], 1)
    assert sd.remove_runs(text, [(500, 3), (0, 1), (0, 1)]) == (text[200:500] + text[702:], 2)


def test_empty(no_docs, scratch):
    assert sd.substring_dedup(no_docs, scratch).count() == 0
