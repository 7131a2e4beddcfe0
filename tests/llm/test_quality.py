import random
import zlib

import numpy as np
import pytest

from rowlens.llm import quality as q

from .conftest import words


def test_linear_time_score_equals_all_pairs():
    rng = np.random.default_rng(1)
    m = q.Machine(0.3, rng.normal(size=q.SIZE), rng.normal(size=(q.SIZE, q.RANK)))
    at, x = np.array([3, 9, 77, 500]), rng.normal(size=4)
    want = 0.3 + m.weights[at] @ x + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margins(at, x, np.array([0]))[0] == pytest.approx(want)


def corpus(n):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = words(rng, rng.randint(20, 200))
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), text.replace(" ", " $$$ "), " ".join([text[:20]] * 30)])
        rows.append((i, text, len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(900)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in q.score_quality(docs, q.fit_quality(docs, lab)).collect()}
    held = [i for i in got if got[i]["held_out"]]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["predicted"] == (got[i]["score"] >= 0.7) for i in got)
    assert len(held) > 150 and np.mean([got[i]["predicted"] == labels[i][1] for i in held]) > 0.97
    # Held-out labels play no part.
    other = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, y, t in labels], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: r["score"] for r in q.score_quality(docs, q.fit_quality(docs, other)).collect()} == {i: r["score"] for i, r in got.items()}


def test_hard_rows(spark, hard_docs, hard_rows, no_docs):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(25)] + [(1, None, 0), (None, 1, 0), (2, 7, 0), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    m = q.fit_quality(hard_docs, labels)
    got = q.score_quality(hard_docs, m).collect()
    assert len(got) == len(hard_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert q.score_quality(no_docs, m).count() == 0 and q.fit_quality(no_docs, labels).rows == 0


def test_without_labels(spark, hard_docs):
    m = q.fit_quality(hard_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {r["score"] for r in q.score_quality(hard_docs, m).collect()} == {0.5}


def test_source_and_language_are_no_inputs(hard_docs):
    from pyspark.sql import functions as F

    m = q.fit(*[[f] for f in q.features(b"a b c", 3)], np.array([1.0]))
    a = {(r["doc_id"], r["score"]) for r in q.score_quality(hard_docs, m).collect()}
    b = {(r["doc_id"], r["score"]) for r in q.score_quality(hard_docs.withColumn("lang", F.lit("q")).withColumn("source", F.lit("q")), m).collect()}
    assert a == b
