"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions, of low
rank, in time linear in the features. Words are hashed to buckets and weigh as a unit vector of their counts; each statistic of
the whole text falls in one of a few bins, which are features of their own.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import Scratch, byte_list, id_crc, small_batches, tidy, whole_row

WORDS = 1 << 14
RANK = 8
BINS = 12
#: Bounds on the labelled documents that the machine is fitted on, and on their features (131 KB for the longest texts); drawn evenly by hashes of the id.
FIT_ROWS, FIT_BYTES = 8_000, 256 << 20
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.05, 1e-5
STATS = ("length", "words", "word_length", "upper", "digits", "symbols", "exclaims", "ascii", "distinct_words", "distinct_lines", "line_length", "common_byte", "stated_chars")
SIZE = WORDS + len(STATS) * BINS


def structure(text: bytes, words: list[bytes], stated: int | None) -> list[float]:
    """Each of STATS as a number from 0 to 1."""
    n = len(text)
    if not n:
        return [0.0] * (len(STATS) - 1) + [0.0 if stated is None else min(1.0, math.log1p(max(0, stated)) / 14)]
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    letters_up, letters = int(c[65:91].sum()), int(c[65:91].sum() + c[97:123].sum() + c[128:].sum())
    digits, exclaims = int(c[48:58].sum()), int(c[33])
    plain = int(c[44] + c[46] + c[39] + c[45])
    symbols = int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum()) - plain
    lines = [x for x in text.split(b"\n") if x]
    k = max(1, len(words))
    return [
        min(1.0, math.log1p(n) / 14), min(1.0, math.log1p(len(words)) / 12), min(1.0, n / k / 20), letters_up / max(1, letters), min(1.0, 4 * digits / n), min(1.0, 4 * symbols / n), min(1.0, 10 * exclaims / n), float(c[:128].sum()) / n,
        len(set(words)) / k, len(set(lines)) / max(1, len(lines)), min(1.0, math.log1p(n / max(1, len(lines))) / 10), min(1.0, 2 * float(np.delete(c, 32).max()) / n), 0.0 if stated is None else min(1.0, math.log1p(max(0, stated)) / 14),
    ]


def features(text: bytes, stated: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features."""
    words = text.split()
    at, value = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.float32)
    if words:
        at, tf = np.unique(np.fromiter(map(zlib.crc32, text.lower().split()), dtype=np.uint32, count=len(words)) & (WORDS - 1), return_counts=True)
        value = (tf / np.sqrt((tf.astype(float) ** 2).sum())).astype(np.float32)
    bins = [WORDS + i * BINS + min(BINS - 1, int(x * BINS)) for i, x in enumerate(structure(text, words, stated))]
    return np.concatenate([at.astype(np.int32), np.asarray(bins, dtype=np.int32)]), np.concatenate([value, np.full(len(bins), 0.5, dtype=np.float32)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    rows: int = 0  # that it was fitted on

    def margins(self, at: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Margins of documents whose features start at starts (each has at least its statistics)."""
        vx = self.factors[at] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        squares = np.add.reduceat(vx * vx, starts, axis=0)
        return self.bias + np.add.reduceat(self.weights[at] * value, starts) + 0.5 * (sums * sums - squares).sum(axis=1)


def fit(at: list[np.ndarray], value: list[np.ndarray], labels: np.ndarray, seed: int = 7) -> Machine:
    """Minimise log loss by AdaGrad over shuffled small batches. Without rows every score is 0.5."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE, dtype=np.float32), rng.normal(0, 0.01, (SIZE, RANK)).astype(np.float32))
    if not len(labels):
        m.factors[:] = 0
        return m
    m.rows = len(labels)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    m.bias = math.log(share / (1 - share))
    g_w, g_v, g_b = np.full(SIZE, 1e-6, dtype=np.float32), np.full((SIZE, RANK), 1e-6, dtype=np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            n = np.array([len(at[r]) for r in rows])
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            i, x = np.concatenate([at[r] for r in rows]), np.concatenate([value[r] for r in rows])
            vx = m.factors[i] * x[:, None]
            sums = np.add.reduceat(vx, starts, axis=0)
            margin = m.bias + np.add.reduceat(m.weights[i] * x, starts) + 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts, axis=0)).sum(axis=1)
            d = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[rows]) / len(rows)
            each = np.repeat(d, n).astype(np.float32) * x
            uniq, back = np.unique(i, return_inverse=True)
            dw = np.bincount(back, weights=each, minlength=len(uniq)).astype(np.float32) + DECAY * m.weights[uniq]
            dv_rows = each[:, None] * (np.repeat(sums, n, axis=0) - vx)
            dv = np.stack([np.bincount(back, weights=dv_rows[:, f], minlength=len(uniq)) for f in range(RANK)], axis=1).astype(np.float32) + DECAY * m.factors[uniq]
            g_w[uniq] += dw * dw
            g_v[uniq] += dv * dv
            m.weights[uniq] -= RATE * dw / np.sqrt(g_w[uniq])
            m.factors[uniq] -= RATE * dv / np.sqrt(g_v[uniq])
            g_b += float(d.sum()) ** 2
            m.bias -= RATE * float(d.sum()) / math.sqrt(g_b)
    return m


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Machine:
    """A machine fitted on at most about fit_rows labelled documents outside the held-out quarter, and on fewer if their features take more than fit_bytes.

    docs needs doc_id and text, and may have n_chars; labels needs doc_id and quality; other columns are ignored. Labels without doc_id, and those
    other than 0 and 1, are ignored; of several labels of a document the larger one holds. Null texts are empty; rows that
    share a doc_id are rows to learn from each. Without usable rows every score is 0.5.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (id_crc(F.col("doc_id"), 4) != 2)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = min(1.0, fit_rows / max(1, usable.count()))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t, s) for t, s in zip(byte_list(b.column("text")), b.column("n_chars").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array([f[0].astype("<i4").tobytes() for f in found], type=pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in found], type=pa.binary())], names=["doc_id", "quality", "at", "value"])

    kinds = dict(usable.dtypes)
    rows = docs.select("doc_id", "text", _chars(docs).alias("n_chars")).join(F.broadcast(drawn), "doc_id")  # drawn: about fit_rows ids and labels
    with Scratch(docs.sparkSession) as s:
        found = s.save(rows.mapInArrow(tidy(run), f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, at binary, value binary"), "features")
        size = found.agg(F.sum(F.octet_length("at") + F.octet_length("value"))).first()[0] or 0
        share = min(1.0, fit_bytes / max(1, size))
        got = found.filter(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < int(share * (1 << 30))).collect()  # about fit_bytes at most
    got.sort(key=lambda r: (r["doc_id"], bytes(r["at"]), bytes(r["value"])))
    return fit([np.frombuffer(r["at"], dtype="<i4") for r in got], [np.frombuffer(r["value"], dtype="<f4") for r in got], np.array([r["quality"] for r in got], dtype=float))


def _chars(docs: DataFrame) -> Column:
    return F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def score_quality(docs: DataFrame, machine: Machine, keep_row: bool = False) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7) of each row of docs; keep_row adds all of its columns as one, row.

    docs needs doc_id and text, and may have n_chars; other columns are ignored, whatever their names. Null texts are empty; empty texts are
    scored by their statistics. A null doc_id counts as empty text for held_out, and what is no number in n_chars as null. Repeated rows are
    scored each; an empty table gives no rows. Labels, lang, source and doc_id are no inputs of the score.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    carried = docs.select(whole_row(docs) if keep_row else "doc_id", F.col("text").alias("text_"), _chars(docs).alias("chars_"))
    first = carried.columns[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                found = [features(t, s) for t, s in zip(byte_list(b.column("text_")), b.column("chars_").to_pylist(), strict=True)]
                starts = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])[:-1]]).astype(np.int64)
                z = shared.value.margins(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), starts)
                yield pa.RecordBatch.from_arrays([b.column(first), pa.array(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))), type=pa.float64())], names=[first, "score"])

    kind = StructType([carried.schema[first], StructField("score", DoubleType())])
    out, doc_id = carried.mapInArrow(tidy(run), kind), F.col("row.doc_id" if keep_row else "doc_id")
    return out.select(doc_id.alias("doc_id"), (id_crc(doc_id, 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), *(["row"] if keep_row else []))
