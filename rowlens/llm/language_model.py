"""LM scoring: a log-bilinear neural model over words, trained with noise-contrastive estimation.

Events. A token is a word or the end of a text. The softmax has an entry for each word of the vocabulary (the most frequent words), TAIL
entries for all other words by their last two bytes, and one for the end. Inside a tail entry a word has its share of the smoothed
counts, with a half count for all unknown words of that entry. So log P(token) = log P(entry) + log share, and the
probabilities of all known words, the unknown ones and the end sum to one.

Model. After words a, b (b the nearer) an entry w has the logit (near_b + far_a) q_w + bias_w. The most frequent words have context vectors of
their own, others those of their tail entry. As exp of a sum of contexts is a product, the normalisers of all pairs of contexts
are one matrix product, exp(near q) diag(exp bias) exp(far q)^T, and a token then costs one inner product.

Training. Biases start at the logarithms of the shares, and the entries' vectors at zero. Each task goes once through its training texts, all of them, in
batches: each batch draws NOISE entries from the unigram distribution, and every token of it is told apart from them by
the contrastive loss. The tasks' changes are averaged, weighted by the squares of the gradients that led to them.

Growth. The vocabulary grows as the cube root of the training tokens and the contexts as the eighth root, so that the model a task
receives stays a small part of any input: about 30,000 words and 1,200 contexts at 10^8 tokens, 1.7 million and 5,500 at 2 * 10^13.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_list, id_crc, tidy

TAIL = 32
#: Words of at most LOOKUP_BYTES bytes may be in the vocabulary. The counts of at least LOOKUP_WORDS of them are sent to every task, which
#: spares joins and changes no result.
LOOKUP_WORDS, LOOKUP_BYTES = 1 << 17, 64
VOCABULARY, CONTEXTS = 64, 120  # words for each cube root, contexts for each eighth root of the training tokens
WIDTH, NOISE, BATCH, RATE = 24, 32, 512, 0.1
CALM = 10.0  # a task's change counts as if this much had been added to its squares: rare entries' changes are summed, others' averaged
#: Training tokens of a task for each parameter it sends: its text is then at least five times as large as its changes.
TASK_TOKENS = 8
FLUSH, FLUSH_BYTES = 200_000, 64 << 20  # words of a task's counter, and bytes of text that went into it
BLOCK, FAN = 1 << 16, 32  # parameters sent in one row, and rows summed by one task
ROWS, ENTRIES = 256, 4096  # contexts and entries of one matrix product


def vocabulary_size(tokens: int) -> int:
    return math.ceil(VOCABULARY * tokens ** (1 / 3))


def context_size(tokens: int) -> int:
    return math.ceil(CONTEXTS * tokens ** (1 / 8))


class LogBilinear:
    """counts: smoothed count of each entry; row_of: context row of each entry. The last column of the vectors is the bias."""

    def __init__(self, counts: np.ndarray, row_of: np.ndarray, width: int = WIDTH, noise: int = NOISE, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.row_of, self.rows, self.entries, self.width, self.noise = row_of.astype(np.int32), int(row_of.max()) + 1, len(counts), width, noise
        shares = counts / counts.sum()
        self.sums = np.cumsum(shares)
        self.log_noise = np.log(noise * shares).astype(np.float32)
        self.flat = np.zeros((2 * self.rows + self.entries) * (width + 1), dtype=np.float32)
        near, far, q = self.parts(self.flat)
        near[:, :width], far[:, :width] = rng.normal(0, 0.3, (self.rows, width)), rng.normal(0, 0.15, (self.rows, width))
        near[:, width], q[:, width] = 1, np.log(shares)
        self.log_z: np.ndarray | None = None

    def parts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of nearer and of farther contexts and of entries: views of flat."""
        k = self.width + 1
        near, far, q = np.split(flat, [self.rows * k, 2 * self.rows * k])
        return near.reshape(-1, k), far.reshape(-1, k), q.reshape(-1, k)

    def learn(self, flat: np.ndarray, squares: np.ndarray, ids: np.ndarray, at: np.ndarray, rng: np.random.Generator) -> None:
        """Adagrad steps on the contrastive loss of the tokens at the given places of a sequence of entries; changes flat and squares."""
        (near, far, q), (near2, far2, q2) = self.parts(flat), self.parts(squares)
        for lo in range(0, len(at), BATCH):
            i = at[lo : lo + BATCH]
            word, a, b = ids[i], self.row_of[ids[i - 1]], self.row_of[ids[i - 2]]
            drawn = np.searchsorted(self.sums, rng.random(self.noise) * self.sums[-1])
            h, q_word, q_drawn = near[a] + far[b], q[word], q[drawn]
            g_word = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", h, q_word) - self.log_noise[word], -30, 30)))
            g_drawn = -1 / (1 + np.exp(np.clip(self.log_noise[drawn] - h @ q_drawn.T, -30, 30)))
            gh = g_word[:, None] * q_word + g_drawn @ q_drawn
            gh[:, -1] = 0  # the place of the bias
            _move(q, q2, word, g_word[:, None] * h)
            _move(q, q2, drawn, g_drawn.T @ h)
            _move(near, near2, a, gh)
            _move(far, far2, b, gh)

    def normalisers(self, lo: int, hi: int) -> np.ndarray:
        """Logarithms of the sums over all entries after each nearer context from lo to hi (rows) and each farther one (columns)."""
        near, far, q = (x.astype(np.float64) for x in self.parts(self.flat))
        out = np.zeros((hi - lo, self.rows))
        for e in range(0, self.entries, ENTRIES):
            some = q[e : e + ENTRIES, :-1].T
            out += np.exp(near[lo:hi, :-1] @ some + q[e : e + ENTRIES, -1]) @ np.exp(far[:, :-1] @ some).T
        return np.log(out)

    def log_p(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of the entries at the given places of a sequence."""
        near, far, q = self.parts(self.flat)
        a, b = self.row_of[ids[at - 1]], self.row_of[ids[at - 2]]
        return (np.einsum("ij,ij->i", near[a] + far[b], q[ids[at]]).astype(np.float64) - self.log_z[a, b]) / np.log(10)


def _move(value: np.ndarray, squares: np.ndarray, where: np.ndarray, grad: np.ndarray) -> None:
    order = np.argsort(where, kind="stable")
    starts = np.flatnonzero(np.diff(where[order], prepend=-1))
    rows, grad = where[order[starts]], np.add.reduceat(grad[order], starts, axis=0)
    total = squares[rows] + grad * grad
    squares[rows] = total
    value[rows] += RATE * grad / np.sqrt(1 + total)


def train(docs: DataFrame, tokens: int, model: LogBilinear, names: list[bytes], entry_of: np.ndarray, scratch: Scratch) -> None:
    """One pass of each task over its texts; model gets the average of their changes."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((names, entry_of, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, entry_of, model = shared.value
        place, flat, squares, part = _places(shared, names), model.flat.copy(), np.zeros_like(model.flat), TaskContext.get().partitionId()
        rng = np.random.default_rng(part)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                ids, is_token, _ = _sequence([t.lower().split() for t in byte_list(whole.column("text").slice(lo, 256))], _cleared(place))
                model.learn(flat, squares, _entries(ids, place, entry_of, model), np.flatnonzero(is_token), rng)
        change = (flat - model.flat) * (np.float32(CALM) + squares)
        for i, lo in enumerate(range(0, len(flat), BLOCK)):
            if squares[lo : lo + BLOCK].any():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part]), pa.array([change[lo : lo + BLOCK].tobytes()], type=pa.binary()), pa.array([squares[lo : lo + BLOCK].tobytes()], type=pa.binary())], names=["block", "part", "change", "squares"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = [np.sum([np.frombuffer(x, dtype=np.float32) for x in pdf[c]], axis=0, dtype=np.float64).astype(np.float32).tobytes() for c in ("change", "squares")]
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "part": pdf["part"].iloc[:1] // FAN, "change": sums[:1], "squares": sums[1:]})

    schema = "block long, part long, change binary, squares binary"
    tasks = max(1, int(tokens / (TASK_TOKENS * len(model.flat))))
    sums = scratch.save(docs.select("text").coalesce(tasks).mapInArrow(tidy(run), schema), "trained")
    while tasks > 1:  # FAN rows of a block at a time
        sums = scratch.save(sums.groupBy("block", F.expr(f"part div {FAN}").alias("group")).applyInPandas(added, schema), "sums")
        tasks = -(-tasks // FAN)
    for r in sums.toLocalIterator():
        change, squares = (np.frombuffer(r[c], dtype=np.float32) for c in ("change", "squares"))
        model.flat[r["block"] * BLOCK : r["block"] * BLOCK + len(change)] += change / (np.float32(CALM) + squares)


def normalise(spark, model: LogBilinear) -> None:
    """Fill in the model's normalisers: a block of contexts for each task."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in b.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([lo]), pa.array([shared.value.normalisers(lo, min(lo + ROWS, shared.value.rows)).astype(np.float32).tobytes()], type=pa.binary())], names=["lo", "z"])

    model.log_z = np.zeros((model.rows, model.rows), dtype=np.float32)
    for r in spark.range(0, model.rows, ROWS, -(-model.rows // ROWS)).mapInArrow(tidy(run), "lo long, z binary").toLocalIterator():
        model.log_z[r["lo"] : r["lo"] + ROWS] = np.frombuffer(r["z"], dtype=np.float32).reshape(-1, model.rows)


def _cleared(place: Places) -> Places:
    place.noted = []
    return place


def _entries(ids: np.ndarray, place: Places, entry_of: np.ndarray, model: LogBilinear) -> np.ndarray:
    """Entries of a sequence of places in the lookup; of words outside it by their tail."""
    out = entry_of[ids]
    if place.noted:
        out[ids == 0] = np.fromiter(map(tail_of, place.noted), dtype=np.int32, count=len(place.noted)) + (model.entries - 1 - TAIL)
    return out


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def _tail_column(word: Column) -> Column:
    last = F.when(F.octet_length(word) <= 2, word).otherwise(F.substring(word, F.octet_length(word) - 1, F.lit(2)))
    return (F.crc32(last) % TAIL).cast("int")


class Places(dict):
    """Place of a word in the lookup; other words get place 0 and are noted."""

    def __init__(self, *args):
        super().__init__(*args)
        self.noted: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.noted.append(word)
        return 0


def _frequent(counts: DataFrame, *sizes: int) -> list[Column]:
    """For each size a condition on counts that about so many of the most frequent short words meet; a larger size holds the smaller ones.

    Words are ranked by steps of their count; of the step that would go beyond the size, a share is taken by a hash of the word.
    """
    step, short = F.floor(F.log2("n") * 8), F.octet_length("word") <= LOOKUP_BYTES
    rows = counts.filter(short).groupBy(step.alias("step")).agg(F.count("*").alias("k")).orderBy(F.desc("step")).collect()  # at most 8 * 63 rows
    out = []
    for size in sizes:
        least, part, room = -1, 0.0, size
        for r in rows:
            if r["k"] > room:
                least, part = r["step"], room / r["k"]
                break
            room -= r["k"]
        out.append(short & ((step > least) | ((step == least) & (F.pmod(F.xxhash64("word", F.lit(29)), F.lit(1 << 30)) < int(part * (1 << 30))))))
    return out


def _held_out(doc_id: Column) -> Column:
    return id_crc(doc_id, 5) == 1


def count_words(docs: DataFrame) -> DataFrame:
    """word (bytes) and n over whole texts: counted in each task, then summed by word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, size = Counter(), 0
        for b in batches:
            for text in byte_list(b.column("text")):
                seen.update(text.lower().split())
                size += len(text)
                if len(seen) > FLUSH or size > FLUSH_BYTES:
                    yield _pairs(seen)
                    seen, size = Counter(), 0
        if seen:
            yield _pairs(seen)

    return docs.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(seen: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())], names=["word", "n"])


def _sequence(rows: list[list[bytes]], place: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the rows' words, each row followed by its end (-1) and led by two (-1); which of them are tokens; token counts."""
    n = np.array([len(r) + 1 for r in rows], dtype=np.int64)
    out = np.full(int(n.sum()) + 2 * len(rows), -1, dtype=np.int32)
    tokens = np.ones(len(out), dtype=bool)
    at = 0
    get = place.__getitem__
    for r in rows:
        tokens[at : at + 2] = False
        out[at + 2 : at + 2 + len(r)] = np.fromiter(map(get, r), dtype=np.int32, count=len(r))
        at += len(r) + 3
    return out, tokens, n


def score_texts(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of docs.

    docs needs doc_id and text; other columns are ignored. Null texts are empty and have one token, their end. A null doc_id
    counts as empty text for held_out. Repeated rows train and are scored each. Without training texts every token is unknown, of base
    probability one; the score then has no context. An empty table gives no rows. Tasks receive the model and the counts of the most frequent words; counts of
    all others are joined by a shuffle. Reruns over the same partitions agree.
    """
    spark = docs.sparkSession
    learned = docs.filter(~_held_out(F.col("doc_id")))
    counts = scratch.save(count_words(learned), "counts")
    totals = counts.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    ends = learned.count()
    tokens, distinct = int(totals["n"] or 0) + ends, totals["v"] + (1 if ends else 0)

    size = vocabulary_size(tokens)
    in_vocabulary, listed = _frequent(counts, size, max(size, LOOKUP_WORDS))
    words = sorted(((bytes(r["word"]), r["n"], r["own"]) for r in counts.filter(listed).select("word", "n", in_vocabulary.alias("own")).collect()), key=lambda x: (not x[2], -x[1], x[0]))
    names, v = [w for w, _, _ in words], sum(own for _, _, own in words)
    mass = np.full(TAIL, 0.5)  # smoothed counts of the words beyond the vocabulary and of unknown ones
    for r in counts.filter(~in_vocabulary).groupBy(_tail_column(F.col("word")).alias("tail")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():  # TAIL rows
        mass[r["tail"]] += r["n"] + 0.5 * r["k"]
    # Of each listed word (from place 1; place 0 is any other word, place -1 the end): entry, log10(c + 0.5), log10 share in its entry.
    tails = np.array([tail_of(w) for w in names], dtype=np.int64)
    smooth = np.array([n + 0.5 for _, n, _ in words])
    entry_of = np.concatenate([[0], np.arange(v), v + tails[v:], [v + TAIL]]).astype(np.int32)
    log_c = np.log10(np.concatenate([[1.0], smooth, [ends + 0.5]]))
    share = np.zeros(len(log_c))
    share[v + 1 : -1] = log_c[v + 1 : -1] - np.log10(mass[tails[v:]])
    own = min(v, context_size(tokens))
    row_of = np.concatenate([np.arange(own), own + tails[own:v], own + np.arange(TAIL + 1)])
    model = LogBilinear(np.concatenate([smooth[:v], mass, [ends + 0.5]]), row_of)
    if ends:
        train(learned, tokens, model, names, entry_of, scratch)
    normalise(spark, model)
    shared = spark.sparkContext.broadcast((names, entry_of, log_c, share, np.log10(mass), model))
    known_end = ends > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, entry_of, log_c, share, log_mass, model = shared.value
        place = _places(shared, names)
        row = TaskContext.get().partitionId() << 36
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                ids, is_token, n = _sequence([t.lower().split() for t in byte_list(b.column("text"))], _cleared(place))
                other = np.flatnonzero(ids == 0)
                entries = _entries(ids, place, entry_of, model)
                score = share[ids]
                base = log_c[ids]
                if len(other):
                    score[other] = -log_mass[entries[other] - (model.entries - 1 - TAIL)]
                    base[other] = 0.0
                score = score[is_token] + model.log_p(entries, np.flatnonzero(is_token))
                base, found = base[is_token], (ids != 0)[is_token]
                if not known_end:
                    found &= (ids != -1)[is_token]
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                owner = np.repeat(np.arange(len(n)), n)[~(ids != 0)[is_token]]
                tails_of: list[Counter] = [Counter() for _ in n]
                for o, w in zip(owner.tolist(), place.noted, strict=True):
                    tails_of[o][w] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + len(n))), b.column("doc_id"), pa.array(n), pa.array(np.add.reduceat(found.astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(score, starts)),
                        pa.array([list(t.keys()) for t in tails_of], type=pa.list_(pa.binary())), pa.array([list(t.values()) for t in tails_of], type=pa.list_(pa.int64())),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_listed", "base", "score", "words", "times"],
                )
                row += len(n)

    kind = dict(docs.dtypes)["doc_id"]
    parts = docs.select("doc_id", "text").mapInArrow(tidy(run), f"row long, doc_id {kind}, n_tokens long, n_listed long, base double, score double, words array<binary>, times array<long>")
    parts = scratch.save(parts, "parts")
    tails = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("t")).select("row", F.col("t.words").alias("word"), F.col("t.times").alias("k"))
    rest = counts.filter(~listed).select("word", F.log10(F.col("n") + 0.5).alias("log_c"))
    known = tails.join(rest, "word").groupBy("row").agg(F.sum("k").alias("known"), F.sum(F.col("k") * F.col("log_c")).alias("log_c"))
    out = parts.select("row", "doc_id", "n_tokens", "n_listed", "base", "score", F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x).alias("k")).join(known, "row", "left")
    more, log_half = F.coalesce("known", F.lit(0)), float(np.log10(0.5))
    tail_log = F.coalesce("log_c", F.lit(0.0)) + (F.col("k") - more) * log_half
    return out.select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_listed") + more).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + tail_log - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (distinct + 1)))).alias("base_score"), (F.col("score") + tail_log).alias("score"),
    )


_last: tuple = (None, None)


def _places(shared, names: list[bytes]) -> Places:
    """The lookup of a broadcast, made once in each Python worker."""
    global _last
    if _last[0] is not shared:
        _last = (shared, Places(zip(names, range(1, len(names) + 1), strict=True)))
    return _last[1]
