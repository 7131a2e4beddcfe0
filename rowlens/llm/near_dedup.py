"""MinHash near-deduplication with sequential Bayesian verification.

Documents with the same shingle set are one class. Bands of a class's MinHash signature name its buckets; classes that share a bucket
are candidates. Signatures are compared in batches: after each, a pair goes if the posterior probability that its
similarity reaches the threshold is below MISS. Survivors are verified on their full sets.

Only links that join components matter here, so candidates are made in two steps. First every class of a bucket is
compared with the bucket's leader, which is linear and settles groups of copies however large. Then, in buckets whose
classes are still in several components, pairs across components are compared in blocks of bounded size, and only between blocks whose sets are near enough in size to link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .common import Scratch, byte_list, prune_by_ids, tidy
from .graph import components

BANDS, ROWS = 25, 4
SIGNATURE = BANDS * ROWS
#: Chance that a pair at the threshold shares no band: (1 - 0.8 ** ROWS) ** BANDS, 2e-6; and to be pruned by the posterior:
MISS = 1e-6
STEP = 20  # hashes compared between two looks at the posterior
BLOCK, BLOCK_SHINGLES = 2048, 500_000  # classes of a block, and shingles of their sets (4 MB), at most about
_rng = np.random.default_rng(11)
_MULTIPLY = _rng.integers(1, 1 << 31, SIGNATURE, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.int64).astype(np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of size words; the whole sequence if it has fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = _mixed(out * _MIX + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each hash function over the set (not empty)."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SIGNATURE, 0xFFFFFFFF, dtype=np.uint32)
    for lo in range(0, len(x), 1024):
        y = (x[lo : lo + 1024, None] ^ _XOR) * _MULTIPLY
        np.minimum(out, (y ^ (y >> np.uint32(15))).min(axis=0), out=out)
    return out


def buckets(signatures: np.ndarray) -> np.ndarray:
    """Bucket of each band (columns) of signatures (rows), as signed 64-bit numbers."""
    s = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2])
    for i in range(ROWS):
        out = _mixed(out * _MIX + s[:, :, i])
    return out.view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """After n compared hashes, the matches below which P(similarity >= threshold | matches) < miss, under a uniform prior."""
    out = {}
    for n in range(STEP, SIGNATURE + 1, STEP):
        total, m = 0.0, 0  # the posterior is a Beta; its upper tail at t is P(Binomial(n + 1, t) <= m)
        while True:
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out[n] = m
    return out


def likely(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which pairs of signatures (rows of a and b) outlive the sequential comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int32)
    for n, m in least.items():
        matches += (a[alive, n - STEP : n] == b[alive, n - STEP : n]).sum(axis=1, dtype=np.int32)
        keep = matches >= m
        alive, matches = alive[keep], matches[keep]
    return alive


def _sketch(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                sets = [shingle_set(t, size) for t in byte_list(b.column("text"))]
                columns = [
                    b.column("doc_id"), pa.array([len(s) for s in sets], type=pa.int64()), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], type=pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "digest", "sig"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, digest binary, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = buckets(_signatures(b.column("sig")))
                ids = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(got.reshape(-1)), b.column("id").take(ids), b.column("n").take(ids)], names=["bucket", "id", "n"])

    return classes.select("id", "n", "sig").mapInArrow(tidy(run), f"bucket long, id {dict(classes.dtypes)['id']}, n long")


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, SIGNATURE)


def _pruned(pairs: DataFrame, classes: DataFrame, least: dict[int, int]) -> DataFrame:
    """Pairs (a, b) whose signatures pass the sequential test."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                on = pa.array(likely(_signatures(b.column("sig_a")), _signatures(b.column("sig_b")), least))
                yield pa.RecordBatch.from_arrays([b.column("a").take(on), b.column("b").take(on)], names=["a", "b"])

    sides = [classes.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sig_a", "sig_b").mapInArrow(tidy(run), f"a {kind}, b {kind}").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union of their full sets."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(lo, 64) for b in batches for lo in range(0, b.num_rows, 64)):
            on = []
            for i, (x, y) in enumerate(zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        on.append(i)
            rows = pa.array(on, type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])

    sides = [sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab"]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "set_a", "set_b").mapInArrow(tidy(run), f"a {kind}, b {kind}").distinct()


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id and full set (sorted 64-bit hashes as bytes) of the documents in ids."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([shingle_set(t, size).tobytes() for t in byte_list(b.column("text"))], type=pa.binary())], names=["id", "set"])

    return prune_by_ids(docs.select("doc_id", "text"), ids.withColumnRenamed("id", "doc_id"), "doc_id").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").mapInArrow(tidy(run), f"id {kind}, set binary")


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[dict[str, list]]:
    """Rows of sorted batches that agree in all columns of by, column by column; only the present group is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(c).to_numpy(zero_copy_only=False) for c in by]
        fresh = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = [0, *fresh.tolist(), b.num_rows]
        if held and any(held[-1].column(c)[0].as_py() != k[0] for c, k in zip(by, keys, strict=True)):
            yield _joined(held)
            held = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo:
                yield _joined(held)
                held = []
            held.append(b.slice(lo, hi - lo))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> dict[str, list]:
    return {name: [x for p in parts for x in p.column(name).to_pylist()] for name in parts[0].schema.names}


def _block_pairs(rows: dict[str, list], least: dict[int, int], percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each left row of a unit, the right rows of other components that are near in size and signature (rows by place)."""
    part, size, side = (np.array(rows[c]) for c in ("component", "n", "side"))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = rows["step"][0] == 0 and rows["i"][0] == rows["j"][0]  # a block with itself
    if alone:
        right = left
    if not len(right) or (part[left] == part[left[0]]).all() and (part[right] == part[left[0]]).all():
        return
    sig = np.frombuffer(b"".join(rows["sig"]), dtype=np.uint32).reshape(-1, SIGNATURE)
    own = None
    steps = [(np.ascontiguousarray(sig[:, n - STEP : n]), m) for n, m in least.items()]
    for k, x in enumerate(left):
        y = right[k + 1 :] if alone else right
        y = y[(part[y] != part[x]) & (100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x]))]
        matches = np.zeros(len(y), dtype=np.int64)
        for some, m in steps:  # the sequential test, as in likely()
            if not len(y):
                break
            matches += (some[y] == some[x]).sum(axis=1)
            y, matches = y[matches >= m], matches[matches >= m]
        if len(y):
            if own is None:
                own = buckets(sig)
                band = int(np.flatnonzero((own == rows["bucket"][0]).all(axis=0))[0])
            y = y[~(own[y, :band] == own[x, :band]).any(axis=1)]  # the first band that two classes share has their pair
        if len(y):
            yield int(x), y


UNIT = ["bucket", "cell", "step", "i", "j"]


def _units(labelled: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The rows of each unit of work: two blocks of a bucket's classes (or one twice) between which there is more than one component.

    Classes are dealt to cells by the size of their sets: sets that can link are in one cell or in two next to each other. A cell is dealt to
    blocks of bounded size. Rows: UNIT, side (0 left, 1 right), id, component.
    """
    cell = F.floor(F.log(F.col("n").cast("double")) / math.log(1.001 * 100 / percent)).cast("int")
    rows = scratch.save(labelled.withColumn("cell", cell), "sized")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    cells = scratch.save(rows.groupBy("bucket", "cell").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), blocks.alias("blocks")), "cells")
    after = cells.select("bucket", (F.col("cell") - 1).alias("cell"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("blocks").alias("others"))
    same = cells.filter("lo < hi").select("bucket", "cell", F.lit(0).alias("step"), "blocks", F.col("blocks").alias("others"))
    both = cells.join(after, ["bucket", "cell"]).filter("least(lo, lo2) < greatest(hi, hi2)").select("bucket", "cell", F.lit(1).alias("step"), "blocks", "others")
    work = scratch.save(same.union(both), "work")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    first = rows.join(work, ["bucket", "cell"]).withColumn("own", deal("blocks")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    square, once = F.col("step") == 0, F.least("own", "other")
    first = first.select("bucket", "cell", "step", F.when(square, once).otherwise(F.col("own")).alias("i"), F.when(square, F.greatest("own", "other")).otherwise(F.col("other")).alias("j"), F.when(square & (F.col("own") != once), 1).otherwise(0).alias("side"), "id", "component")
    last = rows.withColumn("cell", F.col("cell") - 1).join(work.filter("step = 1"), ["bucket", "cell"]).withColumn("j", deal("others")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return first.union(last.select("bucket", "cell", "step", "i", "j", F.lit(1).alias("side"), "id", "component"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Units together and in order. A unit is work, not bytes, so partitions are not merged by their bytes."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *UNIT).sortWithinPartitions(*UNIT)


def _involved(rows: DataFrame, least: dict[int, int], percent: int) -> DataFrame:
    """The rows of each unit (with n and sig) that are in a candidate pair, without n and sig."""
    names = [*UNIT, "side", "id", "component"]
    schema = StructType([rows.schema[n] for n in names])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {n: [] for n in names}
        for group in _groups(batches, UNIT):
            met = np.zeros(len(group["id"]), dtype=bool)
            for x, y in _block_pairs(group, least, percent):
                met[x] = True
                met[y] = True
            for n in names:
                out[n] += [v for v, m in zip(group[n], met, strict=True) if m]
            if len(out["id"]) > 10_000:
                yield pa.RecordBatch.from_pydict(out, schema=kinds)
                out = {n: [] for n in names}
        if out["id"]:
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return _dealt(rows).mapInArrow(tidy(run), schema)


def _joining(rows: DataFrame, least: dict[int, int], percent: int) -> DataFrame:
    """Links (a, b) that join components in a unit, verified on full sets: for any two, as few as connect them."""
    schema = StructType([StructField(x, rows.schema["id"].dataType) for x in "ab"])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, UNIT):
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group["set"]]
            part, ids, out = np.array(group["component"]), group["id"], []
            for x, y in _block_pairs(group, least, percent):
                y = y[part[y] != part[x]]
                if not len(y):
                    continue
                size = np.array([len(sets[k]) for k in y])
                flat = np.concatenate([sets[k] for k in y])
                at = np.minimum(np.searchsorted(sets[x], flat), len(sets[x]) - 1)
                both = np.add.reduceat((sets[x][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
                for k in y[100 * both >= percent * (len(sets[x]) + size - both)]:
                    if part[k] != part[x]:
                        part[part == part[k]] = part[x]
                        out.append((ids[x], ids[k]))
            if out:
                yield pa.RecordBatch.from_pydict({"a": [o[0] for o in out], "b": [o[1] for o in out]}, schema=kinds)

    return _dealt(rows).mapInArrow(tidy(run), schema).distinct()


def near_dedup(docs: DataFrame, scratch: Scratch, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs, by word shingles of size words.

    docs needs doc_id (a number) and text; other columns are ignored. Documents are linked from a similarity of percent / 100;
    component_id is the smallest doc_id reachable by links. Null, empty and blank texts have an empty set and link
    with nothing. A text of fewer than size words has one shingle, all of it. Rows that share a doc_id are one document; a row
    without doc_id links with nothing, has no component_id, and is kept. An empty table gives no rows. Words are what white
    space separates, A to Z in lower case.
    """
    least = least_matches(percent / 100)
    sketch = scratch.save(_sketch(docs, size), "sketch")
    n = sketch.count()
    classes = sketch.filter("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n"))
    classes = scratch.save(classes, "classes")
    whole, sketch = sketch, scratch.save(sketch.select("doc_id", "n_shingles", "digest"), "sketch")  # signatures are in classes from here on
    scratch.drop(whole)
    bands = scratch.save(_bands(classes), "bands")
    leaders = bands.groupBy("bucket").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("leader != last")
    leaders = scratch.save(leaders, "leaders", n * BANDS // 4)
    shared = scratch.save(bands.join(leaders, "bucket"), "shared")  # only buckets of several classes
    scratch.drop(bands)
    ids = scratch.save(shared.select("id").distinct(), "ids", n)
    sets = scratch.save(_sets(docs, ids, size), "sets")
    first = shared.select(F.col("id").alias("a"), F.col("leader").alias("b")).union(shared.select(F.col("id").alias("a"), F.col("last").alias("b"))).filter("a != b").distinct()
    first = scratch.save(first, "first")
    pairs = scratch.save(_pruned(first, classes, least), "pairs", first.count())
    links = scratch.save(_verified(pairs, sets, percent), "links", k := pairs.count())
    nodes = components(links, scratch, k)

    # Buckets that still hold several components: pairs across them, block by block, first on signatures, then on the sets of
    # those that may link.
    labelled = shared.select("bucket", "id", "n").join(nodes, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    labelled = scratch.save(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    mixed = scratch.save(mixed, "mixed", n)
    rest = scratch.save(_units(labelled.join(mixed, "bucket"), percent, scratch), "rest")
    met = scratch.save(_involved(rest.join(classes.select("id", "n", "sig"), "id"), least, percent), "met")
    more = scratch.save(_joining(met.join(classes.select("id", "n", "sig"), "id").join(sets, "id"), least, percent), "joining", n)
    if not more.isEmpty():
        nodes = components(links.union(more), scratch, k)

    found = sketch.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "id"), "digest", "left")
    found = found.join(nodes, F.col("id") == F.col("node"), "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component", "id", "doc_id")).alias("component_id")
    return found.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
