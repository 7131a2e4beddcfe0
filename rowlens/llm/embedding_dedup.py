"""Embedding near-deduplication by cross-polytope hashing.

A vector is rotated by sign flips and fast Hadamard transforms; the coordinate of largest magnitude, with its sign, names the nearest vertex
of the cross-polytope. FUNCTIONS such vertices make the bucket of one table, and each vector also goes to the buckets it nearly
fell in (multiprobe). Pairs that meet in two tables, and whose signs on random projections nearly agree, are candidates and are verified in double
precision. Functions grow with the logarithm of the number of vectors, and tables with them, by the measured chance to meet at the threshold.

Vectors that crowd together are first gathered in balls of less than half the linking angle, whose members are all linked;
tables, candidates and most verifications then handle one row for each ball, so thousands of copies cost no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, tidy
from .graph import components

TABLES, FUNCTIONS, PROBES, NEAR = 12, 3, 8, 3
MEET = 2  # tables in which a pair must meet
MISSED = 2e-5  # share of pairs at the linking angle that may be missed, whatever the number and width of vectors
MOST_TABLES = 4096 - 3  # of the bucket's 12 bits for tables, those of the balls apart
BALL_ROUNDS = 3
BLOCK, SPOTS = 256, 1024  # vectors of a block of a ball, and balls of a block of a bucket, that are compared in one go
SIGNS, SIGMAS = 128, 6.0  # signs of projections that must nearly agree before vectors are compared: 1e-9 of the pairs at the threshold are lost


@lru_cache(maxsize=64)
def collision_chance(functions: int, d: int, least: float) -> float:
    """Chance that a table brings a pair at a cosine of least together, less three standard errors: tried on 4,000 pairs of fixed seed."""
    rng = np.random.default_rng(11)
    a, z = rng.normal(size=(2, 500, d))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = least * a + math.sqrt(max(0.0, 1 - least * least)) * z
    met = np.array([(table_buckets(a, t, functions)[:, :, None] == table_buckets(b, t, functions)[:, None, :]).any(axis=(1, 2)) for t in range(8)])
    return met.mean() - 3 * math.sqrt(met.mean() * (1 - met.mean()) / met.size)


def parameters(n: int, width: int, least: float = 0.9) -> tuple[int, int]:
    """Functions and tables for n vectors of at most width components: 32 buckets for each vector at least, so that chance meetings
    stay few, and as many tables as keep the pairs missed at a cosine of least below MISSED."""
    d = max(2, width)
    functions = max(FUNCTIONS, math.ceil(math.log(32 * max(1, n)) / math.log(2 << (d - 1).bit_length())))
    p, tables = collision_chance(functions, d, least), TABLES
    while p <= 0 or (1 - p) ** tables + tables * p * (1 - p) ** (tables - 1) > MISSED:
        tables += 1
        if p <= 0 or tables > MOST_TABLES:
            raise ValueError(f"a cosine of {least} is too low for hashing vectors of {width} components")
    return functions, tables


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows of x (a power of two wide), unscaled."""
    n, width, h = x.shape[0], x.shape[1], 1
    while h < width:
        y = x.reshape(n, width // (2 * h), 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(n, width)
        h *= 2
    return x


@lru_cache(maxsize=64)
def _ways(functions: int, near: int, probes: int) -> tuple[tuple[int, ...], ...]:
    """Choices of a vertex (0 the nearest) by each function that can be among the best probes: of a choice that goes l_1, l_2, ... vertices
    down, (l_1 + 1) (l_2 + 1) ... - 1 others cost no more."""
    found: list[tuple[tuple[int, ...], int]] = [((), 1)]
    for _ in range(functions):
        found = [((*w, k), n * (k + 1)) for w, n in found for k in range(near) if n * (k + 1) <= probes]
    return tuple(w for w, _ in found)


def table_buckets(unit: np.ndarray, table: int, functions: int = FUNCTIONS, probes: int = PROBES) -> np.ndarray:
    """Buckets of each row of unit in a table, its own first, then those it nearly fell in."""
    n, d = unit.shape
    width = 1 << max(0, (d - 1).bit_length())
    near = min(NEAR, width)
    ways = _ways(functions, near, probes)
    cost, keys = np.zeros((n, len(ways))), np.zeros((n, len(ways)), dtype=np.uint64)
    for f in range(functions):
        rng = np.random.default_rng([table, f, d])
        x = np.zeros((n, width))
        x[:, :d] = unit
        for _ in range(3):
            x = hadamard(x * rng.choice([-1.0, 1.0], width)) / math.sqrt(width)
        size = np.abs(x)
        order = np.argsort(-size, axis=1, kind="stable")[:, :near]
        best = np.take_along_axis(size, order, axis=1)
        top = (order * 2 + (np.take_along_axis(x, order, axis=1) < 0)).astype(np.uint64) * rng.integers(1, 1 << 63, dtype=np.uint64) * np.uint64(2)
        at = [w[f] for w in ways]
        cost += ((best[:, :1] - best) ** 2)[:, at]
        keys += top[:, at]
    chosen = np.argsort(cost, axis=1, kind="stable")[:, :probes]
    out = np.take_along_axis(keys, chosen, axis=1) * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    return ((out << np.uint64(25)).view(np.int64) + (table << 13)) + d % 8192  # the dimension keeps vectors of unlike length apart


def simhash(unit: np.ndarray) -> np.ndarray:
    """SIGNS signs of random projections of each row, as pairs of signed 64-bit numbers."""
    signs = unit @ np.random.default_rng([7, unit.shape[1]]).normal(size=(unit.shape[1], SIGNS)) > 0
    return np.packbits(signs, axis=1).view(np.int64)


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Unit vectors in double precision; None for what links with nothing."""
    out: list[np.ndarray | None] = [None] * len(column)
    size = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()])
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)  # a null component becomes nan
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)
        x = x[good] / top[good, None]
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        for i, row in zip(at[good].tolist(), x, strict=True):
            out[i] = row
    return out


def _matrix(column) -> np.ndarray:
    """Unit vectors stored as bytes, all of one dimension, as rows."""
    rows = list(column)
    return np.frombuffer(b"".join(rows), dtype=np.float64).reshape(len(rows), -1) if rows else np.empty((0, 0))


def _prepare(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = [None if u is None else u.tobytes() for u in _units(b.column("embedding"))]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("vec_id"), pa.array(units, type=pa.binary())], names=["rid", "vec_id", "unit"])

    return vectors.mapInArrow(tidy(run), f"rid long, vec_id {dict(vectors.dtypes)['vec_id']}, unit binary")


def _hashed(units: DataFrame, tables: range, functions: int, probes: int) -> DataFrame:
    """rid (and ball, if there) and bucket: a row for each table and probe."""
    carry = [c for c in ("rid", "ball") if c in units.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                raw = b.column("unit").to_pylist()
                size = np.array([len(x) for x in raw])
                for s in np.unique(size):
                    at = np.flatnonzero(size == s)
                    x = _matrix([raw[i] for i in at])
                    for t in tables:
                        got = table_buckets(x, t, functions, probes)
                        rows = pa.array(np.repeat(at, got.shape[1]))
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in carry), pa.array(got.reshape(-1))], names=[*carry, "bucket"])

    return units.select(*carry, "unit").mapInArrow(tidy(run), ", ".join(f"{c} long" for c in carry) + ", bucket long")


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _compared(pairs: DataFrame, carry: str) -> DataFrame:
    """pairs with the cosine of unit and other; carry lists the columns kept, as a schema."""
    names = [c.split()[0] for c in carry.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = b.column("unit").to_pylist(), b.column("other").to_pylist()
            cos, size = np.zeros(len(a)), np.array([len(x) for x in a])
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                cos[at] = _cosines(_matrix([a[i] for i in at]), _matrix([c[i] for i in at]))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(cos)], names=[*names, "cosine"])

    return pairs.select(*names, "unit", "other").mapInArrow(tidy(run), f"{carry}, cosine double")


def _signed(balls: DataFrame) -> DataFrame:
    """ball, r, s1, s2: the radius and the signs of projections of each ball's centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("unit").to_pylist()
            size, signs = np.array([len(x) for x in raw]), np.zeros((len(raw), 2), dtype=np.int64)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                signs[at] = simhash(_matrix([raw[i] for i in at]))
            yield pa.RecordBatch.from_arrays([b.column("ball"), b.column("r"), pa.array(signs[:, 0]), pa.array(signs[:, 1])], names=["ball", "r", "s1", "s2"])

    return balls.select("ball", "r", "unit").mapInArrow(tidy(run), "ball long, r double, s1 long, s2 long")


def _meetings(spots: DataFrame, full: float) -> DataFrame:
    """bucket, p, q of balls (p < q) that share a bucket and whose signs are near enough; spots has bucket, ball, r, s1, s2, n (balls of the bucket).

    A large bucket is compared block against block. Signs differ by the angle's share of half a turn, give or take: SIGMAS deviations are allowed.
    """
    blocks = F.ceil(F.col("n") / SPOTS).cast("int")
    rows = spots.withColumn("own", F.pmod(F.xxhash64("ball"), blocks).cast("int"))
    sides = []
    for suffix, span in (("a", F.sequence(F.col("own"), blocks - 1)), ("b", F.sequence(F.lit(0), F.col("own")))):
        x = rows.filter(blocks == 1).withColumn("their", F.lit(0)).union(rows.filter(blocks > 1).withColumn("their", F.explode(span)))
        i, j = ("own", "their") if suffix == "a" else ("their", "own")
        sides.append(x.select("bucket", F.col(i).alias("i"), F.col(j).alias("j"), *[F.col(c).alias(f"{c}_{suffix}") for c in ("ball", "r", "s1", "s2")]))
    share = f"(({full} + r_a + r_b) / pi())"
    close = F.expr(f"bit_count(s1_a ^ s1_b) + bit_count(s2_a ^ s2_b) <= {SIGNS} * {share} + {SIGMAS} * sqrt({SIGNS} * {share} * greatest(0.0, 1 - {share}))")
    met = sides[0].join(sides[1], ["bucket", "i", "j"]).filter(F.expr("(i < j or ball_a < ball_b) and ball_a != ball_b") & close)
    return met.select("bucket", F.least("ball_a", "ball_b").alias("p"), F.greatest("ball_a", "ball_b").alias("q"))


def _counted(rows: DataFrame, least: float) -> DataFrame:
    """Of each block pair of two balls' members (p, q, side, rid, unit): rid, n of linked vectors; ball pairs stay in p, q."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"p": [], "q": [], "rid": [], "n": []}).astype("int64")
        x, y = _matrix(a["unit"]), _matrix(b["unit"])
        cos = x @ y.T
        i, j = np.nonzero(np.abs(cos - least) < 1e-12)  # at the threshold the same sum as elsewhere decides
        cos[i, j] = _cosines(x[i], y[j])
        hit = cos >= least
        out = pd.DataFrame({"rid": np.concatenate([a["rid"], b["rid"]]), "n": np.concatenate([hit.sum(axis=1), hit.sum(axis=0)])})
        return out[out["n"] > 0].assign(p=pdf["p"].iloc[0], q=pdf["q"].iloc[0])[["p", "q", "rid", "n"]]

    return rows.groupBy("p", "q", "i", "j").applyInPandas(run, "p long, q long, rid long, n long")


def embedding_dedup(vectors: DataFrame, scratch: Scratch, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of vectors.

    vectors needs vec_id and embedding (numbers of any precision); other columns are ignored. Vectors link from a cosine of least, which
    must be above 0; only vectors of one dimension link. Null and empty vectors, zero vectors and those with null or
    non-finite components have no links. Repeated rows are vectors of their own and link with each other. component_id is
    the smallest vec_id reachable, null if there is none; kept marks the rows whose vec_id that is. An empty table gives
    no rows. No false links are reported; a link is missed if its pair meets in fewer than MEET tables, of which there
    are as many as keep the chance of that below MISSED.
    """
    full, angle = math.acos(least), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine"))))
    rows = vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "embedding")
    base = scratch.save(_prepare(rows), "units")
    units = base.filter("unit is not null").select("rid", "unit")
    seen = units.agg(F.count("*").alias("n"), F.max(F.octet_length("unit")).alias("bytes")).first()
    functions, tables = parameters(seen["n"], (seen["bytes"] or 16) // 8, least)

    # Balls: in a bucket of one table, all that lie within half the linking angle of its first vector.
    owner, loose = None, units
    for round_ in range(BALL_ROUNDS):
        homes = scratch.save(_hashed(loose, range(tables + round_, tables + round_ + 1), functions, 1).join(loose, "rid"), "homes")
        first = scratch.save(homes.groupBy("bucket").agg(F.min(F.struct("rid", "unit")).alias("x"), F.count("*").alias("n")).filter("n > 1").select("bucket", F.col("x.rid").alias("ball"), F.col("x.unit").alias("other")), "first")
        near = _compared(homes.join(first, "bucket"), "rid long, ball long").select("rid", "ball", angle.alias("angle")).filter(F.col("angle") <= full / 2 - 1e-6)
        near = scratch.save(near, "near")
        grown = near.groupBy("ball").agg(F.count("*").alias("n")).filter("n > 1").select("ball")
        near = near.join(scratch.save(grown, "grown"), "ball").select("rid", "ball", "angle")
        owner = near if owner is None else owner.union(near)
        loose = scratch.save(loose.join(near.select("rid"), "rid", "left_anti"), "loose")
    owner = scratch.save(owner.union(loose.select("rid", F.col("rid").alias("ball"), F.lit(0.0).alias("angle"))), "owner")
    members = scratch.save(units.join(owner, "rid"), "members")
    balls = owner.groupBy("ball").agg(F.count("*").alias("m"), F.max("angle").alias("r"))
    balls = scratch.save(balls.join(units, F.col("ball") == F.col("rid")).select("ball", "m", "r", "unit"), "balls")

    # Candidates: balls that meet in at least MEET tables.
    spots = scratch.save(_hashed(members.select("rid", "ball", "unit"), range(tables), functions, PROBES).select("bucket", "ball").distinct(), "spots")
    busy = scratch.save(spots.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "busy")
    spots = scratch.save(spots.join(busy, "bucket").join(_signed(balls), "ball"), "busy-spots")
    table, masks = "cast(shiftright(bucket, 13) & 4095 as int)", [f"tables_{i}" for i in range(math.ceil(tables / 64))]
    met = _meetings(spots, full).select("p", "q", F.expr(table).alias("table"))
    met = met.groupBy("p", "q").agg(*[F.bit_or(F.expr(f"case when table div 64 = {i} then shiftleft(1L, table % 64) else 0L end")).alias(m) for i, m in enumerate(masks)])
    pairs = scratch.save(met.filter(reduce(add, [F.bit_count(m) for m in masks]) >= MEET).select("p", "q"), "pairs")
    sides = [balls.select(F.col("ball").alias(k), F.col("m").alias(f"m_{k}"), F.col("r").alias(f"r_{k}"), F.col("unit").alias(u)) for k, u in (("p", "unit"), ("q", "other"))]
    met = _compared(pairs.join(sides[0], "p").join(sides[1], "q"), "p long, q long, m_p long, m_q long, r_p double, r_q double").withColumn("angle", angle)
    met = scratch.save(met.withColumn("far", F.col("angle") + F.col("r_p") + F.col("r_q")).withColumn("close", F.col("angle") - F.col("r_p") - F.col("r_q")), "met")
    single = (F.col("m_p") == 1) & (F.col("m_q") == 1)
    sure = F.when(single, F.col("cosine") >= least).otherwise(F.col("far") <= full - 1e-7)
    all_linked = met.filter(sure)
    open_ = met.filter(~sure & ~single & (F.col("close") <= full + 1e-7)).select("p", "q", "m_p", "m_q")
    open_ = scratch.save(open_, "open")

    # Balls that the angles leave open: their members, block against block.
    blocks = lambda k: F.ceil(F.col(f"m_{k}") / BLOCK).cast("int")
    parts = []
    for side, (mine, other) in enumerate((("p", "q"), ("q", "p"))):
        x = open_.join(members.withColumnRenamed("ball", mine), mine).withColumn("own", F.pmod(F.xxhash64("rid"), blocks(mine)).cast("int"))
        x = x.withColumn("their", F.explode(F.sequence(F.lit(0), blocks(other) - 1)))
        i, j = ("own", "their") if side == 0 else ("their", "own")
        parts.append(x.select("p", "q", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(side).alias("side"), "rid", "unit"))
    counted = scratch.save(_counted(parts[0].union(parts[1]), least), "counted")

    links = all_linked.select(F.col("p").alias("a"), F.col("q").alias("b")).union(counted.select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
    nodes = components(links, scratch)
    whole = all_linked.select(F.col("p").alias("ball"), F.col("m_q").alias("k")).union(all_linked.select(F.col("q").alias("ball"), F.col("m_p").alias("k"))).groupBy("ball").agg(F.sum("k").alias("k"))
    single_counts = counted.groupBy("rid").agg(F.sum("n").alias("n"))
    found = owner.select("rid", "ball").join(scratch.save(balls.select("ball", "m").join(whole, "ball", "left").join(nodes, F.col("ball") == F.col("node"), "left").select("ball", (F.col("m") - 1 + F.coalesce("k", F.lit(0))).alias("k"), F.coalesce("component", "ball").alias("part")), "ball-sums"), "ball")
    found = scratch.save(base.select("rid", "vec_id").join(found, "rid", "left").join(single_counts, "rid", "left").select("rid", "vec_id", (F.coalesce("k", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.coalesce("part", "rid").alias("part")), "found")
    least_id = scratch.save(found.groupBy("part").agg(F.min("vec_id").alias("component_id")), "least-id")
    out = found.join(least_id, "part")
    return out.select("vec_id", "n_links", "component_id").withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
