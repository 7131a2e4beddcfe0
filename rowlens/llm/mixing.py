"""Mixing sources to target weights by the cube method.

Each source gets a target of words. A document's expected number of copies is its source's target over its size, so the
whole copies are certain and the fraction is an inclusion probability. The cube method rounds these fractions: it moves
the probabilities of a few documents at a time along the null space of the balancing constraints (words and documents),
so both totals stay exact, until at most two documents of a group are still open. Groups of bounded size are rounded in
parallel, their open documents meet in the next round, and the last few, with ten that were held back, are landed by
trying all their roundings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

SHARE = 1.5
WEIGHTS = (3, 1, 2)
MOST = 2.0
HELD = 10  # documents of a source that wait for the landing problem, of at most HELD + 2 documents
GROUP = 1024  # documents of one flight: ids, sizes and probabilities only


def targets(sizes: dict, share: float = SHARE, weights=WEIGHTS, most: float = MOST) -> dict:
    """Words for each source: its share by weight, at most most times its size; the excess goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), list(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase over one group: probabilities moved to 0 or 1 with sum(p) and sum(p * size) kept; at most 2 stay open.

    Three open documents always have a direction that changes neither total; a step along it, forwards or backwards with
    the odds that keep each expectation, ends with at least one of them at 0 or 1.
    """
    p, scale = p.astype(float).copy(), max(1.0, float(size.max(initial=1)))
    x = size / scale
    active: list[int] = []
    for i in np.flatnonzero((p > 0) & (p < 1)):
        active.append(int(i))
        while len(active) == 3:
            a, b, c = active
            u = np.array([x[b] - x[c], x[c] - x[a], x[a] - x[b]])
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
            q = p[active]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min()
                down = np.where(u < 0, (q - 1) / u, np.where(u > 0, q / u, np.inf)).min()
            q = q + u * up if rng.random() * (up + down) < down else q - u * down
            q[np.abs(q) < 1e-9], q[np.abs(q - 1) < 1e-9] = 0.0, 1.0
            p[active] = q
            active = [k for k, v in zip(active, q, strict=True) if 0 < v < 1]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rounding of the last few open documents that comes nearest to their expected words, and then documents."""
    at = np.flatnonzero((p > 0) & (p < 1))
    if not len(at):
        return p
    ways = (np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1).astype(float)
    words, docs = ways @ size[at] - p[at] @ size[at], ways.sum(axis=1) - p[at].sum()
    p = p.copy()
    p[at] = ways[np.argmin(np.abs(words) + 0.02 * size[at].mean() * np.abs(docs))]
    return p


def _round(pdf: pd.DataFrame, land: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable", na_position="last")
    rng = np.random.default_rng(int(pdf["group"].iloc[0]) & 0xFFFFFFFF)
    size, p = pdf["size"].to_numpy(dtype=float), pdf["p"].to_numpy(dtype=float)
    flies = np.ones(len(p), dtype=bool)
    if pdf["group"].iloc[0] == 0:  # one group of each source holds a few documents back for the landing
        flies[np.argsort(pdf["order"].to_numpy(), kind="stable")[:HELD]] = False
    p[flies] = flight(p[flies], size[flies], rng)
    return pdf.assign(p=landing(p, size) if land else p)


def source_targets(sources: DataFrame, scratch: Scratch, share: float = SHARE, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size and target of each source, as in targets(), for any number of them; sources has source and n, its words.

    Ranks are counted by ranges of names. The level to which all sources are filled is found by closing, step by step, those that it
    would take above their bound: one aggregation a step, of which the driver gets one row.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = scratch.save(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")
    ahead = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = ranged.groupBy("part").agg(F.count("*").alias("k")).select("part", ahead.alias("ahead"))  # a row for each shuffle partition
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("ahead")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    known = scratch.save(ranged.join(before, "part").withColumn("weight", weight), "weighted")
    over, closed, total = F.lit(False), -1, None
    while True:
        row = known.agg(F.sum("n").alias("n"), F.sum(F.when(over, F.col("n"))).alias("closed_n"), F.sum(F.when(over, 1)).alias("closed"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if (row["closed"] or 0) == closed or not row["open"]:
            break
        total, closed = int(row["n"]), row["closed"] or 0
        unit = (share * total - most * int(row["closed_n"] or 0)) / row["open"]
        over = F.lit(unit) * F.col("weight") > F.lit(most) * F.col("n")
    if total is None:  # no sources
        unit = 0.0
    return known.select("source", F.col("n").alias("source_size"), "docs", F.when(over, F.lit(most) * F.col("n")).otherwise(F.lit(unit) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, scratch: Scratch, share: float = SHARE, weights=WEIGHTS, most: float = MOST, group: int = GROUP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of each row of docs.

    docs needs doc_id, source and text. A null text has size 0; a null source is a source of its own, last in order. A
    document of size 0 takes no words and gets no copies. Repeated rows are sampled each for itself, told apart by their number. An empty table, or
    one without words, gives targets of 0. The choice depends on ids, sources and sizes alone, not on partitions, so reruns agree.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # Rows alike in id, source and size are counted and told apart by number: however many there are, they fly in groups of their own.
    rows = scratch.save(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "sized")
    sources = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("n"), F.sum("times").alias("docs"))
    known = source_targets(sources, scratch, share, weights, most)
    known = known.withColumn("pi", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("docs") / group)).cast("long"))
    known = scratch.save(known.select(F.col("source").alias("_source"), "source_size", "target", "pi", "parts"), "known")
    out = rows.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    out = out.withColumn("base", F.floor("pi")).withColumn("p", F.when(F.col("size") > 0, F.col("pi") - F.col("base")).otherwise(0.0))
    out = out.withColumn("order", F.xxhash64("doc_id", "source", "size", "number")).withColumn("group", F.pmod(F.col("order"), F.col("parts")))
    cols = "doc_id, source, size, source_size, target, pi, parts, base, p, order, group".split(", ")
    out, types = out.select(*cols), dict(out.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in cols)
    flown = scratch.save(out.filter("p > 0").groupBy("source", "group").applyInPandas(lambda pdf: _round(pdf, False), schema), "flight")
    settled = [out.filter("p <= 0"), flown.filter("p = 0 or p = 1")]
    parts, still = known.agg(F.max("parts")).first()[0] or 1, flown.filter("p > 0 and p < 1")
    while parts > 1:  # two open documents of each group meet in groups of the next round
        parts = -(-parts // (group // 2))
        flown = scratch.save(still.withColumn("group", F.pmod(F.shiftright("order", 8), F.lit(parts))).groupBy("source", "group").applyInPandas(lambda pdf: _round(pdf, False), schema), "flight")
        settled.append(flown.filter("p = 0 or p = 1"))
        still = flown.filter("p > 0 and p < 1")
    settled.append(still.withColumn("group", F.lit(0).cast("long")).groupBy("source").applyInPandas(lambda pdf: _round(pdf, True), schema))
    done = settled[0]
    for x in settled[1:]:
        done = done.unionByName(x)
    copies = F.when(F.col("size") > 0, F.col("base") + F.col("p").cast("long")).otherwise(F.lit(0)).cast("long")
    return done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
