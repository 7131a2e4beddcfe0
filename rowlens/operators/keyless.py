"""Keyless comparison: multiset difference in both directions by one aggregation over the union of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import content
from .frames import Side
from .keyed import Pair


def compare_keyless(left: Side, right: Side, pairs: list[Pair]) -> DataFrame:
    """c0, c1, ... (contents by pair), n_left and n_right of each distinct row."""
    cells = lambda side, other, mine, theirs: [content(side.column(getattr(p, mine)), side.kinds[getattr(p, mine)], other.kinds[getattr(p, theirs)]).alias(f"c{i}") for i, p in enumerate(pairs)]
    a = left.df.select(*cells(left, right, "left", "right"), F.lit(1).cast("long").alias("l"), F.lit(0).cast("long").alias("r"))
    b = right.df.select(*cells(right, left, "right", "left"), F.lit(0).cast("long").alias("l"), F.lit(1).cast("long").alias("r"))
    return a.union(b).groupBy(*[f"c{i}" for i in range(len(pairs))]).agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"))


def keyless_totals(groups: DataFrame) -> DataFrame:
    """One row: rows on each side, removed and added row instances."""
    gone, new = F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0)), F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return groups.agg(total(F.col("n_left")).alias("n_left"), total(F.col("n_right")).alias("n_right"), total(gone).alias("removed"), total(new).alias("added"))


def keyless_differences(groups: DataFrame, width: int) -> DataFrame:
    """Distinct rows that one side has more often: change, instances, and the contents, with columns to order by."""
    out = groups.filter("n_left != n_right").withColumn("change", F.when(F.col("n_left") > F.col("n_right"), "removed").otherwise("added"))
    return out.withColumn("instances", F.abs(F.col("n_left") - F.col("n_right"))).select("change", "instances", *[f"c{i}" for i in range(width)])


def order_of(width: int, kinds: dict[str, str]) -> list:
    """Columns to order contents by; maps, which have no order, by their text."""
    return [(F.to_json(f"c{i}") if "map<" in kinds[f"c{i}"] else F.col(f"c{i}")).asc_nulls_first() for i in range(width)]
