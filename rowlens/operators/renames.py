"""Renamed columns, found by content among those that only one side has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import content, equal
from ..plans.schema import Rename, SchemaDiff
from .frames import Side

# Fixed values. Rows of each side that are looked at: 10,000, in whole batches of 8192; and what counts as a rename.
RENAME_SAMPLE = 16_384
MIN_MATCHED, MIN_RATE = 20, 0.95  # keyed: matched keys, and share of equal values
MIN_DISTINCT, MIN_JACCARD = 8, 0.85  # keyless: distinct values on each side, and overlap of the value sets
PAIRS_AT_ONCE = 400


def keyed_scores(left: Side, right: Side, key: list[str], removed: list[str], added: list[str]) -> list[tuple[str, str, int, int]]:
    """(removed column, added column, matched keys, equal values) of each pair, on the first row of each key."""

    def first_rows(side: Side, other: Side, names: list[str], tag: str) -> DataFrame:
        keys = [content(side.column(k), side.kinds[k], other.kinds[k]).alias(f"{tag}k{i}") for i, k in enumerate(key)]
        rows = side.df.select(F.monotonically_increasing_id().alias("_at"), *keys, *[side.column(n).alias(f"{tag}{i}") for i, n in enumerate(names)])
        w = Window.partitionBy(*[f"{tag}k{i}" for i in range(len(key))]).orderBy("_at")
        return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_at")

    rows = first_rows(left, right, removed, "l").join(first_rows(right, left, added, "r"), [F.col(f"lk{i}").eqNullSafe(F.col(f"rk{i}")) for i in range(len(key))])
    out = []
    todo = [(i, j) for i in range(len(removed)) for j in range(len(added))]
    for at in range(0, len(todo), PAIRS_AT_ONCE):
        some = todo[at : at + PAIRS_AT_ONCE]
        got = rows.agg(F.count("*").alias("n"), *[F.count_if(equal(F.col(f"l{i}"), left.kinds[removed[i]], F.col(f"r{j}"), right.kinds[added[j]])).alias(f"e{k}") for k, (i, j) in enumerate(some)]).first()
        out += [(removed[i], added[j], got["n"], got[f"e{k}"]) for k, (i, j) in enumerate(some)]
    return out


def jaccard_scores(left: Side, right: Side, removed: list[str], added: list[str]) -> list[tuple[str, str, int, int, int]]:
    """(removed column, added column, distinct left, distinct right, common) of each pair; null is a value."""
    names = [(a, b) for a in removed for b in added]
    values = [(content(left.column(a), left.kinds[a], right.kinds[b]), content(right.column(b), right.kinds[b], left.kinds[a])) for a, b in names]
    by_kind: dict[str, list[int]] = {}
    for i, kind in enumerate(left.df.select(*[v[0].alias(f"v{i}") for i, v in enumerate(values)]).schema):
        by_kind.setdefault(kind.dataType.simpleString(), []).append(i)
    found = {}
    for some in by_kind.values():  # one pass over both sides for all pairs whose values have one type
        x, y = (side.df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), values[i][s].alias("v")) for i in some])).alias("x")).select("x.*", F.lit(1 - s).alias("l"), F.lit(s).alias("r")) for s, side in enumerate((left, right)))
        each = x.union(y).groupBy("pair", "v").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        for r in each.groupBy("pair").agg(F.sum("l").alias("l"), F.sum("r").alias("r"), F.count_if((F.col("l") + F.col("r")) == 2).alias("both")).collect():  # a row for each pair
            found[r["pair"]] = (r["l"], r["r"], r["both"])
    return [(a, b, *found.get(i, (0, 0, 0))) for i, (a, b) in enumerate(names)]


def assign(scored: list[tuple[str, str, float]]) -> list[Rename]:
    """One partner for each column, best pairs first; of equal pairs the first given."""
    out, used = [], set()
    for a, b, score in sorted(scored, key=lambda x: -x[2]):
        if ("l", a) not in used and ("r", b) not in used:
            used |= {("l", a), ("r", b)}
            out.append(Rename(a, b, score))
    return out


def detect_renames(left: Side, right: Side, schema: SchemaDiff, key: list[str] | None) -> list[Rename]:
    removed, added = [c.name for c in schema.removed], [c.name for c in schema.added]
    if not removed or not added:
        return []
    if key is not None:
        found = keyed_scores(left, right, key, removed, added)
        return assign([(a, b, e / n) for a, b, n, e in found if n >= MIN_MATCHED and e / n >= MIN_RATE])
    found = [(a, b, l, r, both / (l + r - both)) for a, b, l, r, both in jaccard_scores(left, right, removed, added) if min(l, r) >= MIN_DISTINCT]
    return assign([(a, b, j) for a, b, _, _, j in found if j >= MIN_JACCARD])
