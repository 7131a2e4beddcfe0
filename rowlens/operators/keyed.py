"""Keyed comparison: a full outer join on a unique, null-safe key with a typed inequality for each column.

Each side is shuffled and sorted once by its key; a window over that same layout finds keys that occur twice and leaves one row per key, and
the join needs no further exchange or sort. Null keys match each other: a key column becomes a value without nulls and a flag.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import Tolerance, equal, key_form, key_type
from .frames import Side


@dataclass(frozen=True)
class Pair:
    """A compared column: label in reports, and its name on either side."""

    label: str
    left: str
    right: str


@dataclass(frozen=True)
class KeyedPlan:
    """rows: one row per key with change (added, removed, modified, same), duplicate flags, the key, both sides' values, and differs (booleans by pair)."""

    rows: DataFrame
    key: list[str]
    pairs: list[Pair]
    order: list[str]


def _filler(kind: T.DataType) -> Column | None:
    """A value to stand for null in a key column, where a plain literal can."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return F.lit("1970-01-01").cast(kind)
    return F.lit(b"") if isinstance(kind, T.BinaryType) else None


def _one_per_key(side: Side, other: Side, key: list[str], names: list[str], tag: str) -> tuple[DataFrame, list[str]]:
    columns, places = [], []
    for i, k in enumerate(key):
        form, filler = key_form(side.column(k), side.kinds[k], other.kinds[k]), _filler(key_type(side.kinds[k], other.kinds[k]))
        if filler is None:  # nested: a struct compares null-safe as it is
            columns.append(F.struct(form.alias("x")).alias(f"{tag}k{i}"))
            places.append(f"{tag}k{i}")
        else:
            columns += [form.isNotNull().alias(f"{tag}n{i}"), F.coalesce(form, filler).alias(f"{tag}k{i}")]
            places += [f"{tag}n{i}", f"{tag}k{i}"]
    values = F.struct(*[side.column(n).alias(f"v{j}") for j, n in enumerate(names)]) if names else F.struct(F.lit(1).alias("none"))
    w = Window.partitionBy(*places).orderBy(*places)
    # Neighbours, not a rank: a filter on a rank would be planned as a limit with a sort of its own before the shuffle.
    rows = side.df.select(*columns, values.alias(f"{tag}row")).withColumn(f"{tag}again", F.lag(F.lit(True)).over(w)).withColumn(f"{tag}twice", F.lead(F.lit(True)).over(w).isNotNull())
    return rows.filter(F.col(f"{tag}again").isNull()).withColumn(f"{tag}here", F.lit(True)), places


def _key_struct(places: list[str], mine: str, other: str) -> Column:
    """The key as matched (k0, k1, ...), from whichever side has the row."""
    out = []
    for name in [n for n in places if n.startswith(f"{mine}k")]:
        k = F.coalesce(F.col(name), F.col(other + name.removeprefix(mine)))
        flag = name.replace("_k", "_n")
        k = F.when(F.coalesce(F.col(flag), F.col(other + flag.removeprefix(mine))), k) if flag in places else k["x"]
        out.append(k.alias(name.removeprefix(mine)))
    return F.struct(*out).alias("key")


def compare_keyed(left: Side, right: Side, key: list[str], pairs: list[Pair], tolerance: Tolerance) -> KeyedPlan:
    a, a_key = _one_per_key(left, right, key, [p.left for p in pairs], "a_")
    b, b_key = _one_per_key(right, left, key, [p.right for p in pairs], "b_")
    on = [F.col(x) == F.col(y) for x, y in zip(a_key, b_key, strict=True)]
    rows = a.join(b, on, "full_outer")
    in_a, in_b = F.col("a_here").isNotNull(), F.col("b_here").isNotNull()
    differs = [~equal(F.col("a_row")[f"v{j}"], left.kinds[p.left], F.col("b_row")[f"v{j}"], right.kinds[p.right], tolerance) for j, p in enumerate(pairs)]
    flags = F.array(*differs) if differs else F.array().cast("array<boolean>")
    rows = rows.withColumn("differs", F.when(in_a & in_b, flags))
    change = F.when(~in_a, "added").when(~in_b, "removed").when(F.exists("differs", lambda x: x), "modified").otherwise("same")
    order = [f"o{i}" for i in range(len(a_key))]
    rows = rows.select(
        change.alias("change"), in_a.alias("in_left"), in_b.alias("in_right"), F.coalesce("a_twice", F.lit(False)).alias("left_twice"), F.coalesce("b_twice", F.lit(False)).alias("right_twice"),
        *[F.coalesce(F.col(x), F.col(y)).alias(o) for x, y, o in zip(a_key, b_key, order, strict=True)],
        _key_struct(a_key, "a_", "b_"), F.col("a_row").alias("left_row"), F.col("b_row").alias("right_row"), "differs",
    )
    return KeyedPlan(rows, key, pairs, order)


def keyed_totals(plan: KeyedPlan, rows: DataFrame | None = None) -> DataFrame:
    """One row: rows on each side, keys that occur twice, added, removed, modified, and changed (an array by pair)."""
    rows = plan.rows if rows is None else rows
    hits = [F.coalesce(F.count_if(F.coalesce(F.get("differs", F.lit(j)), F.lit(False))), F.lit(0)) for j in range(len(plan.pairs))]
    return rows.agg(
        F.count_if("in_left").alias("n_left"), F.count_if("in_right").alias("n_right"), F.count_if("left_twice").alias("left_twice"), F.count_if("right_twice").alias("right_twice"),
        *[F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified")],
        (F.array(*hits) if hits else F.array().cast("array<bigint>")).alias("changed"),
    )


def keyed_samples(plan: KeyedPlan, most: int) -> DataFrame:
    """The first rows of each kind of change in key order; each task passes on no more than it could contribute."""
    w = Window.partitionBy("change").orderBy(*[F.col(o).asc_nulls_first() for o in plan.order])
    return plan.rows.filter(F.col("change") != "same").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def first_differences(plan: KeyedPlan, most: int) -> DataFrame:
    """The first differences in key order, of any kind."""
    return plan.rows.filter(F.col("change") != "same").orderBy(*[F.col(o).asc_nulls_first() for o in plan.order]).limit(most)
