"""Keys: inference, duplicates, and order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import comparable, key_form
from ..plans.config import DiffError
from .frames import Side

# Fixed values. Rows of each side that inference looks at: 100,000, in whole batches of 8192; and
# endings of names that are tried before others, after a column named id.
KEY_SAMPLE = 106_496
KEY_ENDINGS = ("_id", "key", "pk", "uuid")


def profile(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """One row: n, and for each column (by place) the number of distinct values and of nulls."""
    parts = []
    for i, c in enumerate(columns.values()):
        parts += [F.count_distinct(c).alias(f"d{i}"), F.count_if(c.isNull()).alias(f"n{i}")]
    return df.agg(F.count("*").alias("n"), *parts)


def candidates(names: list[str]) -> list[str]:
    """Column names in the order they are tried as a key."""
    exact = [n for n in names if n.lower() == "id"]
    likely = [n for n in names if n not in exact and n.lower().endswith(KEY_ENDINGS)]
    return exact + likely + [n for n in names if n not in exact and n not in likely]


def infer_key(left: Side, right: Side, names: list[str]) -> str | None:
    """The first single column that is unique and without nulls in both samples; an empty table has nothing against any."""
    tried, good = candidates(names), None
    for side in (left, right):
        row = profile(side.df, {n: comparable(side.column(n), side.kinds[n]) for n in tried}).first()
        fine = {n for i, n in enumerate(tried) if row[f"d{i}"] == row["n"] and row[f"n{i}"] == 0}
        good = fine if good is None else good & fine
    return next((n for n in tried if n in good), None)


def duplicate_keys(df: DataFrame, key: list[Column]) -> DataFrame:
    """k0, k1, ... and n of keys that occur more than once."""
    names = [f"k{i}" for i in range(len(key))]
    return df.select(*[c.alias(n) for c, n in zip(key, names, strict=True)]).groupBy(*names).agg(F.count("*").alias("n")).filter("n > 1")


def order_violations(df: DataFrame, block: Column, place: Column, key: list[Column]) -> DataFrame:
    """Rows whose key is below the key of the row before: place, key and previous (structs).

    Rows follow each other by (block, place). Each block is checked on its own, then the last key of each block against the first
    of the next, so no task holds more than a block, or one row for each.
    """
    rows = df.select(block.alias("block"), place.alias("place"), F.struct(*[c.alias(f"k{i}") for i, c in enumerate(key)]).alias("key"))
    inside = rows.withColumn("previous", F.lag("key").over(Window.partitionBy("block").orderBy("place")))
    ends = rows.groupBy("block").agg(F.min_by("key", "place").alias("key"), F.min("place").alias("place"), F.max_by("key", "place").alias("last"))
    between = ends.withColumn("previous", F.lag("last").over(Window.orderBy("block")))
    both = inside.select("place", "key", "previous").union(between.select("place", "key", "previous"))
    return both.filter(F.col("key") < F.col("previous"))


def check_sorted(side: Side, other: Side, key: list[str]) -> None:
    """Raise if the side's rows, in file order, are not sorted by the key. Files follow each other by path; rows without files by partition."""
    forms = [key_form(side.column(k), side.kinds[k], other.kinds[k]) for k in key]
    at = F.monotonically_increasing_id()
    try:  # a task may hold blocks of several files, in any order, but each block in order
        rows = side.df.select("*", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("_block"), at.alias("_at"))
    except AnalysisException:  # not read from files
        rows = side.df.select("*", F.shiftright(at, 33).alias("_block"), at.alias("_at"))
    if not order_violations(rows, F.col("_block"), F.col("_at"), forms).isEmpty():
        raise DiffError(f"{side.label or 'input'} is not sorted by the key ({', '.join(key)}); drop --assume-sorted")
