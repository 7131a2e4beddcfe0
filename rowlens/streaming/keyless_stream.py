"""Running keyless differences of two streams: an extra that the batch comparison does not need.

Rows of both streams are tagged +1 and -1 and summed by content in stateful storage; a content whose sum is not zero is a difference so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import content
from ..operators.frames import Side
from ..plans.schema import compare_schemas


def keyless_balance(left: DataFrame, right: DataFrame) -> DataFrame:
    """The shared columns' contents and balance (left minus right instances); streams or tables, by update or complete output."""
    a, b = Side.of(left, "l"), Side.of(right, "r")
    names = compare_schemas(left.schema, right.schema).mutual
    rows = lambda side, other, sign: side.df.select(*[content(side.column(n), side.kinds[n], other.kinds[n]).alias(n) for n in names], F.lit(sign).cast("long").alias("_sign"))
    return rows(a, b, 1).union(rows(b, a, -1)).groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.sum("_sign").alias("balance"))
