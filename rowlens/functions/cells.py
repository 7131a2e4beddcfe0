"""How two cells compare. Every rule is chosen from the static types of the two columns, so plans hold no casts that can fail.

A type belongs to one class: bool, int, float, or text. Text holds strings and every type without a class of its own (decimal, date,
timestamp, binary, nested), which compare by their written form. Cells of different classes differ, except that int and float compare
as numbers and null equals null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Tolerance:
    """Numbers closer than the larger of absolute and relative * max(|a|, |b|) are equal; the bound is inclusive."""

    absolute: float | None = None
    relative: float | None = None

    @property
    def active(self) -> bool:
        return any(x is not None and x > 0 for x in (self.absolute, self.relative))


EXACT = Tolerance()


def class_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "int"
    if isinstance(kind, T.FloatType | T.DoubleType):
        return "float"
    return "null" if isinstance(kind, T.NullType) else "text"


def is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def written(c: Column, kind: T.DataType) -> Column:
    """The text of a cell: ISO dates, T between date and time with no, 3 or 6 fraction digits, lower-case hex, JSON for nested types."""
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        us = F.date_format(c, "SSSSSS")
        fraction = F.when(us == "000000", "").when(us.endswith("000"), F.concat(F.lit("."), F.substring(us, 1, 3))).otherwise(F.concat(F.lit("."), us))
        zone = "Z" if isinstance(kind, T.TimestampType) else ""
        return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit(zone))
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if isinstance(kind, T.ArrayType | T.StructType):
        return F.to_json(c)
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    return c.cast("string")


def comparable(c: Column, kind: T.DataType) -> Column:
    """A form of a cell on which Spark's own equality is right between columns of one type."""
    name = class_of(kind)
    if name == "int":
        return c.cast("bigint")
    if name == "float":
        return c.cast("double")
    return F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c


def equal(a: Column, a_kind: T.DataType, b: Column, b_kind: T.DataType, tolerance: Tolerance = EXACT) -> Column:
    """Whether two cells are equal; never null."""
    ca, cb = class_of(a_kind), class_of(b_kind)
    if {ca, cb} <= {"int", "float"} and "float" in (ca, cb):
        x, y = a.cast("double"), b.cast("double")
        same = x.eqNullSafe(y)  # null with null, NaN with NaN, 0.0 with -0.0
        if not tolerance.active:
            return same
        bounds = []
        if tolerance.absolute is not None:
            bounds.append(F.lit(float(tolerance.absolute)))
        if tolerance.relative:  # a factor of zero times infinity would be NaN
            bounds.append(F.lit(float(tolerance.relative)) * F.greatest(F.abs(x), F.abs(y)))
        bound = F.greatest(*bounds) if len(bounds) > 1 else bounds[0]
        near = ~F.isnan(x) & ~F.isnan(y) & (bound > 0) & (F.abs(x - y) <= bound)  # Spark has NaN above all numbers, so it must be ruled out
        return same | F.coalesce(near, F.lit(False))
    if ca != cb or ca == "null":
        return a.isNull() & b.isNull()
    if ca == "text" and a_kind != b_kind:
        return written(a, a_kind).eqNullSafe(written(b, b_kind))
    return comparable(a, a_kind).eqNullSafe(comparable(b, b_kind))


def content(c: Column, kind: T.DataType, other: T.DataType) -> Column:
    """A cell in a form that both columns of a pair share, equal exactly when the contents are the same.

    Between int and float, whole numbers within bigint are ints; so 1 and 1.0 agree but 2^53 + 1 and 2.0^53 do not.
    """
    if class_of(kind) == class_of(other) and (class_of(kind) != "text" or kind == other) and class_of(kind) != "null":
        if class_of(kind) != "float":
            return comparable(c, kind)
        return c.cast("double") + F.lit(0.0)
    name = class_of(kind)
    parts = {"flag": F.lit(None).cast("boolean"), "whole": F.lit(None).cast("bigint"), "real": F.lit(None).cast("double"), "words": F.lit(None).cast("string")}
    if name == "bool":
        parts["flag"] = c
    elif name == "int":
        parts["whole"] = c.cast("bigint")
    elif name == "float":
        x = c.cast("double")
        fits = (x == F.rint(x)) & (x >= -(2.0**63)) & (x <= 2.0**63)  # 2.0^63 itself saturates to the largest bigint
        parts["whole"] = F.when(fits, F.when(x >= 2.0**63, F.lit(2**63 - 1)).otherwise(x.try_cast("bigint")))
        parts["real"] = F.when(~F.coalesce(fits, F.lit(False)), x)
    elif name == "text":
        parts["words"] = written(c, kind)
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def key_form(c: Column, kind: T.DataType, other: T.DataType) -> Column:
    """A key cell in the type that both sides' keys are matched in: their own if equal, double for numbers, else text."""
    if kind == other:
        return c.cast("double") if class_of(kind) == "float" else comparable(c, kind)
    if is_number(kind) and is_number(other):
        return c.cast("double")
    return written(c, kind)


def key_type(kind: T.DataType, other: T.DataType) -> T.DataType:
    if kind == other:
        return {"int": T.LongType(), "float": T.DoubleType()}.get(class_of(kind), kind)
    return T.DoubleType() if is_number(kind) and is_number(other) else T.StringType()
