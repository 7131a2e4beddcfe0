"""Cell comparison against a model in plain Python, which does not share Spark's order of NaN."""

import math
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.functions.cells import Tolerance, class_of, content, equal, key_form, written


def same(a, b, absolute=None, relative=None):
    if a is None or b is None:
        return a is None and b is None
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    if number(a) and number(b):
        if isinstance(a, int) and isinstance(b, int):
            return a == b
        a, b = float(a), float(b)
        if a == b or (math.isnan(a) and math.isnan(b)):
            return True
        bound = 0.0 if absolute is None else absolute
        if relative:
            scaled = relative * max(abs(a), abs(b))
            bound = scaled if math.isnan(bound) else max(bound, scaled)
        return bound > 0 and abs(a - b) <= bound
    return type(a) is type(b) and a == b


VALUES = [None, 0.0, -0.0, 1.0, 1.5, 1.25, -1.0, 1e300, -1e300, 5e-324, float("nan"), float("inf"), float("-inf"), 2.0**63, 100.0, 100.05, 99.95]
TOLERANCES = [(a, r) for a in (None, 0.0, -1.0, 0.1, float("inf")) for r in (None, 0.0, -1.0, 0.001, float("inf"))]


def test_float_cells_match_the_model(spark):
    rows = [(a, b) for a, b in product(VALUES, repeat=2)]
    df = spark.createDataFrame(rows, "a double, b double")
    d = T.DoubleType()
    got = df.select("a", "b", *[equal(F.col("a"), d, F.col("b"), d, Tolerance(*t)).alias(f"t{i}") for i, t in enumerate(TOLERANCES)]).collect()
    for r in got:
        for i, (absolute, relative) in enumerate(TOLERANCES):
            if relative is not None and relative < 0:
                relative = None if absolute is None else relative
            want = same(r["a"], r["b"], absolute, relative if relative is None or relative > 0 else None)
            assert r[f"t{i}"] == want, (r["a"], r["b"], TOLERANCES[i])


CLASSES = {"flag": (T.BooleanType(), True), "whole": (T.LongType(), 1), "small": (T.IntegerType(), 1), "real": (T.DoubleType(), 1.0), "single": (T.FloatType(), 1.0), "text": (T.StringType(), "1")}


def test_classes_meet_only_between_numbers(spark):
    df = spark.createDataFrame([tuple(v for _, v in CLASSES.values()), (None,) * len(CLASSES)], T.StructType([T.StructField(k, t) for k, (t, _) in CLASSES.items()]))
    pairs = list(product(CLASSES, repeat=2))
    got = df.select(*[equal(F.col(a), CLASSES[a][0], F.col(b), CLASSES[b][0]).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).collect()
    for i, (a, b) in enumerate(pairs):
        numbers = {"whole", "small", "real", "single"}
        assert got[0][f"p{i}"] == (a == b or {a, b} <= numbers), (a, b)
        assert got[1][f"p{i}"] is True  # null equals null in any class


def test_decimals_and_dates_compare_by_text(spark):
    df = spark.sql("select cast(1.50 as decimal(5,2)) a, cast(1.5 as decimal(5,1)) b, 1.5D c, date'2024-01-02' d, '2024-01-02' e, timestamp_ntz'2024-01-02 03:04:05.120' f, '2024-01-02T03:04:05.120' g, timestamp_ntz'2024-01-02 00:00:00' h, X'0AFF' i, '0aff' j")
    kind = lambda c: df.schema[c].dataType
    eq = lambda x, y: equal(F.col(x), kind(x), F.col(y), kind(y)).alias(x + y)
    r = df.select(eq("a", "b"), eq("a", "c"), eq("d", "e"), eq("f", "g"), eq("i", "j"), written(F.col("h"), kind("h")).alias("h")).first()
    assert (r["ab"], r["ac"], r["de"], r["fg"], r["ij"], r["h"]) == (False, False, True, True, True, "2024-01-02T00:00:00")


def test_maps_compare_whatever_their_order(spark):
    df = spark.sql("select map('a', 1, 'b', 2) m, map('b', 2, 'a', 1) n, array(1, 2) x, array(2, 1) y")
    m, x = df.schema["m"].dataType, df.schema["x"].dataType
    r = df.select(equal(F.col("m"), m, F.col("n"), m).alias("m"), equal(F.col("x"), x, F.col("y"), x).alias("x")).first()
    assert r["m"] is True and r["x"] is False


def test_content_of_ints_and_floats(spark):
    whole, real = T.LongType(), T.DoubleType()
    ints = [0, 1, 2**53 + 1, 2**63 - 1, None]
    floats = [-0.0, 1.0, 2.0**53, 2.0**63, None, float("nan"), float("inf"), 1.5]
    a = spark.createDataFrame([(i,) for i in ints], "v long").select("v", content(F.col("v"), whole, real).alias("c"))
    b = spark.createDataFrame([(f,) for f in floats], "w double").select("w", content(F.col("w"), real, whole).alias("c"))
    got = {(r["v"], r["w"]) for r in a.join(b, a["c"].eqNullSafe(b["c"])).select("v", "w").collect()}
    assert got == {(0, 0.0), (1, 1.0), (2**63 - 1, 2.0**63), (None, None)}


def test_key_form_unifies_types(spark):
    df = spark.sql("select 1 a, 1L b, 1.0D c, 'x' d")
    kinds = {c: df.schema[c].dataType for c in df.columns}
    out = df.select(key_form(F.col("a"), kinds["a"], kinds["b"]).alias("ab"), key_form(F.col("b"), kinds["b"], kinds["b"]).alias("bb"), key_form(F.col("b"), kinds["b"], kinds["d"]).alias("bd"))
    assert dict(out.dtypes) == {"ab": "double", "bb": "bigint", "bd": "string"}
    assert class_of(T.DecimalType(5, 2)) == "text"


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-3, 3)), st.one_of(st.none(), st.floats(-3, 3, width=16))), max_size=12))
def test_int_and_float_cells(spark, rows):
    df = spark.createDataFrame(rows, "a long, b double")
    for r in df.select("a", "b", equal(F.col("a"), T.LongType(), F.col("b"), T.DoubleType(), Tolerance(0.5)).alias("e")).collect():
        assert r["e"] == same(r["a"], r["b"], 0.5)


@pytest.mark.parametrize("tolerance", [Tolerance(), Tolerance(0.0, 0.0), Tolerance(-1.0)])
def test_no_tolerance_is_exact(tolerance):
    assert not tolerance.active
