import pytest
from pyspark.sql import functions as F

from rowlens.functions.predicate import Clause, PredicateError, condition, parse


def test_clauses():
    assert parse("a = 1 AND b.c != 'it''s' and _d>=1e5 AND e <= NULL AND f = TRUE AND g < -2.5") == [
        Clause("a", "=", 1), Clause("b.c", "!=", "it's"), Clause("_d", ">=", 1e5), Clause("e", "<=", None), Clause("f", "=", True), Clause("g", "<", -2.5),
    ]
    assert isinstance(parse("a = 9223372036854775808")[0].value, float)
    assert isinstance(parse("a = 7")[0].value, int)


@pytest.mark.parametrize("bad", ["", "a", "a =", "a = 1 AND", "a = 1 OR b = 2", "a <> 1", "a = 5-3", "a = +5", "(a = 1)", "a = 'x", "a = b", "1 = a", "a ! 1", "a = 1 b = 2"])
def test_errors(bad):
    with pytest.raises(PredicateError):
        parse(bad)


@pytest.mark.parametrize(
    ("where", "want"),
    [
        ("x = 2", {2}), ("x != 2", {1, 3, 4}), ("x = null", {3}), ("x != null", {1, 2, 4}), ("x < 2.5", {1, 2}), ("x >= 2", {2, 4}), ("x = 'a'", set()), ("x != 'a'", {1, 2, 3, 4}), ("x > 'a'", set()),
        ("s > 'a'", {2, 4}), ("s = 'b'", {2}), ("b = true", {1}), ("b != true", {2, 3, 4}), ("b < true", set()), ("d >= '2024-01-02'", {2, 4}), ("d = '2024-1-2'", set()), ("f > 10", {4}), ("f = 0", {1}), ("m = 1.5", set()), ("m != 1.5", {1, 2, 3, 4}), ("m > 1", set()), ("x = 2 and s = 'b'", {2}),
    ],
)
def test_rows_kept(spark, where, want):
    df = spark.sql("""select * from values (1, 1, 'a', true, date'2024-01-01', -0.0D, 1.5BD), (2, 2, 'b', false, date'2024-01-02', 1D, 2BD), (3, null, null, null, null, null, null), (4, 5, 'c', false, date'2024-02-01', double('NaN'), 1.5BD) as t(id, x, s, b, d, f, m)""")
    cond = condition(parse(where), {c: (F.col(c), df.schema[c].dataType) for c in df.columns})
    assert {r["id"] for r in df.filter(cond).collect()} == want


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = df.filter(condition(parse("id >= 3 AND id != 5"), {"id": (F.col("id"), df.schema["id"].dataType)}))._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(id,3)" in plan
