"""Registered queries of the comparison engine and their SQL.

The driver's tables have one version each, so each query derives a second version by the same rule that its SQL states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .api import diff_frames, plan
from .functions.cells import comparable, key_form
from .operators.frames import Side
from .operators.keyed import first_differences, keyed_samples, keyed_totals
from .operators.keyless import keyless_differences, keyless_totals
from .operators.keys import candidates, check_sorted, duplicate_keys, order_violations, profile
from .operators.renames import jaccard_scores, keyed_scores
from .plans.config import DiffError, Options
from .plans.schema import compare_schemas
from .report import IDENTICAL, MORE
from .sources.files import infer_csv, read_table

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_path(spark: SparkSession, suffix: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/{uuid.uuid4().hex}{suffix}"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """orders, and a version with some orders gone, some new, some prices changed and some priorities lost."""
    left = _table(spark, sf_dir, "orders")
    kept = left.filter("o_orderkey % 97 != 0").withColumn("o_totalprice", F.expr("case when o_orderkey % 101 = 0 then o_totalprice + 1 else o_totalprice end")).withColumn("o_orderpriority", F.expr("case when o_orderkey % 103 = 0 then null else o_orderpriority end"))
    new = left.filter("o_orderkey % 89 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000)
    return left, kept.unionByName(new)


_ORDERS = """
l AS (SELECT * FROM orders),
r AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 101 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate,
             CASE WHEN o_orderkey % 103 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
      FROM orders WHERE o_orderkey % 97 <> 0
      UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 89 = 0),
j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS k,
             CASE WHEN l.o_orderkey IS NULL THEN 'added' WHEN r.o_orderkey IS NULL THEN 'removed'
                  WHEN l.o_custkey IS DISTINCT FROM r.o_custkey OR l.o_orderstatus IS DISTINCT FROM r.o_orderstatus OR l.o_totalprice IS DISTINCT FROM r.o_totalprice
                       OR l.o_orderdate IS DISTINCT FROM r.o_orderdate OR l.o_orderpriority IS DISTINCT FROM r.o_orderpriority THEN 'modified'
                  ELSE 'same' END AS change,
             l.o_orderkey IS NOT NULL AS in_left, r.o_orderkey IS NOT NULL AS in_right,
             l.o_totalprice AS old_price, r.o_totalprice AS new_price, l.o_orderpriority AS old_priority, r.o_orderpriority AS new_priority
      FROM l FULL OUTER JOIN r ON l.o_orderkey = r.o_orderkey)
"""
_COUNTS = "count(*) FILTER (in_left) AS n_left, count(*) FILTER (in_right) AS n_right, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified"


def _counts(left: DataFrame, right: DataFrame, **options) -> DataFrame:
    return keyed_totals(plan(left, right, Options(**options)).keyed()).select("n_left", "n_right", "added", "removed", "modified")


@query(f"WITH {_ORDERS} SELECT {_COUNTS} FROM j")
def keyed_counts(spark, sf_dir):
    return _counts(*_orders(spark, sf_dir), key=("o_orderkey",))


@query(f"WITH {_ORDERS} SELECT k AS o_orderkey, change FROM j WHERE change <> 'same'")
def keyed_diff_rows(spark, sf_dir):
    c = plan(*_orders(spark, sf_dir), Options(key=("o_orderkey",))).keyed()
    return c.rows.filter("change != 'same'").select(F.col("key.k0").alias("o_orderkey"), "change")


@query(f"WITH {_ORDERS} SELECT 'o_totalprice' AS name, count(*) AS n FROM j WHERE in_left AND in_right AND old_price IS DISTINCT FROM new_price UNION ALL SELECT 'o_orderpriority', count(*) FROM j WHERE in_left AND in_right AND old_priority IS DISTINCT FROM new_priority")
def keyed_column_changes(spark, sf_dir):
    c = plan(*_orders(spark, sf_dir), Options(key=("o_orderkey",))).keyed()
    names = F.array(*[F.lit(p.label) for p in c.pairs])
    return keyed_totals(c).select(F.explode(F.arrays_zip(names.alias("name"), F.col("changed").alias("n"))).alias("x")).select("x.name", "x.n").filter("n > 0")


@query(f"WITH {_ORDERS}, t AS (SELECT change, k, row_number() OVER (PARTITION BY change ORDER BY k) AS place FROM j WHERE change <> 'same') SELECT change, k AS o_orderkey, place FROM t WHERE place <= 10")
def samples_topn(spark, sf_dir):
    c = plan(*_orders(spark, sf_dir), Options(key=("o_orderkey",))).keyed()
    return keyed_samples(c, 10).select("change", F.col("key.k0").alias("o_orderkey"), F.col("place").cast("long").alias("place"))


@query(f"WITH {_ORDERS}, t AS (SELECT change FROM j WHERE change <> 'same' ORDER BY k LIMIT 25) SELECT change, count(*) AS n FROM t GROUP BY change")
def fail_fast_n(spark, sf_dir):
    c = plan(*_orders(spark, sf_dir), Options(key=("o_orderkey",))).keyed()
    return first_differences(c, 25).groupBy("change").agg(F.count("*").alias("n"))


@query(f"WITH {_ORDERS} SELECT bool_or(change <> 'same') AS has_differences FROM j")
def has_differences(spark, sf_dir):
    return keyed_totals(plan(*_orders(spark, sf_dir), Options(key=("o_orderkey",))).keyed()).select(((F.col("added") + F.col("removed") + F.col("modified")) > 0).alias("has_differences"))


def _part(spark, sf_dir):
    left = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return left, left.withColumn("p_retailprice", F.expr("p_retailprice + (p_partkey % 7) * 0.0625"))


_PART = "FROM part a JOIN (SELECT p_partkey, p_retailprice + (p_partkey % 7) * 0.0625 AS v FROM part) b USING (p_partkey)"
_NUMBERS = "NOT isnan(p_retailprice) AND NOT isnan(v)"


@query(f"SELECT count(*) AS modified {_PART} WHERE NOT (p_retailprice = v OR ({_NUMBERS} AND abs(p_retailprice - v) <= 0.125))")
def tol_abs(spark, sf_dir):
    return _counts(*_part(spark, sf_dir), key=("p_partkey",), tol_abs=0.125).select("modified")


@query(f"SELECT count(*) AS modified {_PART} WHERE NOT (p_retailprice = v OR ({_NUMBERS} AND abs(p_retailprice - v) <= 0.0002 * greatest(abs(p_retailprice), abs(v))))")
def tol_rel(spark, sf_dir):
    return _counts(*_part(spark, sf_dir), key=("p_partkey",), tol_rel=0.0002).select("modified")


@query(f"SELECT count(*) AS modified {_PART} WHERE NOT (p_retailprice = v OR ({_NUMBERS} AND abs(p_retailprice - v) <= greatest(0.125, 0.0002 * greatest(abs(p_retailprice), abs(v)))))")
def tol_both(spark, sf_dir):
    return _counts(*_part(spark, sf_dir), key=("p_partkey",), tol_abs=0.125, tol_rel=0.0002).select("modified")


@query("""
WITH d AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE WHEN 2 THEN NULL ELSE value END AS a,
                  CASE event_id % 7 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN NULL ELSE value + 0.01 END AS b FROM events)
SELECT count(*) AS modified FROM d
WHERE NOT (a IS NOT DISTINCT FROM b OR coalesce(NOT isnan(a) AND NOT isnan(b) AND (CASE WHEN isinf(a) OR isinf(b) THEN TRUE ELSE abs(a - b) <= greatest(0.05, 0.001 * greatest(abs(a), abs(b))) END), FALSE))
""")
def tol_nan_inf(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    left = events.select("event_id", F.expr("case event_id % 5 when 0 then double('NaN') when 1 then double('Infinity') when 2 then null else value end").alias("value"))
    right = events.select("event_id", F.expr("case event_id % 7 when 0 then double('NaN') when 1 then double('-Infinity') when 2 then null else value + 0.01 end").alias("value"))
    return _counts(left, right, key=("event_id",), tol_abs=0.05, tol_rel=0.001).select("modified")


@query("""
WITH r AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 11 = 3 THEN upper(text) ELSE text END AS text FROM conversations WHERE NOT (conv_id % 13 = 5 AND turn = 1)),
j AS (SELECT c.conv_id IS NOT NULL AS in_left, r.conv_id IS NOT NULL AS in_right,
             CASE WHEN c.conv_id IS NULL THEN 'added' WHEN r.conv_id IS NULL THEN 'removed' WHEN c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text THEN 'modified' ELSE 'same' END AS change
      FROM conversations c FULL OUTER JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn)
SELECT """ + _COUNTS + " FROM j")
def composite_key(spark, sf_dir):
    left = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    right = left.filter("not (conv_id % 13 = 5 and turn = 1)").withColumn("text", F.expr("case when conv_id % 11 = 3 then upper(text) else text end"))
    return _counts(left, right, key=("conv_id", "turn"))


@query("""
WITH l AS (SELECT CASE WHEN c_custkey = (SELECT min(c_custkey) FROM customer) THEN NULL ELSE c_custkey END AS k, c_acctbal FROM customer),
r AS (SELECT CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN NULL ELSE c_custkey END AS k, c_acctbal FROM customer),
j AS (SELECT l.c_acctbal IS NOT NULL AS in_left, r.c_acctbal IS NOT NULL AS in_right,
             CASE WHEN l.c_acctbal IS NULL THEN 'added' WHEN r.c_acctbal IS NULL THEN 'removed' WHEN l.c_acctbal <> r.c_acctbal THEN 'modified' ELSE 'same' END AS change
      FROM l FULL OUTER JOIN r ON l.k IS NOT DISTINCT FROM r.k)
SELECT """ + _COUNTS + " FROM j")
def null_key_match(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    ends = c.agg(F.min("c_custkey"), F.max("c_custkey")).first()
    sides = [c.select(F.when(F.col("c_custkey") != e, F.col("c_custkey")).alias("c_custkey"), "c_acctbal") for e in ends]
    return _counts(*sides, key=("c_custkey",))


@query("""
WITH r AS (SELECT CAST(o_orderkey AS DOUBLE) AS k, o_totalprice + (CASE WHEN o_orderkey % 101 = 0 THEN 1 ELSE 0 END) AS p FROM orders WHERE o_orderkey % 97 <> 0),
j AS (SELECT o.o_orderkey IS NOT NULL AS in_left, r.k IS NOT NULL AS in_right, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN r.k IS NULL THEN 'removed' WHEN o.o_totalprice IS DISTINCT FROM r.p THEN 'modified' ELSE 'same' END AS change
      FROM orders o FULL OUTER JOIN r ON CAST(o.o_orderkey AS DOUBLE) = r.k)
SELECT """ + _COUNTS + " FROM j")
def cross_type_key(spark, sf_dir):
    left = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    right = left.filter("o_orderkey % 97 != 0").select(F.col("o_orderkey").cast("double").alias("o_orderkey"), (F.col("o_totalprice") + F.expr("case when o_orderkey % 101 = 0 then 1 else 0 end")).alias("o_totalprice"))
    return _counts(left, right, key=("o_orderkey",))


@query("SELECT count(*) FILTER (NOT (quality IS NULL)) AS modified FROM labels")
def type_changed_values(spark, sf_dir):
    left = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    return _counts(left, left.withColumn("quality", F.col("quality").cast("string")), key=("doc_id",)).select("modified")


@query("SELECT count(*) AS modified FROM part")
def decimal_vs_double(spark, sf_dir):
    left = _table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return _counts(left, left.withColumn("p_retailprice", F.col("p_retailprice").cast("decimal(20,2)")), key=("p_partkey",)).select("modified")


@query("SELECT count(*) FILTER (event_id % 3 = 0) AS modified FROM events")
def date_vs_text(spark, sf_dir):
    left = _table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    right = left.withColumn("day", F.expr("concat(date_format(day, 'yyyy-MM-dd'), case when event_id % 3 = 0 then ' ' else '' end)"))
    return _counts(left, right, key=("event_id",)).select("modified")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys_rows(spark, sf_dir):
    return duplicate_keys(_table(spark, sf_dir, "lineitem"), [F.col("l_orderkey"), F.col("l_linenumber")]).select(F.col("k0").alias("l_orderkey"), F.col("k1").alias("l_linenumber"), "n")


_MOVED = "CASE WHEN o_orderkey % 50 = 7 THEN o_orderkey - 20 ELSE o_orderkey END"


@query(f"WITH t AS (SELECT o_orderkey AS place, {_MOVED} AS k, lag({_MOVED}) OVER (ORDER BY o_orderkey) AS previous FROM orders) SELECT place, k, previous FROM t WHERE k < previous")
def order_violation_rows(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    got = order_violations(orders, F.expr("o_orderkey div 10000"), F.col("o_orderkey"), [F.expr(_MOVED)])
    return got.select("place", F.col("key.k0").alias("k"), F.col("previous.k0").alias("previous"))


def _lines(spark, sf_dir):
    left = _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    right = _table(spark, sf_dir, "lineitem").filter("l_orderkey % 17 != 0").select("l_returnflag", "l_linestatus", F.expr("case when l_orderkey % 19 = 0 then l_quantity + 1 else l_quantity end").alias("l_quantity"), "l_discount")
    return left, right


_LINES = """
u AS (SELECT l_returnflag AS a, l_linestatus AS b, l_quantity AS c, l_discount AS d, 1 AS l, 0 AS r FROM lineitem
      UNION ALL SELECT l_returnflag, l_linestatus, CASE WHEN l_orderkey % 19 = 0 THEN l_quantity + 1 ELSE l_quantity END, l_discount, 0, 1 FROM lineitem WHERE l_orderkey % 17 <> 0),
g AS (SELECT a, b, c, d, CAST(sum(l) AS BIGINT) AS nl, CAST(sum(r) AS BIGINT) AS nr FROM u GROUP BY a, b, c, d)
"""


@query(f"WITH {_LINES} SELECT CAST(sum(nl) AS BIGINT) AS n_left, CAST(sum(nr) AS BIGINT) AS n_right, CAST(sum(greatest(nl - nr, 0)) AS BIGINT) AS removed, CAST(sum(greatest(nr - nl, 0)) AS BIGINT) AS added FROM g")
def keyless_counts(spark, sf_dir):
    return keyless_totals(plan(*_lines(spark, sf_dir), Options(keyless=True)).groups())


@query(f"WITH {_LINES} SELECT CASE WHEN nl > nr THEN 'removed' ELSE 'added' END AS change, abs(nl - nr) AS instances, a, b, c, d FROM g WHERE nl <> nr")
def keyless_rows(spark, sf_dir):
    return keyless_differences(plan(*_lines(spark, sf_dir), Options(keyless=True)).groups(), 4).toDF("change", "instances", "a", "b", "c", "d")


@query("""
WITH u AS (SELECT CAST(user_id AS DOUBLE) AS u, 1 AS l, 0 AS r FROM events UNION ALL SELECT CAST(user_id AS DOUBLE) + (CASE WHEN event_id % 10 = 0 THEN 0.5 ELSE 0 END), 0, 1 FROM events),
g AS (SELECT sum(l) AS nl, sum(r) AS nr FROM u GROUP BY u)
SELECT CAST(sum(nl) AS BIGINT) AS n_left, CAST(sum(nr) AS BIGINT) AS n_right, CAST(sum(greatest(nl - nr, 0)) AS BIGINT) AS removed, CAST(sum(greatest(nr - nl, 0)) AS BIGINT) AS added FROM g
""")
def keyless_int_vs_float(spark, sf_dir):
    events = _table(spark, sf_dir, "events")
    right = events.select((F.col("user_id").cast("double") + F.expr("case when event_id % 10 = 0 then 0.5D else 0D end")).alias("user_id"))
    return keyless_totals(plan(events.select("user_id"), right, Options(keyless=True)).groups())


def _filtered(where: str, sql: str):
    """Rows of orders (with some priorities missing) that pass a filter of the predicate language."""

    def run(spark, sf_dir):
        orders = _table(spark, sf_dir, "orders").withColumn("o_orderpriority", F.expr("case when o_orderkey % 9 = 0 then null else o_orderpriority end")).withColumn("exact", F.col("o_totalprice").cast("decimal(20,2)"))
        side = plan(orders, orders, Options(key=("o_orderkey",), where=where)).left
        return side.df.select(side.column("o_orderkey").alias("o_orderkey"))

    return run, f"WITH t AS (SELECT o_orderkey, o_totalprice, o_orderdate, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders) SELECT o_orderkey FROM t WHERE {sql}"


for _name, _where, _sql in (
    ("where_ne_null", "o_orderpriority != '1-URGENT'", "o_orderpriority IS DISTINCT FROM '1-URGENT'"),
    ("where_eq_null", "o_orderpriority = NULL", "o_orderpriority IS NULL"),
    ("where_not_null", "o_orderpriority != null", "o_orderpriority IS NOT NULL"),
    ("where_range", "o_totalprice >= 1e3 AND o_totalprice < 150000 and o_orderkey > 100", "o_totalprice >= 1000 AND o_totalprice < 150000 AND o_orderkey > 100"),
    ("where_text_date", "o_orderdate >= '1995-03' AND o_orderdate < '1996'", "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') >= '1995-03' AND strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') < '1996'"),
    ("where_class_mismatch", "exact != 5 AND o_orderstatus != 1 AND o_orderpriority > '2'", "o_orderpriority > '2'"),
    ("where_int_eq_float", "o_custkey = 7.0", "o_custkey = 7"),
):
    QUERIES[_name], ORACLE_SQL[_name] = _filtered(_where, _sql)


@query("SELECT name, n, d AS n_distinct, nulls FROM (SELECT 'o_orderkey' AS name, count(*) AS n, count(DISTINCT o_orderkey) AS d, count(*) FILTER (o_orderkey IS NULL) AS nulls FROM orders UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), count(*) FILTER (o_custkey IS NULL) FROM orders UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), count(*) FILTER (o_orderstatus IS NULL) FROM orders)")
def key_profile(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    names = ["o_orderkey", "o_custkey", "o_orderstatus"]
    got = profile(orders, {n: comparable(F.col(n), orders.schema[n].dataType) for n in names})
    rows = F.array(*[F.struct(F.lit(n).alias("name"), "n", F.col(f"d{i}").alias("n_distinct"), F.col(f"n{i}").alias("nulls")) for i, n in enumerate(names)])
    return got.select(F.explode(rows).alias("x")).select("x.*")


@query("SELECT * FROM (VALUES (1, 'o_orderkey'), (2, 'o_custkey'), (3, 'o_orderstatus'), (4, 'o_totalprice'), (5, 'o_orderdate'), (6, 'o_orderpriority')) AS t(place, name)")
def key_candidates(spark, sf_dir):
    names = candidates([c for c in reversed(_table(spark, sf_dir, "orders").columns) if not c.endswith("key")][::-1] + ["o_orderkey", "o_custkey"])
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "place int, name string")


@query("""
WITH r AS (SELECT o_orderkey, o_totalprice AS price, o_orderstatus AS state FROM orders WHERE o_orderkey % 97 <> 0)
SELECT a AS left_name, b AS right_name, count(*) AS matched, count(*) FILTER (same) AS equal FROM (
  SELECT 'o_totalprice' AS a, 'price' AS b, o.o_totalprice IS NOT DISTINCT FROM r.price AS same FROM orders o JOIN r USING (o_orderkey)
  UNION ALL SELECT 'o_totalprice', 'state', FALSE FROM orders o JOIN r USING (o_orderkey)
  UNION ALL SELECT 'o_orderstatus', 'price', FALSE FROM orders o JOIN r USING (o_orderkey)
  UNION ALL SELECT 'o_orderstatus', 'state', o.o_orderstatus IS NOT DISTINCT FROM r.state FROM orders o JOIN r USING (o_orderkey)) GROUP BY a, b
""")
def rename_keyed_scores(spark, sf_dir):
    left = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    right = left.filter("o_orderkey % 97 != 0").toDF("o_orderkey", "price", "state")
    got = keyed_scores(Side.of(left, "l"), Side.of(right, "r"), ["o_orderkey"], ["o_totalprice", "o_orderstatus"], ["price", "state"])
    return spark.createDataFrame(got, "left_name string, right_name string, matched long, equal long")


@query("""
WITH l AS (SELECT DISTINCT user_id AS v FROM events), r AS (SELECT DISTINCT user_id AS v FROM events WHERE event_id % 3 <> 0), t AS (SELECT DISTINCT event_type AS v FROM events)
SELECT 'user_id' AS left_name, 'person' AS right_name, (SELECT count(*) FROM l) AS n_left, (SELECT count(*) FROM r) AS n_right, (SELECT count(*) FROM l JOIN r ON l.v IS NOT DISTINCT FROM r.v) AS common
UNION ALL SELECT 'user_id', 'kind', (SELECT count(*) FROM l), (SELECT count(*) FROM t), 0
UNION ALL SELECT 'event_type', 'person', (SELECT count(*) FROM t), (SELECT count(*) FROM r), 0
UNION ALL SELECT 'event_type', 'kind', (SELECT count(*) FROM t), (SELECT count(DISTINCT event_type) FROM events WHERE event_id % 3 <> 0), (SELECT count(DISTINCT event_type) FROM events WHERE event_id % 3 <> 0)
""")
def rename_jaccard_scores(spark, sf_dir):
    left = _table(spark, sf_dir, "events").select("user_id", "event_type")
    right = _table(spark, sf_dir, "events").filter("event_id % 3 != 0").select(F.col("user_id").alias("person"), F.col("event_type").alias("kind"))
    got = jaccard_scores(Side.of(left, "l"), Side.of(right, "r"), ["user_id", "event_type"], ["person", "kind"])
    return spark.createDataFrame(got, "left_name string, right_name string, n_left long, n_right long, common long")


@query("SELECT * FROM (VALUES ('added', 'o_note', 'string'), ('removed', 'o_orderpriority', 'string'), ('type_changed', 'o_custkey', 'bigint > string')) AS t(change, name, kind)")
def schema_diff(spark, sf_dir):
    left = _table(spark, sf_dir, "orders")
    right = left.drop("o_orderpriority").withColumn("o_custkey", F.col("o_custkey").cast("string")).withColumn("o_note", F.lit("x"))
    d = compare_schemas(left.schema, right.schema)
    rows = [("added", c.name, c.data_type) for c in d.added] + [("removed", c.name, c.data_type) for c in d.removed] + [("type_changed", c.name, f"{c.left} > {c.right}") for c in d.type_changed]
    return spark.createDataFrame(rows, "change string, name string, kind string")


@query("SELECT * FROM (VALUES ('number', 'bigint'), ('real', 'double'), ('day', 'date'), ('moment', 'timestamp_ntz'), ('time', 'string'), ('flag', 'boolean'), ('words', 'string'), ('empty', 'string')) AS t(name, kind)")
def csv_types(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    cells = orders.select(
        F.col("o_orderkey").cast("string").alias("number"), F.expr("case when o_orderkey % 2 = 0 then '12' else '0.5e3' end").alias("real"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("moment"),
        F.date_format("o_orderdate", "HH:mm").alias("time"), F.expr("case when o_orderkey % 2 = 0 then 'TRUE' else 'false' end").alias("flag"), F.col("o_orderstatus").alias("words"), F.lit(None).cast(T.StringType()).alias("empty"),
    )
    return spark.createDataFrame([(n, k.simpleString()) for n, k in zip(cells.columns, infer_csv(cells), strict=True)], "name string, kind string")


@query("SELECT o_orderkey % 1000 AS k, CAST(o_orderkey % 1000 AS DOUBLE) AS form, count(*) AS n FROM orders GROUP BY ALL")
def key_unification(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1000).alias("k"))
    return orders.select("k", key_form(F.col("k"), T.LongType(), T.IntegerType()).alias("form")).groupBy("k", "form").agg(F.count("*").alias("n"))


@query(f"WITH {_ORDERS}, t AS (SELECT {_COUNTS} FROM j) SELECT * FROM (SELECT 'n_left' AS name, n_left AS n FROM t UNION ALL SELECT 'n_right', n_right FROM t UNION ALL SELECT 'added', added FROM t UNION ALL SELECT 'removed', removed FROM t UNION ALL SELECT 'modified', modified FROM t UNION ALL SELECT 'shown', least(10, added) + least(10, removed) + least(10, modified) FROM t)")
def report_counts(spark, sf_dir):
    r = diff_frames(*_orders(spark, sf_dir), key="o_orderkey").to_dict()
    rows = [("n_left", r["rows"]["left"]), ("n_right", r["rows"]["right"]), *r["diff"].items(), ("shown", sum(len(v) for v in r["samples"].values()))]
    return spark.createDataFrame(rows, "name string, n long")


@query("SELECT * FROM (VALUES ('orders', 'o_orderkey', TRUE, FALSE), ('lineitem', '', TRUE, TRUE), ('keyless', '', FALSE, TRUE), ('given', 'o_custkey,o_orderkey', FALSE, FALSE)) AS t(input, key, inferred, keyless)")
def mode_selection(spark, sf_dir):
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount")
    cases = {"orders": plan(orders, orders), "lineitem": plan(lines, lines), "keyless": plan(orders, orders, Options(keyless=True)), "given": plan(orders, orders, Options(key=("o_custkey", "o_orderkey")))}
    return spark.createDataFrame([(n, ",".join(c.key or []), c.inferred, c.key is None) for n, c in cases.items()], "input string, key string, inferred boolean, keyless boolean")


@query("SELECT 'o_totalprice' AS left_name, 'price' AS right_name, CAST(count(*) FILTER (o_orderkey % 200 <> 0) AS DOUBLE) / count(*) AS similarity FROM orders WHERE o_orderkey % 3 <> 0")
def rename_detected(spark, sf_dir):
    """Scored on all rows: the prefixes are the whole tables."""
    left = _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").filter("o_orderkey % 3 != 0")
    right = left.select("o_orderkey", F.expr("case when o_orderkey % 200 = 0 then o_totalprice + 1 else o_totalprice end").alias("price"), F.lit("?").alias("state"))
    found = plan(left, right, Options(key=("o_orderkey",)), prefixes=(lambda _: left, lambda _: right)).schema.renamed
    return spark.createDataFrame([(r.left, r.right, r.similarity) for r in found], "left_name string, right_name string, similarity double")


@query(f"WITH {_ORDERS}, k AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS k, l.o_orderkey IS NOT NULL AS in_left, r.o_orderkey IS NOT NULL AS in_right, CASE WHEN l.o_orderkey IS NULL THEN 'added' WHEN r.o_orderkey IS NULL THEN 'removed' WHEN l.o_totalprice IS DISTINCT FROM r.o_totalprice OR l.o_orderpriority IS DISTINCT FROM r.o_orderpriority THEN 'modified' ELSE 'same' END AS change FROM (SELECT * FROM l WHERE o_orderpriority IS DISTINCT FROM '2-HIGH' AND o_totalprice > 50000) l FULL OUTER JOIN (SELECT * FROM r WHERE o_orderpriority IS DISTINCT FROM '2-HIGH' AND o_totalprice > 50000) r ON l.o_orderkey = r.o_orderkey) SELECT {_COUNTS} FROM k")
def where_both_sides(spark, sf_dir):
    return _counts(*_orders(spark, sf_dir), key=("o_orderkey",), where="o_orderpriority != '2-HIGH' AND o_totalprice > 50000")


@query("SELECT count(*) AS n_left, count(*) AS n_right, 0 AS added, 0 AS removed, count(*) FILTER (p_partkey % 10 = 0) AS modified FROM part")
def cross_format(spark, sf_dir):
    """part as Parquet against part written to CSV, with some sizes changed on the way, and read with inferred types."""
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("long").alias("p_size"), "p_retailprice")
    at = _shared_path(spark, ".csv")
    part.withColumn("p_size", F.expr("case when p_partkey % 10 = 0 then p_size + 1 else p_size end")).write.option("header", True).csv(at)
    got = _counts(part, read_table(spark, at).df, key=("p_partkey",))
    return got.select("n_left", "n_right", F.col("added").cast("int").alias("added"), F.col("removed").cast("int").alias("removed"), "modified")


_SORTABLE = ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderdate")


@query("SELECT name, bool_and(NOT lower) AS is_sorted FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, coalesce({c} < lag({c}) OVER (ORDER BY o_orderkey), false) AS lower FROM orders" for c in _SORTABLE) + ") GROUP BY name")
def sorted_check_files(spark, sf_dir):
    """By which columns orders are sorted, in file order, once written to files in the order of o_orderkey."""
    at = _shared_path(spark, "")
    _table(spark, sf_dir, "orders").orderBy("o_orderkey").write.parquet(at)
    side, out = Side.of(spark.read.parquet(at), "l"), []
    for name in _SORTABLE:
        try:
            check_sorted(side, side, [name])
            out.append((name, True))
        except DiffError:
            out.append((name, False))
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.createDataFrame(out, "name string, is_sorted boolean")


@query(f"""
WITH l AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
r AS (SELECT k, CASE WHEN k % 101 = 0 THEN c + 1 ELSE c END AS c FROM l WHERE k % 97 <> 0 UNION ALL SELECT k + 100000000, c FROM l WHERE k % 89 = 0),
j AS (SELECT coalesce(l.k, r.k) AS k, l.c AS a, r.c AS b, CASE WHEN l.k IS NULL THEN 'added' WHEN r.k IS NULL THEN 'removed' WHEN l.c <> r.c THEN 'modified' END AS change
      FROM l FULL OUTER JOIN r ON l.k = r.k),
s AS (SELECT *, row_number() OVER (PARTITION BY change ORDER BY k) AS place FROM j WHERE change IS NOT NULL),
t AS (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified,
             count(*) FILTER (place > 10) AS more, (SELECT count(*) FROM l) AS nl, (SELECT count(*) FROM r) AS nr FROM s),
lines AS (
SELECT 0 AS part, 0 AS place, 'Schema' AS line
UNION ALL SELECT 1, 0, '  {IDENTICAL}'
UNION ALL SELECT 2, 0, 'Key: o_orderkey'
UNION ALL SELECT 3, 0, 'Rows: ' || nl || ' → ' || nr FROM t
UNION ALL SELECT 4, 0, '  + ' || added || ' added' FROM t
UNION ALL SELECT 5, 0, '  - ' || removed || ' removed' FROM t
UNION ALL SELECT 6, 0, '  ~ ' || modified || ' modified' || CASE WHEN modified > 0 THEN '  (o_custkey: ' || modified || ')' ELSE '' END FROM t
UNION ALL SELECT 7, 0, ''
UNION ALL SELECT 8, place, '~ o_orderkey=' || k || '  o_custkey: ' || a || ' → ' || b FROM s WHERE change = 'modified' AND place <= 10
UNION ALL SELECT 9, place, '+ o_orderkey=' || k FROM s WHERE change = 'added' AND place <= 10
UNION ALL SELECT 10, place, '- o_orderkey=' || k FROM s WHERE change = 'removed' AND place <= 10
UNION ALL SELECT 11, 0, '{MORE.format("' || more || '")}' FROM t WHERE more > 0)
SELECT row_number() OVER (ORDER BY part, place) AS place, line FROM lines
""")
def report_text(spark, sf_dir):
    """The lines of the text report on two versions of orders."""
    left = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    right = left.filter("o_orderkey % 97 != 0").withColumn("o_custkey", F.expr("case when o_orderkey % 101 = 0 then o_custkey + 1 else o_custkey end"))
    right = right.unionByName(left.filter("o_orderkey % 89 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100_000_000))
    lines = diff_frames(left, right, key="o_orderkey").to_text().split("\n")[:-1]  # a report has a bounded number of lines
    return spark.createDataFrame(list(enumerate(lines, 1)), "place long, line string")


_CONFLICTS = {
    "keyless with key": (Options(keyless=True, key=("o_orderkey",)), "--keyless and --key are mutually exclusive"),
    "keyless with tolerance": (Options(keyless=True, tol_abs=1.0), "float tolerances are not supported in keyless mode (rows are matched by exact content)"),
    "keyless with assume_sorted": (Options(keyless=True, assume_sorted=True), "--assume-sorted requires a key (keyless mode does not follow file order)"),
    "assume_sorted without key": (Options(assume_sorted=True), "--assume-sorted requires an explicit --key"),
    "key in neither": (Options(key=("nothing",)), "key column `nothing` must exist in both tables (shared columns: o_orderkey, o_custkey)"),
    "where on neither": (Options(key=("o_orderkey",), where="nothing = 1"), "--where column `nothing` must exist in both tables (shared columns: o_orderkey, o_custkey)"),
    "none": (Options(key=("o_orderkey",), tol_abs=1.0, assume_sorted=True), ""),
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{message}')" for name, (_, message) in _CONFLICTS.items()) + ") AS t(name, message)")
def option_errors(spark, sf_dir):
    """What planning says of options that cannot go together; nothing of the table is read."""
    orders, out = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), []
    for name, (options, _) in _CONFLICTS.items():
        try:
            plan(orders, orders, options)
            out.append((name, ""))
        except DiffError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "name string, message string")
