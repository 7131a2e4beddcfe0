"""Every registered query of the comparison engine against its SQL."""

import os

import duckdb
import pytest

from rowlens.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_entry_imports_without_the_optional_parts():
    import __spark_entry__ as entry

    assert set(ORACLE_SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())


def test_renames_are_scored_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr("rowlens.api.RENAME_SAMPLE", 100)
    con = duckdb.connect()
    con.sql(f"create view orders as select * from '{DATA}/orders.parquet'")
    got, want = QUERIES["rename_detected"](spark, DATA).collect(), con.sql(ORACLE_SQL["rename_detected"]).fetchall()
    assert [tuple(r) for r in got] == want
