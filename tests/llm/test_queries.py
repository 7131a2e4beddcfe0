"""The registered queries on the driver's smallest tables: against their SQL, or against the contract's own arithmetic."""

import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from rowlens.llm.mixing import targets
from rowlens.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{DATA}/{file}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_language_model(spark, docs):
    got = QUERIES["op2_lm_score"](spark, DATA).toPandas().set_index("doc_id")
    assert set(got.index) == set(docs.index)
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 5 == 1) and got.n_tokens[i] == len(docs.text[i].encode().split()) + 1 for i in got.index)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_urls(spark):
    from .test_url_filter import parts, rule

    got, pages = QUERIES["op3_url_filter"](spark, DATA).toPandas().set_index("page_id"), pd.read_parquet(f"{DATA}/pages.parquet").set_index("page_id")
    for i, url in pages.url.items():
        hit = rule(*parts(url))
        assert (got.host[i], got.path[i]) == parts(url) and got.rule[i] == (hit[0] if hit else None) and (hit is None or got.verdict[i] == hit[1])


def test_quality(spark, docs):
    got = QUERIES["op4_quality"](spark, DATA).toPandas().set_index("doc_id")
    assert set(got.index) == set(docs.index) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got.index)
    held = got.join(pd.read_parquet(f"{DATA}/labels.parquet").set_index("doc_id"), how="inner").query("held_out")
    assert (held.predicted == held.quality).mean() > 0.85


def test_mixing(spark, docs):
    got = QUERIES["op7_mix_sources"](spark, DATA).toPandas().set_index("doc_id")
    size = docs.text.map(lambda t: len(t.encode().split()))
    by = {s: int(n) for s, n in size.groupby(docs.source).sum().items()}
    want = targets(by)
    assert (got["size"] == size[got.index]).all() and np.allclose(got.target, docs.source[got.index].map(want)) and (got.taken <= 2 * got["size"]).all()
    assert abs(got.taken.sum() - 1.5 * size.sum()) < 0.03 * size.sum()


def test_packing(spark, docs):
    got = QUERIES["op10_pack"](spark, DATA).toPandas()
    assert set(got.doc_id) == set(docs.index) and (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()
    lengths = got.groupby("sequence_id").length.sum()
    assert lengths.max() <= 2048 and (lengths & (lengths - 1) == 0).all()
