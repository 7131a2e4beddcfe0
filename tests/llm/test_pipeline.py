"""The stages, each held against brute force on its own input."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from rowlens.llm.common import prune_by_ids, remove_by_ids

from .conftest import CLASHES
from .test_exact_dedup import model as exact_model
from .test_near_dedup import model as near_model
from .test_quality import corpus


@pytest.fixture(scope="module")
def sf(spark, hard_rows, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    rows, labels = corpus(300)
    docs = [(i + 1000, t, "en", f"s{i % 4}", n) for i, t, n in rows] + hard_rows
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i + 1000, y, 0) for i, y, _ in labels], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, sf, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["quality", "exact", "near", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        assert name == "packing" or docs.columns == columns
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    before, after = map(pairs, seen["exact"])
    gone = {m[0] for m in exact_model(before) if not m[3]}
    assert sorted(after, key=str) == sorted([r for r in before if r[0] is None or r[0] not in gone], key=str)
    before, after = map(pairs, seen["near"])
    part = near_model([r for r in before if r[0] is not None], 5)
    assert sorted(after, key=str) == sorted([r for r in before if r[0] is None or part[r[0]][1] == r[0]], key=str)
    before, after = map(pairs, seen["mixing"])
    assert set(after) <= set(before) and max(after.count(r) for r in set(after)) <= 2 * max(before.count(r) for r in set(before))
    assert cp.run(spark, sf).count() == docs.count()


def test_columns_of_any_name_come_back(spark, sf, tmp_path):
    names = {field.replace("`", "").split(" ")[0] for field in CLASHES.split(", ")}
    names |= set("held_out predicted _text _chars text_ chars_ hit _hit map _map _h h bucket _bucket _id _copies copies copy _copy key quality kept keep_id component_id best chars group_size labels".split()) | {"a.b", "a`b"}
    names -= {"order"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    base, extra = docs.columns, sorted(names)
    wide = docs.select(*base, *[F.concat(F.lit(f"{n}:"), F.col("doc_id").cast("string")).alias(n) for n in extra])
    for i, (name, stage) in enumerate(cp.STAGES):
        wide.write.parquet(str(tmp_path / f"in-{i}"))
        wide = spark.read.parquet(str(tmp_path / f"in-{i}"))
        out = stage(spark, wide, sf)
        if name == "packing":
            assert out.count() > 0
            break
        assert out.columns == [*base, *extra]
        plain = stage(spark, wide.select(*base), sf)
        rows = out.collect()
        assert all(r[len(base) + k] == (None if r[0] is None else f"{n}:{r[0]}") for r in rows for k, n in enumerate(extra))
        assert sorted((str(tuple(r[: len(base)])) for r in rows)) == sorted(str(tuple(r)) for r in plain.collect())
        wide = out


def test_quality_keeps_all_without_labels(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.quality_stage(spark, docs, str(tmp_path)).count() == docs.count()


def test_empty_tables(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_bitmaps_lose_nothing(spark):
    df = spark.range(5000).selectExpr("case when id % 50 = 0 then null else id end as doc_id", "id as n")
    ids = spark.range(0, 5000, 7).toDF("doc_id")
    near = {r["n"] for r in prune_by_ids(df, ids, "doc_id").collect()}
    assert {i for i in range(0, 5000, 7) if i % 50} <= near and len(near) < 900
    left = {r["n"] for r in remove_by_ids(df, ids, "doc_id").collect()}
    assert left == {i for i in range(5000) if i % 7 or i % 50 == 0}
    none = spark.range(0).toDF("doc_id")
    assert remove_by_ids(df, none, "doc_id").count() == 5000 and prune_by_ids(df, none, "doc_id").count() == 0
