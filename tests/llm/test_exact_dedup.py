import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from rowlens.llm.exact_dedup import dedup_exact


def model(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((d, t or ""))
    out = []
    for body, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(d, keep, len(members), d == keep, hashlib.sha256(body.encode()).hexdigest()) for d, _ in members]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_hard_rows(hard_docs, hard_rows, scratch):
    got = dedup_exact(hard_docs, scratch)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert rows_of(got) == model([r[:2] for r in hard_rows])


def test_read_from_files(spark, scratch, tmp_path):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    assert rows_of(dedup_exact(spark.read.parquet(str(tmp_path / "d")), scratch)) == model(rows)


def test_colliding_digests_do_not_drop_documents(hard_docs, hard_rows, scratch):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    got = dedup_exact(hard_docs.filter("doc_id is not null and doc_id != 5"), scratch, digest=weak).drop("digest")
    want = model([r[:2] for r in hard_rows if r[0] is not None and r[0] != 5])
    assert rows_of(got) == sorted([w[:4] for w in want], key=str)


def test_a_later_call_goes_on_from_the_state(spark, scratch, tmp_path):
    rows = [(i, f"text {i % 7}" + " " * (i % 3)) for i in range(60)]
    state = f"{scratch.root}/kept-state"
    before = spark.createDataFrame(rows[:40], "doc_id long, text string")
    assert rows_of(dedup_exact(before, scratch, state_dir=state)) == model(rows[:40])
    spark.createDataFrame(rows[40:], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    later = rows_of(dedup_exact(spark.read.parquet(str(tmp_path / "d")), scratch, state_dir=state))
    assert later == [m for m in model(rows) if m[0] >= 40]
    scratch.remove(state)


def test_rows_without_id_are_checked(spark, scratch):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    rows = [(None, f"t{i % 30}") for i in range(60)]
    got = dedup_exact(spark.createDataFrame(rows, "doc_id long, text string"), scratch, digest=weak).collect()
    assert len(got) == 60 and {r["group_size"] for r in got} == {2}


def test_empty(no_docs, scratch):
    assert dedup_exact(no_docs, scratch).count() == 0


def test_later_batches_update_the_state(spark, scratch):
    from rowlens.llm.exact_dedup import run_stream

    at = scratch.path("in")
    schema = "digest string, doc_id long, chars long, file string, row long"
    spark.createDataFrame([("a", 5, 3, "f", 1), ("b", 6, 1, "f", 2)], schema).write.parquet(at)
    spark.createDataFrame([("a", 4, 3, "g", 1), ("a", 9, 2, "g", 2)], schema).write.mode("append").parquet(at)
    spark.conf.set("spark.sql.streaming.fileSource.cleaner.numThreads", "1")
    got = {r["digest"]: (r["best"]["doc_id"], r["group_size"]) for r in run_stream(at, spark.read.parquet(at).schema, scratch).collect()}
    assert got == {"a": (4, 3), "b": (6, 1)}
