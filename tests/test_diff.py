"""End to end, on small files of the shapes that FIXTURES.md lists."""

import json

import pytest

from rowlens import DiffError, Options, diff, diff_files, diff_frames, plan
from rowlens.cli import main
from rowlens.sources.files import Table

LEFT = "id,name,amount,status,legacy\n1,ann,10.0,open,x\n2,ben,20.5,open,y\n3,cat,30.0,closed,z\n4,dan,2.5,open,w\n5,eli,50.0,pending,v\n"
RIGHT = "id,name,amount,status,email\n1,ann,10.0,open,a@x\n2,ben,20.50001,open,b@x\n3,cat,30.0,open,c@x\n4,dan,2.5,open,d@x\n6,fay,60.0,open,f@x\n"
EVENTS_LEFT = "ts,sensor,temp\n10:00,A,21.5\n10:00,A,21.5\n10:00,B,19.8\n10:05,A,21.6\n"
EVENTS_RIGHT = "ts,sensor,temp\n10:00,A,21.5\n10:00,B,19.8\n10:05,A,21.7\n10:10,C,18.0\n"


@pytest.fixture
def files(tmp_path):
    rename = [f"{i},n{i},{i * 1.5}" for i in range(1, 31)]
    texts = {
        "left": LEFT, "right": RIGHT, "events_left": EVENTS_LEFT, "events_right": EVENTS_RIGHT, "dup": "id,v\n1,a\n1,b\n2,c\n", "unsorted": "id,v\n2,b\n1,a\n",
        "rename_left": "id,name,amount\n" + "\n".join(rename), "rename_right": "id,name,amt\n" + "\n".join("7,n7,999.0" if r.startswith("7,") else r for r in rename),
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return lambda name: str(tmp_path / f"{name}.csv")


def counts(r):
    return r.added, r.removed, r.modified


def test_basic(spark, files):
    r = diff_files(spark, files("left"), files("right"))
    assert (r.key, r.inferred, counts(r), r.columns_changed) == (["id"], True, (1, 1, 2), {"amount": 1, "status": 1})
    assert [c.name for c in r.schema.added] == ["email"] and [c.name for c in r.schema.removed] == ["legacy"] and r.has_differences
    text = r.to_text()
    assert '~ id=3  status: "closed" → "open"' in text and "~ id=2  amount: 20.5 → 20.50001" in text and "+ id=6" in text and "- id=5" in text


@pytest.mark.parametrize(
    ("options", "want", "rows"),
    [
        ({"tol_abs": 0.001}, (1, 1, 1), (5, 5)), ({"key": ["id", "name"]}, (1, 1, 2), (5, 5)), ({"where": "status = 'open'"}, (2, 0, 1), (3, 5)), ({"where": "amount >= 20 AND amount < 60"}, (0, 1, 2), (3, 2)),
        ({"key": "id", "assume_sorted": True}, (1, 1, 2), (5, 5)), ({"memory_mb": 0, "spill_dir": "/nowhere"}, (1, 1, 2), (5, 5)), ({"tol_rel": 1e-6}, (1, 1, 1), (5, 5)),
    ],
)
def test_options(spark, files, options, want, rows):
    r = diff_files(spark, files("left"), files("right"), **options)
    assert counts(r) == want and r.rows == rows and not r.truncated


@pytest.mark.parametrize(("n", "total"), [(0, 0), (1, 1), (3, 3), (4, 4), (5, 4)])
def test_fail_fast(spark, files, n, total):
    r = diff_files(spark, files("left"), files("right"), fail_fast=n)
    assert sum(counts(r)) == total and r.truncated == (n <= 4) and r.rows == (5, 5)


def test_fail_fast_takes_the_first_in_key_order(spark, files):
    assert counts(diff_files(spark, files("left"), files("right"), fail_fast=3)) == (0, 1, 2)


def test_identical(spark, files):
    r = diff_files(spark, files("left"), files("left"))
    assert not r.has_differences and r.to_text().endswith("No differences found.\n")


def test_keyless(spark, files):
    r = diff_files(spark, files("events_left"), files("events_right"), keyless=True)
    assert r.keyless and not r.inferred and counts(r) == (2, 2, 0)
    assert "+ ts=10:10, sensor=C, temp=18" in r.to_text()
    auto = diff_files(spark, files("events_left"), files("events_right"))
    assert auto.keyless and auto.inferred and counts(auto) == (2, 2, 0)
    assert not diff_files(spark, files("events_left"), files("events_left"), keyless=True).has_differences


def test_keyless_fail_fast_counts_whole_groups(spark):
    a, b = spark.createDataFrame([(1,)] * 5 + [(2,)] * 3, "v int"), spark.createDataFrame([(3,)], "v int")
    r = diff_frames(a, b, keyless=True, fail_fast=2)
    assert counts(r) == (0, 5, 0) and r.truncated
    assert diff_frames(a, b, keyless=True).removed_samples[0].count == 5


@pytest.mark.parametrize(
    ("pair", "options", "message"),
    [
        (("dup", "dup"), {"key": "id"}, "not unique"), (("left", "right"), {"where": "nothing = 1"}, "nothing"), (("events_left", "events_right"), {"keyless": True, "tol_abs": 1.0}, "not supported"), (("events_left", "events_right"), {"tol_abs": 1.0}, "inference failed"),
        (("left", "right"), {"keyless": True, "key": "id"}, "mutually exclusive"), (("left", "right"), {"assume_sorted": True}, "explicit"), (("left", "right"), {"keyless": True, "assume_sorted": True}, "requires a key"), (("left", "right"), {"key": "legacy"}, "both tables"), (("unsorted", "unsorted"), {"key": "id", "assume_sorted": True}, "not sorted"),
        (("left", "right"), {"where": "amount <> 1"}, "number"),
    ],
)
def test_errors(spark, files, pair, options, message):
    with pytest.raises((DiffError, ValueError), match=message):
        diff_files(spark, files(pair[0]), files(pair[1]), **options)


def test_no_shared_columns(spark):
    with pytest.raises(DiffError, match="share no columns"):
        diff_frames(spark.range(1).toDF("a"), spark.range(1).toDF("b"))


def test_formats(spark, files, tmp_path):
    spark.read.csv(files("right"), header=True, inferSchema=True).write.parquet(str(tmp_path / "right.parquet"))
    assert counts(diff_files(spark, files("left"), str(tmp_path / "right.parquet"))) == (1, 1, 2)
    (tmp_path / "odd.txt").write_text(LEFT)
    with pytest.raises(DiffError, match="unsupported file extension"):
        diff_files(spark, str(tmp_path / "odd.txt"), files("right"))
    assert counts(diff_files(spark, str(tmp_path / "odd.txt"), files("right"), input_format="csv")) == (1, 1, 2)
    with pytest.raises(ValueError, match="must be"):
        diff_files(spark, files("left"), files("right"), input_format="orc")
    with pytest.raises(DiffError, match="failed to read"):
        diff_files(spark, str(tmp_path / "none.csv"), files("right"))


def test_cell_beyond_the_sample_that_does_not_fit_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n" + "\n".join(f"{i},{i}" for i in range(10_001)) + "\n10001,word\n")
    with pytest.raises(Exception, match="word"):
        diff_files(spark, str(tmp_path / "a.csv"), str(tmp_path / "a.csv"), key="id")


def test_cross_type_keys(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "n")], "id long, v string")
    b = spark.createDataFrame([(1.0, "x"), (2.0, "z"), (None, "n")], "id double, v string")
    r = diff_frames(a, b, key="id")
    assert counts(r) == (0, 0, 1) and [c.name for c in r.schema.type_changed] == ["id"]
    text = diff_frames(a, spark.createDataFrame([("1", "x"), ("2", "y")], "id string, v string"), key="id")
    assert counts(text) == (0, 1, 0)


def test_two_null_keys_are_duplicates(spark):
    a = spark.createDataFrame([(None, "x"), (None, "y")], "id long, v string")
    with pytest.raises(DiffError, match="not unique in left: e.g. id=NULL"):
        diff_frames(a, a, key="id")


def test_renames(spark, files):
    r = diff_files(spark, files("rename_left"), files("rename_right"))
    assert [(x.left, x.right) for x in r.schema.renamed] == [("amount", "amt")] and counts(r) == (0, 0, 1) and r.columns_changed == {"amount→amt": 1}


def test_keyless_renames(spark):
    a = spark.createDataFrame([(f"c{i}", g) for i in range(30) for g in "ab"] * 1, "code string, grp string")
    r = diff_frames(a, a.withColumnRenamed("code", "token"), keyless=True)
    assert [(x.left, x.right) for x in r.schema.renamed] == [("code", "token")] and counts(r) == (0, 0, 0)
    flags = spark.createDataFrame([(i % 2 == 0, str(i % 9)) for i in range(40)], "flag boolean, v string")
    low = diff_frames(flags, flags.withColumnRenamed("flag", "active"), keyless=True)
    assert not low.schema.renamed and len(low.schema.added) == len(low.schema.removed) == 1


def test_big_keyed(spark):
    a = spark.range(60_000).selectExpr("id", "id * 2 as val", "concat('t', id % 7) as tag")
    b = a.filter("not id between 100 and 109").selectExpr("id", "case when id % 1000 = 0 then val + 1 else val end as val", "tag").union(spark.range(60_000, 60_005).selectExpr("id", "id * 2", "'t'"))
    r = diff_frames(a, b)
    assert counts(r) == (5, 10, 60) and r.rows == (60_000, 59_995) and len(r.modified_samples) == 10
    assert "… 50 more row difference(s) not shown" in r.to_text()


def test_names_with_dots_and_case(spark):
    a = spark.createDataFrame([(1, 2, 3)], "`a.b` int, A int, a int") if spark.conf.get("spark.sql.caseSensitive") == "true" else spark.createDataFrame([(1, 2)], "`a.b` int, A int")
    assert not diff_frames(a, a, key="a.b").has_differences
    b = spark.createDataFrame([(1, 2)], "`a.b` int, a int")
    r = diff_frames(spark.createDataFrame([(1, 2)], "`a.b` int, A int"), b, key="a.b")
    assert [c.name for c in r.schema.added] == ["a"] and [c.name for c in r.schema.removed] == ["A"]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "id long, v string")
    r = diff_frames(e, e)
    assert r.key == ["id"] and r.inferred and not r.has_differences
    assert counts(diff_frames(e, spark.createDataFrame([(1, "x")], "id long, v string"))) == (1, 0, 0)
    assert not diff_frames(e, e, keyless=True).has_differences


def test_plan_joins_on_the_shuffle_of_the_duplicate_check(spark):
    a = spark.range(1000).selectExpr("id", "id as v")
    c = plan(a, a, Options(key=("id",)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    text = c.keyed().rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2 and "FullOuter" in text


def test_dict_and_json(spark, files):
    d = diff(files("left"), files("right"), spark=spark)
    assert d["has_differences"] and d["diff"] == {"added": 1, "removed": 1, "modified": 2} and d["key"] == {"columns": ["id"], "inferred": True}
    assert list(d)[:8] == ["schema", "key", "keyless", "rows", "diff", "columns_changed", "samples", "truncated"] and "mutual" not in d["schema"]
    assert json.loads(json.dumps(d))["samples"]["modified"][0]["changes"] == [{"column": "amount", "left": "20.5", "right": "20.50001"}]


def test_command_line(spark, files, capsys, tmp_path):
    assert main([files("left"), files("left")], spark) == 0
    assert main([files("left"), files("right"), "--format", "json"], spark) == 1
    assert json.loads(capsys.readouterr().out.split("No differences found.\n")[1])["diff"]["modified"] == 2
    assert main([files("dup"), files("dup"), "--key", "id"], spark) == 2
    assert "not unique" in capsys.readouterr().err
    for name, text in (("old", LEFT), ("new", RIGHT)):
        (tmp_path / name).write_text(text)
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    assert main(["--git", "t.csv", old, "0", "0", new, "0", "0"], spark) == 0 and "1 added" in capsys.readouterr().out
    assert main(["--git", "t.csv", "/dev/null", "0", "0", new, "0", "0"], spark) == 0 and "(new file)" in capsys.readouterr().out
    assert main(["--git", "t.csv", old, "0", "0", "/dev/null", "0", "0"], spark) == 0 and "(deleted file)" in capsys.readouterr().out
    assert main(["--git", "t.txt", old, "0", "0", new, "0", "0"], spark) == 0 and "(skipped" in capsys.readouterr().out
    assert main(["--git", "t.csv", old, "0", "0", str(tmp_path / "gone"), "0", "0"], spark) == 0 and "error" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["--keyless", "--key", "id", old, new], spark)


def test_streaming_balance(spark, tmp_path):
    from rowlens.streaming.keyless_stream import keyless_balance

    for name, rows in (("a", [(1,), (1,), (2,)]), ("b", [(1,), (3,)])):
        spark.createDataFrame(rows, "v int").write.parquet(str(tmp_path / name))
    streams = [spark.readStream.schema("v int").parquet(str(tmp_path / n)) for n in "ab"]
    q = keyless_balance(*streams).writeStream.outputMode("complete").format("memory").queryName("balance").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["v"], r["balance"]) for r in spark.table("balance").collect()} == {(1, 1), (2, 1), (3, -1)}


def test_assume_sorted_over_a_directory(spark, tmp_path):
    at, other = str(tmp_path / "t"), str(tmp_path / "u")
    for i, (lo, hi) in enumerate(((0, 10), (10, 100_000), (100_000, 100_020))):
        spark.range(lo, hi, 1, 1).write.parquet(f"{at}/{i}.parquet")
        spark.range(lo, hi, 1, 1).write.parquet(f"{other}/{2 - i}.parquet")
    read = lambda p: spark.read.option("recursiveFileLookup", True).parquet(p)
    assert not diff_frames(read(at), read(at), key="id", assume_sorted=True).has_differences
    with pytest.raises(DiffError, match="not sorted"):
        diff_frames(read(at), read(other), key="id", assume_sorted=True)


def test_prefix_of_many_files(spark, tmp_path):
    at = str(tmp_path / "t")
    for i in range(7):
        spark.range(100 * i, 100 * i + 100, 1, 1).coalesce(1).write.mode("append").parquet(f"{at}/{i}.parquet")
    table = Table(spark.read.option("recursiveFileLookup", True).parquet(at), "parquet", at)
    for n in (0, 1, 100, 101, 350, 700, 9000):
        assert sorted(r[0] for r in table.prefix(n).collect()) == list(range(min(n, 700)))
