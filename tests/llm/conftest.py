import random

import pytest

from rowlens.llm.common import Scratch

CLASHES = "digest string, size long, `group` int, `key` string, sig binary, `order` int, p double, copies int, id long, body string, start int, score double, unit binary, rid long, component string, `_h` int, row int, file string"


@pytest.fixture
def scratch(spark):
    with Scratch(spark) as s:
        yield s


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def hard_rows():
    """Documents with nulls, blanks, one very long text, copies of several kinds, ties and repeated rows."""
    rng = random.Random(4)
    base = [words(rng, rng.randint(20, 120)) for _ in range(25)]
    passage = words(rng, 70)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [
        (100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\r\n\x0b\x0c ", "en", None, 7), (103, None, "en", "s1", -5), (104, "one", "en", "s1", 3), (105, "ONE", "en", "s1", 3), (106, "One\n", "en", "s2", 4),
        (107, words(rng, 30_000), "en", "s2", 1), (108, base[0] + " ", "en", "s0", 1), (109, base[0].replace(" ", "\n"), "en", "s0", 1), (110, base[1] + " " + passage, "de", "s1", 1), (111, passage + " " + base[2], "de", "s1", 1), (112, base[3] + " extra", "fr", "s2", 1),
        (113, "é ß 日本 \U0001f600 " * 40, "ja", "s2", 1), (114, "ab " * 300, "en", "s0", 1), (115, "x" * 5000, "en", "s0", 1), (116, "\x00\x01 nul", "en", "s0", 1), (5, base[5], "en", f"s{5 % 3}", len(base[5])), (None, base[6], "en", "s0", 1), (None, "only here", "en", "s0", 1),
    ]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard_docs(spark, hard_rows):
    """Those rows in several partitions, with more columns whose names clash with internal ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows, SCHEMA).repartition(3)
    for field in CLASHES.split(", "):
        name, kind = field.replace("`", "").split(" ")
        df = df.withColumn(name, F.lit(None).cast(kind))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
