"""Helpers shared by the training-data operators: scratch tables, text rules, Arrow access."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS = 1 << 23
FILE_ROWS = 100_000  # of a scratch table with a known number of narrow rows


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set in a local session, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="rowlens-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python a thousand at a time, or 8 MB, in place of ten thousand or 64 MB."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that gives free memory back to the system at its end: workers live on for other tasks."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


class Scratch:
    """Intermediate Parquet tables in the shared folder, removed when the block ends.

    ``save`` writes a table and reads it back, which cuts lineage in a way that outlives any executor.
    ``keep`` does the same for the result, in a place that stays after the block.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/rowlens/{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        small_batches(self.spark)
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            self.remove(path)

    def path(self, name: str) -> str:
        self.paths.append(at := f"{self.root}/{name}-{len(self.paths)}")
        return at

    def save(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: about as many as the table has at most, if known. Few rows then make few files, and few tasks for what follows."""
        at = self.path(name)
        (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, df_or_path) -> None:
        """Remove a saved table before the block ends, to free disk."""
        for at in df_or_path.inputFiles() if isinstance(df_or_path, DataFrame) else [df_or_path]:
            self.remove(at)

    def keep(self, df: DataFrame, name: str = "result") -> DataFrame:
        at = f"{self.root}/{name}-kept"
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def remove(self, path: str) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case, other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def id_crc(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def byte_list(column: pa.Array) -> list[bytes]:
    """A string column as byte strings; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one, named row: beside it no name of ours can clash with a column. ``select("row.*")`` gives df back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")


def _maybe_in(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """row (all of df) and hit: false where the key is surely not in ids (ids.key), by a bitmap of at most 1 MB whatever the input."""
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(BITS))
    maps = ids.select(spot(F.col(key)).alias("h")).groupBy(F.expr("bitmap_bucket_number(h)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(h))").alias("map"))
    out = df.select(spot(F.col(key)).alias("h"), whole_row(df)).withColumn("bucket", F.expr("bitmap_bucket_number(h)"))
    out = out.join(F.broadcast(maps), "bucket", "left")  # at most BITS / 32768 rows of 4 KB
    hit = F.expr("(cast(conv(hex(substring(map, cast(bitmap_bit_position(h) div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(bitmap_bit_position(h) % 8 as int))) != 0")
    return out.select("row", F.coalesce(hit, F.lit(False)).alias("hit"))


def prune_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key may be in ids. There are false positives, never false negatives; a join must follow.

    It only spares the shuffle of wide rows, and spares less of it the more ids there are.
    """
    return _maybe_in(df, ids, key).filter("hit").select("row.*")


def remove_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in ids; rows without a key stay. Only rows that may go are shuffled."""
    marked = _maybe_in(df, ids, key)
    left = marked.filter("hit").select("row", F.col(f"row.{key}").alias("key")).join(ids.select(F.col(key).alias("key")), "key", "left_anti")
    return marked.filter("not hit").select("row.*").union(left.select("row.*"))
