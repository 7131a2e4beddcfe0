"""CSV and Parquet files as tables to compare."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.config import DiffError

FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet"}
CSV_SAMPLE = 10_000
# What a CSV cell may look like to count as a type. Times of day are texts: they name no day.
_INT = r"^-?[0-9]+$"
_FLOAT = r"^-?(([0-9]*\.[0-9]+|[0-9]+\.[0-9]*)([eE][-+]?[0-9]+)?|[0-9]+[eE][-+]?[0-9]+)$"
_BOOL = r"^(?i)(true|false)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"


def detect_format(path: str) -> str:
    ending = os.path.splitext(path)[1].lstrip(".").lower()
    if ending not in FORMATS:
        raise DiffError(f"unsupported file extension `{ending}` (expected .csv or .parquet)")
    return FORMATS[ending]


@dataclass(frozen=True)
class Table:
    """A file's rows, and a way to its first rows."""

    df: DataFrame
    format: str
    path: str

    def prefix(self, rows: int) -> DataFrame:
        """The first rows: of Parquet files in the order of their paths, of CSV files any."""
        if self.format != "parquet":
            return self.df.limit(rows)
        files, k, counts = sorted(self.df.inputFiles()), 1, {}
        while files and sum(counts.values()) < rows and k <= 2 * len(files):  # footers of the first files only
            k, first = 2 * k, files[:k]
            counts = {r[0]: r[1] for r in self.df.sparkSession.read.schema(self.df.schema).parquet(*first).groupBy("_metadata.file_path").count().collect()}
            if len(first) == len(files):
                break
        wanted = F.lit(False)
        for path in sorted(counts):
            if rows > 0:
                wanted = wanted | ((F.col("_metadata.file_path") == path) & (F.col("_metadata.row_index") < rows))
                rows -= counts[path]
        return self.df.filter(wanted)


def read_table(spark: SparkSession, path: str, forced: str | None = None, multiline: bool = False) -> Table:
    """The table at path, read by its extension or as forced (csv or parquet). multiline lets CSV cells hold line breaks."""
    kind = forced or detect_format(path)
    try:
        if kind == "parquet":
            return Table(spark.read.parquet(path), kind, path)
        return Table(_read_csv(spark, path, multiline), kind, path)
    except DiffError:
        raise
    except Exception as error:
        raise DiffError(f"failed to read {path}: {str(error).splitlines()[0]}") from error


def _read_csv(spark: SparkSession, path: str, multiline: bool) -> DataFrame:
    raw = spark.read.option("header", True).option("inferSchema", False).option("mode", "FAILFAST").option("multiLine", multiline).option("escape", '"').csv(path)
    names = raw.columns
    cells = raw.toDF(*[f"c{i}" for i in range(len(names))])
    cells = cells.select(*[F.when(F.col(c) != "", F.col(c)).alias(c) for c in cells.columns])
    kinds = infer_csv(cells.limit(CSV_SAMPLE))
    typed = [as_type(F.col(c), k) for c, k in zip(cells.columns, kinds, strict=True)]
    return cells.select(*[t.alias(n) for t, n in zip(typed, names, strict=True)])


def infer_csv(cells: DataFrame) -> list[T.DataType]:
    """Types of text columns from their cells; empty cells are null and fit any. A column without values is text."""
    tests = {"bool": _BOOL, "int": _INT, "float": f"{_INT}|{_FLOAT}", "date": _DATE, "stamp": f"{_DATE}|{_STAMP}"}
    parts = [F.count(c).alias(f"{c}_n") for c in cells.columns] + [F.count_if(F.col(c).rlike(rx)).alias(f"{c}_{k}") for c in cells.columns for k, rx in tests.items()]
    row = cells.agg(*parts).first()
    kinds = {"bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType(), "date": T.DateType(), "stamp": T.TimestampNTZType()}
    return [next((kinds[k] for k in tests if row[f"{c}_n"] and row[f"{c}_{k}"] == row[f"{c}_n"]), T.StringType()) for c in cells.columns]


def as_type(c: Column, kind: T.DataType) -> Column:
    """A text cell in its column's type. A cell that does not fit, beyond the sample, fails the query: it is never made null."""
    return c if isinstance(kind, T.StringType) else c.cast(kind)
