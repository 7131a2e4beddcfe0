"""Command line: ``python -m rowlens LEFT RIGHT``. Exit code 0: same, 1: different, 2: error."""

from __future__ import annotations

import argparse
import sys

from .api import diff_files
from .plans.config import DiffError
from .sources.files import detect_format


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rowlens", description="Semantic comparison of two CSV or Parquet tables.")
    p.add_argument("left", nargs="?")
    p.add_argument("right", nargs="?")
    p.add_argument("-k", "--key", type=lambda s: s.split(","), help="key columns, separated by commas; inferred when omitted")
    p.add_argument("--keyless", action="store_true", help="match rows by whole content")
    p.add_argument("--tol-abs", type=float)
    p.add_argument("--tol-rel", type=float)
    p.add_argument("--fail-fast", type=int, metavar="N", help="stop after N row differences")
    p.add_argument("--samples", type=int, default=10, help="rows shown of each kind of change")
    p.add_argument("--memory-mb", type=int, default=256, help="no effect: memory is a setting of the cluster")
    p.add_argument("--spill-dir", help="no effect: spill folders are a setting of the cluster")
    p.add_argument("--assume-sorted", action="store_true", help="check that both files are sorted by the key")
    p.add_argument("--where", metavar="EXPR", help="row filter for both sides")
    p.add_argument("--input-format", choices=["csv", "parquet"])
    p.add_argument("--git", nargs=7, metavar="ARG", help="run as a git diff driver")
    p.add_argument("--format", choices=["human", "json"], default="human")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.git and (args.left is None or args.right is None):
        p.error("LEFT and RIGHT are required")
    if args.keyless and (args.key or args.tol_abs is not None or args.tol_rel is not None or args.assume_sorted):
        p.error("--keyless cannot be used with --key, --tol-abs, --tol-rel or --assume-sorted")
    if args.assume_sorted and not args.key:
        p.error("--assume-sorted requires --key")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("rowlens").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    names = ("key", "keyless", "tol_abs", "tol_rel", "fail_fast", "samples", "memory_mb", "spill_dir", "assume_sorted", "where", "input_format")
    options = {n: getattr(args, n) for n in names}
    color = sys.stdout.isatty()
    if args.git:
        return _git(spark, args.git, options, color)
    try:
        report = diff_files(spark, args.left, args.right, **options)
    except Exception as error:
        print(f"rowlens: error: {_first_line(error)}", file=sys.stderr)
        return 2
    print(report.to_json() if args.format == "json" else report.to_text(color), end="\n" if args.format == "json" else "")
    return 1 if report.has_differences else 0


def _git(spark, args: list[str], options: dict, color: bool) -> int:
    """git gives: path old-file old-hex old-mode new-file new-hex new-mode. It stops at any exit code but 0, so problems are printed."""
    path, old, new = args[0], args[1], args[4]
    print(f"\x1b[1mrowlens {path}\x1b[0m" if color else f"rowlens {path}")
    nothing = ("/dev/null", "nul")
    if old in nothing or new in nothing:
        print("(new file)" if old in nothing else "(deleted file)")
        return 0
    try:
        kind = detect_format(path)
    except DiffError as error:
        print(f"(skipped: {error})")
        return 0
    try:
        print(diff_files(spark, old, new, **options | {"input_format": kind}).to_text(color), end="")
    except Exception as error:
        print(f"(rowlens error: {_first_line(error)})")
    return 0


def _first_line(error: Exception) -> str:
    return (str(error).splitlines() or [type(error).__name__])[0]
