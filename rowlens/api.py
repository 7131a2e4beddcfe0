"""Compare two tables: ``diff_frames`` on DataFrames, ``diff`` on files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.cells import Tolerance
from .functions.predicate import condition, parse
from .operators.frames import Side
from .operators.keyed import KeyedPlan, Pair, compare_keyed, first_differences, keyed_samples, keyed_totals
from .operators.keyless import compare_keyless, keyless_differences, keyless_totals, order_of
from .operators.keys import KEY_SAMPLE, check_sorted, duplicate_keys, infer_key
from .operators.renames import RENAME_SAMPLE, detect_renames
from .plans.config import DiffError, Options
from .plans.schema import SchemaDiff, check_key, compare_schemas
from .report import ModifiedSample, Report, Sample, plain, quoted
from .sources.files import FORMATS, read_table


@dataclass(frozen=True)
class Comparison:
    """A planned comparison; nothing of the tables is read yet beyond the samples that key and renames need."""

    options: Options
    schema: SchemaDiff
    left: Side
    right: Side
    key: list[str] | None
    inferred: bool
    pairs: list[Pair]

    def keyed(self) -> KeyedPlan:
        return compare_keyed(self.left, self.right, self.key, self.pairs, Tolerance(self.options.tol_abs, self.options.tol_rel))

    def groups(self) -> DataFrame:
        return compare_keyless(self.left, self.right, self.pairs)

    def report(self) -> Report:
        return _keyed_report(self) if self.key is not None else _keyless_report(self)


def plan(left: DataFrame, right: DataFrame, options: Options = Options(), *, labels: tuple[str, str] = ("left", "right"), prefixes: tuple[Callable[[int], DataFrame], Callable[[int], DataFrame]] | None = None) -> Comparison:
    """Decide schema, key and renames, in that order, and check the options against them."""
    prefix = prefixes or (left.limit, right.limit)
    schema = compare_schemas(left.schema, right.schema)
    options.check()
    a, b = Side.of(left, "l", labels[0]), Side.of(right, "r", labels[1])
    sample = lambda side, tag, n, names: Side.of(prefix[side](n), tag, labels[side]).only(names)
    key, inferred = None, False
    if options.key:
        check_key(options.key, schema)
        key = list(options.key)
    elif not options.keyless:
        found = infer_key(sample(0, "l", KEY_SAMPLE, schema.mutual), sample(1, "r", KEY_SAMPLE, schema.mutual), schema.mutual)
        inferred = True
        if found is not None:
            key = [found]
        elif options.tolerant:
            raise DiffError("key inference failed and keyless mode cannot honor float tolerances; pass --key or drop --tol-abs/--tol-rel")
    if schema.added and schema.removed:
        need = key or []
        schema.rename(detect_renames(sample(0, "l", RENAME_SAMPLE, need + [c.name for c in schema.removed]), sample(1, "r", RENAME_SAMPLE, need + [c.name for c in schema.added]), schema, key))
    pairs = [Pair(n, n, n) for n in schema.mutual if n not in (key or [])] + [Pair(f"{r.left}→{r.right}", r.left, r.right) for r in schema.renamed]
    a, b = a.only(schema.mutual + [r.left for r in schema.renamed]), b.only(schema.mutual + [r.right for r in schema.renamed])
    if options.where is not None:
        clauses = parse(options.where)
        for c in clauses:
            if c.column not in schema.mutual:
                raise DiffError(f"--where column `{c.column}` must exist in both tables (shared columns: {', '.join(schema.mutual)})")
        a, b = (s.where(condition(clauses, {c.column: (s.column(c.column), s.kinds[c.column]) for c in clauses})) for s in (a, b))
    return Comparison(options, schema, a, b, key, inferred, pairs)


def diff_frames(left: DataFrame, right: DataFrame, **options) -> Report:
    """Compare two DataFrames. Options are those of ``Options``; key may be a name or a list of names."""
    return plan(left, right, _options(options)).report()


def diff_files(spark: SparkSession, left: str, right: str, *, input_format: str | None = None, **options) -> Report:
    if input_format is not None and input_format not in set(FORMATS.values()):
        raise ValueError(f"input_format must be 'csv' or 'parquet', got {input_format!r}")
    tables = [read_table(spark, str(p), input_format) for p in (left, right)]
    return plan(tables[0].df, tables[1].df, _options(options), labels=(str(left), str(right)), prefixes=(tables[0].prefix, tables[1].prefix)).report()


def diff(left: str, right: str, *, spark: SparkSession | None = None, **options) -> dict:
    """Compare two files; the report as a dict, with has_differences."""
    spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    report = diff_files(spark, left, right, **options)
    return report.to_dict() | {"has_differences": report.has_differences}


def _options(given: dict) -> Options:
    key = given.get("key")
    return Options(**given | {"key": None if key is None else (key,) if isinstance(key, str) else tuple(key)})


def _keyed_report(c: Comparison) -> Report:
    if c.options.assume_sorted:
        check_sorted(c.left, c.right, c.key)
        check_sorted(c.right, c.left, c.key)
    planned, limit = c.keyed(), c.options.fail_fast
    # Totals and samples in one query: they share the shuffles of both sides.
    totals = keyed_totals(planned)
    struct_of = lambda df: F.struct(*[F.col(x) for x in df.columns])
    some = keyed_samples(planned, c.options.samples) if limit is None else first_differences(planned, limit).withColumn("place", F.monotonically_increasing_id())
    some = some.select("change", "key", "left_row", "right_row", "differs", "place", *planned.order)
    both = totals.select(struct_of(totals).alias("totals")).withColumn("sample", F.lit(None).cast(some.schema.simpleString()))
    both = both.unionByName(some.select(F.lit(None).cast(both.schema["totals"].dataType).alias("totals"), struct_of(some).alias("sample")))
    got = both.collect()  # one row of totals, and at most 3 * samples or fail_fast rows
    t = next(r["totals"] for r in got if r["totals"] is not None)
    for side, other, n in ((c.left, c.right, t["left_twice"]), (c.right, c.left, t["right_twice"])):
        if n:
            _raise_duplicate(side, c.key)
    samples = sorted((r["sample"] for r in got if r["sample"] is not None), key=lambda s: s["place"])
    counts = {k: t[k] for k in ("added", "removed", "modified")}
    changed = {p.label: n for p, n in zip(c.pairs, t["changed"], strict=True) if n}
    truncated = False
    if limit is not None and sum(counts.values()) >= limit:
        truncated = True
        counts = {k: sum(s["change"] == k for s in samples) for k in counts}
        changed = {p.label: n for j, p in enumerate(c.pairs) if (n := sum(bool(s["differs"] and s["differs"][j]) for s in samples))}
    report = Report(c.schema, c.key, c.inferred, False, (t["n_left"], t["n_right"]), **counts, columns_changed=changed, truncated=truncated)
    for kind, out in (("added", report.added_samples), ("removed", report.removed_samples)):
        for s in [s for s in samples if s["change"] == kind][: c.options.samples]:
            out.append(Sample([(k, plain(s["key"][i])) for i, k in enumerate(c.key)]))
    for s in [s for s in samples if s["change"] == "modified"][: c.options.samples]:
        changes = [(p.label, quoted(s["left_row"][j]), quoted(s["right_row"][j])) for j, p in enumerate(c.pairs) if s["differs"][j]]
        report.modified_samples.append(ModifiedSample([(k, plain(s["key"][i])) for i, k in enumerate(c.key)], changes))
    return report


def _raise_duplicate(side: Side, key: list[str]) -> None:
    row = duplicate_keys(side.df, [side.column(k) for k in key]).first()
    example = ", ".join(f"{k}={plain(row[i])}" for i, k in enumerate(key))
    raise DiffError(f"key ({', '.join(key)}) is not unique in {side.label}: e.g. {example}; pick a different --key or use --keyless")


def _keyless_report(c: Comparison) -> Report:
    groups, width, limit = c.groups(), len(c.pairs), c.options.fail_fast
    different = keyless_differences(groups, width)
    totals = keyless_totals(groups).first()
    order = order_of(width, dict(different.dtypes))
    added, removed, truncated = totals["added"], totals["removed"], False
    if limit is not None and added + removed >= limit:
        truncated, added, removed = True, 0, 0
        for r in different.orderBy(*order).limit(limit).collect():  # each adds at least one
            if added + removed >= limit:
                break
            added, removed = (added + r["instances"], removed) if r["change"] == "added" else (added, removed + r["instances"])
    report = Report(c.schema, [], c.inferred, True, (totals["n_left"], totals["n_right"]), added, removed, 0, {}, truncated=truncated)
    for kind, out in (("added", report.added_samples), ("removed", report.removed_samples)):
        for r in different.filter(F.col("change") == kind).orderBy(*order).limit(c.options.samples).collect():
            out.append(Sample([(p.right if kind == "added" else p.left, plain(_shown(r[f"c{i}"]))) for i, p in enumerate(c.pairs)], r["instances"]))
    return report


def _shown(cell):
    """The value in a content cell: of a cell that may hold several classes, the one that is there."""
    if hasattr(cell, "asDict") and set(cell.asDict()) == {"flag", "whole", "real", "words"}:
        return next((v for v in cell if v is not None), None)
    return cell
