"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for what no rule covers.

Rules, features, statistics of suffixes, bins and the trees themselves are DataFrame expressions. The driver only
fits the trees, on at most about FIT_ROWS labelled urls that come to it as counted cells of bins.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, ascii_lower

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Bound on the labelled urls that trees are fitted on, drawn evenly by a hash of the url.
FIT_ROWS = 20_000
FOLDS = 5
BINS, TREES, DEPTH, RATE, RIDGE = 16, 32, 3, 0.3, 1.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A to Z lower-cased) and path; both empty for null and for urls without ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    whole = F.regexp_extract(rest, r"^[^?#]*", 0)
    slash = F.locate("/", whole)
    host = F.when(slash > 0, F.substr(whole, F.lit(1), slash - 1)).otherwise(whole)
    path = F.when(slash > 0, F.substr(whole, slash)).otherwise(F.lit(""))
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    out = F.when(F.lit(False), F.lit(None).cast("struct<rule: string, verdict: string>"))
    for rule, verdict in sorted(rules, key=lambda r: -len(r[0])):  # the longest that fits comes first
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = out.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the url's letters; a null url counts as empty."""
    url = F.coalesce(url, F.lit(""))
    low, n = ascii_lower(url), F.length(url)
    times = lambda s: (n - F.length(F.replace(low, F.lit(s)))).cast("double")
    digits = n - F.length(F.translate(url, "0123456789", ""))
    shares = F.transform(F.array(*[F.lit(c) for c in LOWER + "0123456789/.-_?&=%"]), lambda c: (n - F.length(F.replace(low, c))) / n)
    entropy = F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))).otherwise(0.0)
    dots = F.length(host) - F.length(F.replace(host, F.lit(".")))
    return {
        "length": n.cast("double"), "host_length": F.length(host).cast("double"), "path_length": F.length(path).cast("double"), "depth": (F.length(path) - F.length(F.replace(path, F.lit("/")))).cast("double"), "host_labels": dots.cast("double"),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0), "entropy": entropy, "parameters": times("&") + times("?"), "hyphens": times("-"), "escapes": times("%"), "secure": low.startswith("https").cast("double"), "fragment": times("#"),
    }


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def boost(bins: np.ndarray, n: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> tuple[float, list[tuple]]:
    """Base margin and trees, fitted on cells: a row of bins each, n urls, y of them blocked.

    A tree has a split (feature, last bin of the left side) for each level, the same for all nodes of it, and a value for each leaf, whose
    number has a bit for each level, the first one highest. Splits have the largest gain in the second-order approximation of the log
    loss, summed over the nodes; of equal gains the first.
    """
    total, blocked = n.sum(), y.sum()
    if not total:
        return 0.0, []
    base = math.log((blocked + 0.5) / (total - blocked + 0.5))
    out: list[tuple] = []
    score = np.full(len(n), base)
    for _ in range(trees if 0 < blocked < total else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - n * p, n * p * (1 - p)
        node, splits = np.zeros(len(n), dtype=np.int64), []
        while len(splits) < depth and (split := best_split(bins, node, 1 << len(splits), g, h)):
            splits.append(split)
            node = 2 * node + (bins[:, split[0]] > split[1])
        if not splits:
            break
        g, h = (np.bincount(node, weights=w, minlength=1 << len(splits)) for w in (g, h))
        values = (g / (h + RIDGE)).tolist()
        score += RATE * np.array(values)[node]
        out.append((splits, values))
    return base, out


def best_split(bins: np.ndarray, node: np.ndarray, nodes: int, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
    best, gain = None, 1e-6
    for f in range(bins.shape[1]):
        left_g, left_h = (np.cumsum(np.bincount(node * BINS + bins[:, f], weights=w, minlength=nodes * BINS).reshape(nodes, BINS), axis=1) for w in (g, h))
        all_g, all_h = left_g[:, -1:], left_h[:, -1:]
        gains = (left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)).sum(axis=0)[:-1]
        if gains.max() > gain + 1e-12:
            best, gain = (f, int(gains.argmax())), gains.max()
    return best


def margin(base: float, trees: list[tuple], right: Callable[[int, int], Column]) -> Column:
    """right says of a split whether a row goes to its right side."""
    out = F.lit(base)
    for splits, values in trees:
        leaf = reduce(lambda a, b: a + b, [F.when(right(*s), 1 << k).otherwise(0) for k, s in enumerate(reversed(splits))], F.lit(1))
        out = out + F.element_at(F.array(*[F.lit(RATE * v) for v in values]), leaf)
    return out


def filter_urls(pages: DataFrame, scratch: Scratch, rules=RULES, fit_rows: int = FIT_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict and score (odds to be blocked as a probability) of each row of pages.

    pages needs page_id and url; other columns are ignored. Labels are the urls that a rule decides. Null urls and urls
    without ``://`` have an empty host and path, fit no rule, and are judged by the trees on their letters. Without
    labelled urls the score is 0.5 and the verdict allow; with labels of one kind it follows the share of that kind.
    Repeated rows are judged each; an empty table gives no rows. A suffix's share of blocked urls is counted over all labelled urls; for a
    url that trees are fitted on, over those outside its own fold.
    """
    host, path = split_url(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    base = base.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("suffix", suffix_of(F.col("host")))
    labelled = base.filter("hit is not null").withColumn("y", (F.col("hit.verdict") == "block").cast("int")).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(23)), F.lit(FOLDS)))
    folds = scratch.save(labelled.groupBy("suffix", "fold").agg(F.count("*").alias("fold_n"), F.sum("y").alias("fold_y")), "folds")
    stats = folds.groupBy("suffix").agg(F.sum("fold_n").alias("all_n"), F.sum("fold_y").alias("all_y"))
    total = folds.agg(F.sum("fold_n")).first()[0] or 0
    numbers = lexical(F.col("url"), F.col("host"), F.col("path"))
    names = [*numbers, "suffix_rate"]
    share = min(1.0, fit_rows / total) if total else 1.0
    drawn = labelled.filter(F.pmod(F.xxhash64("url", F.lit(17)), F.lit(1 << 30)) < int(share * (1 << 30))).join(stats, "suffix").join(folds, ["suffix", "fold"])
    others = (F.col("all_y") - F.col("fold_y") + 1.0) / (F.col("all_n") - F.col("fold_n") + 2.0)
    drawn = scratch.save(drawn.select("y", *[c.alias(k) for k, c in numbers.items()], others.alias("suffix_rate")), "labelled")
    cuts_row = drawn.agg(*[F.percentile_approx(k, [i / BINS for i in range(1, BINS)], 1000).alias(k) for k in names]).first()
    cuts = {k: sorted(set(cuts_row[k] or [])) for k in names}
    features = [f"b_{k}" for k in names]
    binned = lambda k, c: reduce(lambda a, b: a + b, [(c > F.lit(float(x))).cast("int") for x in cuts[k]], F.lit(0)).alias(f"b_{k}")
    cells = drawn.select("y", *[binned(k, F.col(k)) for k in names]).groupBy(*features).agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy(*features).collect()  # about fit_rows at most
    table = np.array([tuple(r) for r in cells], dtype=np.int64).reshape(len(cells), len(features) + 2)
    start, trees = boost(table[:, :-2], table[:, -2].astype(float), table[:, -1].astype(float))
    used = sorted({f for splits, _ in trees for f, _ in splits})
    if names.index("suffix_rate") in used:
        base = base.join(stats, "suffix", "left")
        numbers["suffix_rate"] = F.coalesce((F.col("all_y") + 1.0) / (F.col("all_n") + 2.0), F.lit(0.5))
    scored = base.select("page_id", "host", "path", "hit", *[numbers[names[i]].alias(names[i]) for i in used])
    score = 1 / (1 + F.exp(-margin(start, trees, lambda f, b: F.col(names[f]) > F.lit(float(cuts[names[f]][b])))))
    scored = scored.select("page_id", "host", "path", "hit", score.alias("score"))
    verdict = F.coalesce(F.col("hit.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"), "score")
