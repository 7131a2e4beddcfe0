"""Suffix-array deduplication: every byte covered by a 200-byte string that also starts elsewhere.

A sort of all suffixes would move the corpus many times over; only suffixes that can repeat for 200 bytes need an order.

1. Anchors. In each 200-byte string the KGRAM-byte string with the smallest hash, leftmost first, is its anchor. Equal strings
   have equal anchors at equal places. Consecutive strings with the same anchor form a tile.
2. Tiles whose anchor is unique in the corpus hold no repeats. Tiles with the same anchor and content repeat as a whole.
3. What is left are tiles that share an anchor and differ somewhere. Aligned at their anchors, they are dealt to shards, and each shard gets its (positional)
   Burrows-Wheeler transform. The transforms are merged by interleave refinement: starting from any interleave of the shards' rows, each step takes
   the shards' next symbols in the present order and deals them, stably, by symbol, until the interleave is that of all rows, which have never been
   sorted together. The common prefixes of neighbours are carried along, and the intervals of rows that share their last 200 symbols are the repeats.

Positions, never bytes of all documents, are shuffled in steps 1 and 2. Texts are identified by a 128-bit hash, so copies share their results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, byte_list, prune_by_ids, tidy

LENGTH = 200
KGRAM = 64
SEGMENT = 1 << 20  # bytes handled at once; place numbers inside take less than 24 bits
CHUNK = 30_000  # tiles refined together, unless one anchor has more
SHARD = 4096  # tiles of a shard, whose transform is merged with those of the others
#: Anchors with more differing tiles than this are resolved string by string, in as many tasks as there are strings.
CROWD = 20_000
PAD = 256  # the symbol outside a tile; no byte equals it
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_R = np.random.default_rng(23).integers(0, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _powers(which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2 ** 64."""
    n = SEGMENT + LENGTH + 1
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, dtype=np.uint64))]) for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _prefix_sums(data: np.ndarray, which: int) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_R[which][data] * _powers(which)[0][: len(data)])])


def _hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """Hash of the bytes from lo to hi, the same wherever they stand."""
    return _mixed((sums[hi] - sums[lo]) * _powers(which)[1][lo])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n, step = len(x) - width + 1, 1
    while 2 * step <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:n], x[width - step : width - step + n])


def tiles(text: bytes) -> tuple[np.ndarray, ...]:
    """anchor, content hashes t1 and t2, start, n (strings that start there), left (bytes before the anchor) of each tile."""
    found = []
    for base in range(0, max(0, len(text) - LENGTH + 1), SEGMENT):
        data = np.frombuffer(text, dtype=np.uint8)[base : base + SEGMENT + LENGTH - 1]
        sums = _prefix_sums(data, 0)
        at = np.arange(len(data) - KGRAM + 1)
        grams = _hash(sums, at, at + KGRAM, 0)
        place = _sliding_min((grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64), LENGTH - KGRAM + 1) & np.uint64(0xFFFFFF)
        start = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        end = np.concatenate([start[1:], [len(place)]])
        p = place[start].astype(np.int64)
        content = [_hash(s, start, end - 1 + LENGTH, i) for i, s in enumerate((sums, _prefix_sums(data, 1)))]
        extra = ((end - start).astype(np.uint64) << np.uint64(16)) + (p - start).astype(np.uint64)
        found.append((grams[p], content[0] ^ extra, content[1], start + base, end - start, p - start))
    if not found:
        return (np.empty(0, dtype=np.uint64),) * 3 + (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positional Burrows-Wheeler transform of a shard of aligned rows (symbols: a row of symbols each).

    Before each column the rows stand in the order of their reversed prefixes; its symbols in that order are the column of the transform. Also the orders
    after each column from LENGTH - 1 on.
    """
    m, width = symbols.shape
    order, out, orders = np.arange(m, dtype=np.int32), np.empty((width, m), dtype=np.uint16), np.empty((width - LENGTH + 1, m), dtype=np.int32)
    symbols = np.ascontiguousarray(symbols.T)
    for c in range(width):
        out[c] = symbols[c][order]
        order = order[np.argsort(out[c], kind="stable")]  # radix: rows go to their symbol's bucket in the order they come
        if c >= LENGTH - 1:
            orders[c - LENGTH + 1] = order
    return out, orders


def repeated(rows: list[bytes], left: np.ndarray, n: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """For tiles aligned at their anchors, which of the strings from each column repeat: rows by first columns.

    Row r's first byte stands left[r] before its anchor and n[r] strings start in it, one in each of its first columns. Column c is LENGTH - KGRAM - c before the anchor.

    The transforms of the shards are merged by refining their interleave, which starts as the shards one after the other: each step reads the
    shards' next symbols in the present interleave and deals them, stably, by symbol. After a step for each column the interleave is that of the
    transform of all rows. Common lengths with the row before are carried along.
    """
    most, width, m = LENGTH - KGRAM, 2 * LENGTH - KGRAM, len(rows)
    shards = []
    for lo in range(0, m, shard):
        symbols = np.full((min(shard, m - lo), width), PAD, dtype=np.uint16)
        for r, (text, a) in enumerate(zip(rows[lo : lo + shard], left[lo : lo + shard].tolist(), strict=True)):
            symbols[r, most - a : most - a + len(text)] = np.frombuffer(text, dtype=np.uint8)
        shards.append(transform(symbols))
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), [s[0].shape[1] for s in shards])  # the interleave: whose row stands where
    places = np.arange(m)  # of the shards' rows in it, shard by shard, each shard's in its own order
    since = np.zeros(m, dtype=np.int32)  # first column from which a row agrees with the one before it
    since[0] = 1
    out = np.zeros((m, most + 1), dtype=bool)
    symbol, row = np.empty(m, dtype=np.uint16), np.empty(m, dtype=np.int64)
    for c in range(width):
        symbol[places] = np.concatenate([s[0][c] for s in shards])
        deal = np.argsort(symbol, kind="stable")
        dealt, source = symbol[deal], source[deal]
        same = np.empty(m, dtype=bool)
        same[0] = False
        np.equal(dealt[1:], dealt[:-1], out=same[1:])
        fresh = np.full(m, c + 1, dtype=np.int32)
        j = np.flatnonzero(same)
        if len(j):  # rows now next to each other agree since the latest break that lay between them
            bounds = np.empty(2 * len(j), dtype=np.int64)
            bounds[0::2], bounds[1::2] = deal[j - 1] + 1, deal[j] + 1
            padded = np.append(since, np.int32(0))
            fresh[j] = np.maximum.reduceat(padded, bounds)[0::2]
        since, places = fresh, np.argsort(source, kind="stable")
        if c >= LENGTH - 1:
            alike = since <= c + 1 - LENGTH
            alike[:-1] |= alike[1:]
            row[places] = np.concatenate([s[1][c + 1 - LENGTH] + i * shard for i, s in enumerate(shards)])
            out[row[alike], c + 1 - LENGTH] = True
    column = np.arange(most + 1)
    first = (most - left)[:, None]
    return out & (column >= first) & (column < first + n[:, None])


def folded(found: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, list[int], list[int]]:
    """Of a text's tiles: one of each, which of these come again in the text, and the runs (starts, strings) of all that do."""
    anchor, t1, t2, start, n = found[:5]
    if len(np.unique(t1)) == len(t1):
        return np.arange(len(t1)), np.zeros(len(t1), dtype=bool), [], []
    order = np.lexsort((start, t2, t1, anchor))
    fresh = np.flatnonzero(np.concatenate([[True], *[np.any([x[order][1:] != x[order][:-1] for x in (anchor, t1, t2)], axis=0)]]))
    times = np.diff(np.append(fresh, len(order)))
    many = np.sort(order[np.repeat(times > 1, times)])
    cut = np.concatenate([[True], start[many][1:] != start[many][:-1] + n[many][:-1]])
    lo = np.flatnonzero(cut)
    return order[fresh], times > 1, start[many][lo].tolist(), np.add.reduceat(n[many], lo).tolist()


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), (edge[1::2] - edge[0::2]).tolist(), strict=True))


def _key(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _tile_table(docs: DataFrame) -> DataFrame:
    """The tiles of each text, one of each content; again marks those that come again in their text, whose runs are in the text's first such row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                texts = byte_list(whole.column("text").slice(lo, 256))
                found = [tiles(t) for t in texts]
                kept = [folded(f) for f in found]
                owner = np.repeat(np.arange(len(texts)), [len(k[0]) for k in kept])
                columns = [np.concatenate([x[k[0]] for x, k in zip(some, kept, strict=True)]) for some in zip(*found, strict=True)]
                again, runs = np.concatenate([k[1] for k in kept]), [[None] * len(owner), [None] * len(owner)]
                at = 0
                for rows, twice, *some in kept:
                    if some[0]:
                        for r, x in zip(runs, some, strict=True):
                            r[at + int(np.argmax(twice))] = x
                    at += len(rows)
                keys = pa.array([_key(t) for t in texts], type=pa.binary()).take(pa.array(owner))
                lists = [pa.array(r, type=pa.list_(pa.int32())) for r in runs]
                yield pa.RecordBatch.from_arrays([keys, *(_longs(x) for x in columns[:3]), *(pa.array(x.astype(np.int32)) for x in columns[3:]), pa.array(again), *lists], names=["key", "anchor", "t1", "t2", "start", "n", "left", "again", "starts", "counts"])

    return docs.select("text").mapInArrow(tidy(run), "key binary, anchor long, t1 long, t2 long, start int, n int, left int, again boolean, starts array<int>, counts array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, and the text's key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = byte_list(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_key(t) for t in texts], type=pa.binary()), pa.array(texts, type=pa.binary())], names=["doc_id", "key", "body"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {dict(docs.dtypes)['doc_id']}, key binary, body binary")


def _content(texts: DataFrame) -> DataFrame:
    """The bytes of listed tiles: texts has key, body and wanted (anchor, start, n, left, open, crowd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "start", "n", "left", "open", "crowd"]
        for whole in batches:
            for lo in range(0, whole.num_rows, 64):
                b = whole.slice(lo, 64)
                out: dict[str, list] = {k: [] for k in ["key", *names, "bytes"]}
                for key, body, wanted in zip(b.column("key").to_pylist(), b.column("body").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                    for w in wanted:
                        for k in names:
                            out[k].append(w[k])
                        out["key"].append(key)
                        out["bytes"].append(body[w["start"] : w["start"] + w["n"] - 1 + LENGTH])
                kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    return texts.select("key", "body", "wanted").mapInArrow(tidy(run), "key binary, anchor long, start int, n int, left int, open boolean, crowd boolean, bytes binary")


def _refined(rows: DataFrame) -> DataFrame:
    """key, start, n: runs of repeated strings in open tiles; rows come with all tiles of an anchor together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def resolve(some: list[dict]) -> pa.RecordBatch:
            left, n = (np.array([r[k] for r in some], dtype=np.int64) for k in ("left", "n"))
            flags = repeated([r["bytes"] for r in some], left, n)
            keys, starts, counts = [], [], []
            for r, row in zip(some, flags, strict=True):
                if r["open"] and row.any():
                    for at, k in _runs(row):
                        keys.append(r["key"])
                        starts.append(r["start"] + at - (LENGTH - KGRAM - r["left"]))
                        counts.append(k)
            return pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), pa.array(starts, type=pa.int32()), pa.array(counts, type=pa.int32())], names=["key", "start", "n"])

        for b in batches:
            for r in b.to_pylist():
                if len(held) >= CHUNK and r["anchor"] != held[-1]["anchor"]:
                    yield resolve(held)
                    held = []
                held.append(r)
        if held:
            yield resolve(held)

    ordered = rows.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.select("key", "anchor", "start", "n", "left", "open", "bytes").mapInArrow(tidy(run), "key binary, start int, n int")


def _strings(rows: DataFrame) -> DataFrame:
    """key, at, open and hashes of each string of the tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                data, at = np.frombuffer(r["bytes"], dtype=np.uint8), np.arange(r["n"])
                h = [_hash(_prefix_sums(data, i), at, at + LENGTH, i) for i in (0, 1)]
                k = len(at)
                yield pa.RecordBatch.from_arrays([pa.array([r["key"]] * k, type=pa.binary()), pa.array((at + r["start"]).astype(np.int32)), pa.array([r["open"]] * k), _longs(h[0]), _longs(h[1])], names=["key", "start", "open", "h1", "h2"])

    return rows.mapInArrow(tidy(run), "key binary, start int, open boolean, h1 long, h2 long")


def remove_runs(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without every byte of the strings that start in runs (start, n), and the number of maximal removed runs."""
    kept, spans, at = [], 0, 0
    last = -1
    for start, n in sorted(runs):
        end = start + n - 1 + LENGTH
        if start > last:
            spans += 1
            kept.append(text[at:start])
        last = max(last, end)
        at = last
    kept.append(text[at:])
    return b"".join(kept), spans


def substring_dedup(docs: DataFrame, scratch: Scratch, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs; with_text adds the bytes kept.

    docs needs doc_id and text; other columns are ignored. A text is its UTF-8 bytes; null is empty. Matches never cross documents but
    may lie in one; strings are judged on the input. Texts of fewer than LENGTH bytes keep all. Repeated rows are documents of
    their own, so each is removed but for what is shorter than LENGTH. A null doc_id is kept as it is. An empty table gives no rows.
    """
    table = scratch.save(_tile_table(docs), "tiles")
    anchors = table.groupBy("anchor").agg(F.count("*").alias("c"), F.bool_or("again").alias("again")).filter("c > 1 or again").select("anchor")
    anchors = scratch.save(anchors, "anchors")
    shared = scratch.save(prune_by_ids(table, anchors, "anchor").join(anchors, "anchor"), "shared")
    runs = table.filter("starts is not null").select("key", F.explode(F.arrays_zip("starts", "counts")).alias("x")).select("key", F.col("x.starts").alias("start"), F.col("x.counts").alias("n"))
    runs = scratch.save(runs, "own-runs")
    scratch.drop(table)
    shared = shared.drop("starts", "counts")
    classes = scratch.save(shared.groupBy("anchor", "t1", "t2").agg(F.sum(F.when(F.col("again"), 2).otherwise(1)).alias("c")), "classes")
    where = shared.join(classes, ["anchor", "t1", "t2"]).select("key", "anchor", "t1", "t2", "start", "n", "left", "again", "c")
    where = scratch.save(where, "where")
    scratch.drop(shared)
    sure = where.filter("c > 1 and not again").select("key", "start", "n").union(runs).distinct()
    mixed = classes.groupBy("anchor").agg(F.count("*").alias("k"), F.min("c").alias("least")).filter("k > 1 and least = 1").select("anchor", (F.col("k") > CROWD).alias("crowd"))
    mixed = scratch.save(mixed, "mixed")
    open_ = where.filter("c = 1").select("key", "anchor", "start", "n", "left", F.lit(True).alias("open"))
    one = F.min(F.struct("key", "start", "n", "left")).alias("x")
    witness = prune_by_ids(where.filter("c > 1"), mixed.select("anchor"), "anchor").groupBy("anchor", "t1", "t2").agg(one).select("x.key", "anchor", "x.start", "x.n", "x.left", F.lit(False).alias("open"))
    wanted = open_.union(witness).join(mixed, "anchor")
    wanted = scratch.save(wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "start", "n", "left", "open", "crowd")).alias("wanted")), "wanted")  # the tiles of one text
    texts = prune_by_ids(_keyed(docs), wanted.select("key"), "key").groupBy("key").agg(F.min("body").alias("body"))
    content = scratch.save(_content(texts.join(wanted, "key")), "content")
    refined = scratch.save(_refined(content.filter("not crowd")), "refined")
    strings = scratch.save(_strings(content.filter("crowd").select("key", "start", "n", "open", "bytes")), "strings")
    common = scratch.save(strings.groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2"), "common")
    crowded = strings.filter("open").join(common, ["h1", "h2"]).select("key", "start", F.lit(1).alias("n"))
    scratch.drop(content)
    runs = sure.union(refined).union(crowded).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))  # the runs of one text
    runs = scratch.save(runs, "runs")
    kind = dict(docs.dtypes)["doc_id"]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                done = [(len(t), *remove_runs(t, [(r["start"], r["n"]) for r in found or []])) for t, found in zip(b.column("body").to_pylist(), b.column("runs").to_pylist(), strict=True)]
                columns = [b.column("doc_id"), pa.array([d[0] for d in done], type=pa.int64()), pa.array([d[0] - len(d[1]) for d in done], type=pa.int64()), pa.array([d[2] for d in done], type=pa.int64()), pa.array([hashlib.sha256(d[1]).hexdigest() for d in done], type=pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array([d[1] for d in done], type=pa.binary())] if with_text else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])

    out = _keyed(docs).join(runs, "key", "left").select("doc_id", "body", "runs")
    return out.mapInArrow(tidy(finish), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
