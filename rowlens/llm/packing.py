"""Hierarchical multi-length packing of tokenised documents.

Documents are cut into whole windows of the longest tier; what is left of each goes to the smallest tier that holds it.
Each tier is packed from the longest down: a remainder opens a sequence and its gap is filled from the shorter tiers,
the last filler being cut to fit. Sequences close only when full, at a power of two, so none needs padding; what is left
at the end of a task is cut at powers of two. Work is a stream over each task's own rows with a bounded window: no
shuffle, and no state shared between tasks.
"""

from __future__ import annotations

import heapq
import os
import re
import unicodedata
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches, tidy

TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of a step group: about as many in each optimiser step, whatever the lengths of its sequences.
STEP_TOKENS = 64 * 2048
WINDOW_TOKENS = 1 << 20
CACHE_WORDS, CACHE_CHARS = 250_000, 48  # a worker keeps up to twice as many words, about 80 MB
MARKS = ".,!?%$#&*|;:"  # signs that never join what stands before them
COMPOSE = re.compile("[\u0300-\u036f]")  # all marks that compose with A to Z, or decompose to such, lie here
BETWEEN = "<|endoftext|>"
SIMPLE = "\u0250"  # letters before this are composed already and known to every version of the Unicode tables
#: The byte-level alphabet: bytes that print stand for themselves, the others for the characters from U+0100 on.
PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
ALPHABET = {b: 0x100 + n for n, b in enumerate(b for b in range(0x100) if b not in PRINTED)}
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


def _ends_in_letter(word: str) -> bool:
    """Whether a word ends in a letter or digit that normalising and lower-casing leave one letter or digit."""
    c = word[-1]
    return c.isalnum() and (c.isascii() or (len(c.lower()) == 1 and c.lower().isalnum() and unicodedata.is_normalized("NFC", c + c.lower())))


class WordTokenizer:
    """Ids of a text by a tokenizer that drops white space, word by word with a bounded cache.

    Valid for tokenizers whose normaliser and pre-tokeniser never let a token span a space or a newline, as the
    word-level BPE files do; the tests compare it with encoding whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.ends = None  # which ids end a word, if the vocabulary marks them
        self.model = self.tokenizer.model
        self.byte_level = b'"ByteLevel","add_prefix_space":false' in self.tokenizer.pre_tokenizer.__getstate__()
        if suffix := getattr(self.tokenizer.model, "end_of_word_suffix", None):
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words: lower-case words of simple letters by the model alone, since normalising and cutting leave them whole.
        Others many to a call: words of letters with spaces between, told apart by the tokens that end a word; the rest with a special
        token between; and one by one where neither tells them apart or a word may hold a special token."""
        out, alone, plain, other, ids, lengths, simple = {}, [], [], [], [], [], []
        tokenize, marked, quick = self.model.tokenize, self.ends is not None, self.ends is not None and self.byte_level
        for w in words:
            if marked and w.isalpha():
                if quick and (w.isascii() or max(w) < SIMPLE) and w.lower() == w:
                    tokens = tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(ALPHABET))
                    ids += [t.id for t in tokens]
                    lengths.append(4 * len(tokens))
                    simple.append(w)
                else:
                    plain.append(w)
            else:
                (alone if "<|" in w else other).append(w)
        packed, ends = np.asarray(ids, dtype="<u4").tobytes(), list(accumulate(lengths))
        out.update((w, packed[j - n : j]) for w, n, j in zip(simple, lengths, ends, strict=True))
        for some, between in ((plain, " "), (other, BETWEEN)):
            for lo in range(0, len(some), 512):
                part = some[lo : lo + 512]
                ids = np.asarray(self.tokenizer.encode_batch_fast([between.join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
                if between == " ":
                    starts = ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
                    starts, whole = [0, *starts[:-1].tolist()], len(ends) == len(part)
                else:
                    cuts = 4 * np.flatnonzero(ids == self.between)
                    starts, ends, whole = [0, *(cuts + 4).tolist()], np.append(cuts, 4 * len(ids)), len(cuts) + 1 == len(part)
                if whole:
                    packed = ids.tobytes()
                    out.update((w, packed[i:j]) for w, i, j in zip(part, starts, ends.tolist(), strict=True))
                else:
                    alone += part
        found = self.tokenizer.encode_batch_fast(alone, add_special_tokens=False) if alone else []
        return out | {w: np.asarray(e.ids, dtype="<u4").tobytes() for w, e in zip(alone, found, strict=True)}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        # The normaliser would lower A to Z too; special tokens are matched before it, so texts that may hold one stay.
        lower = lambda t: t.lower() if t.isascii() else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        parts = [(t if "<|" in t else lower(t)).replace("\n", " ").split(" ") for t in texts]
        if len(self.young) > CACHE_WORDS:  # words not met since the last turn are forgotten
            self.young, self.old = {"": b""}, self.young
        young, old, rare = self.young, self.old, {}
        known = [list(map(young.get, p)) for p in parts]
        absent = lambda: {w for p, k in zip(parts, known, strict=True) if None in k for w, ids in zip(p, k, strict=True) if ids is None}
        missing = absent()
        # Before it lowers letters it composes marks with them. Words with marks are never kept, so they are missing: their texts stay as they are.
        if marked := COMPOSE.search(" ".join(missing)):
            for i, (p, t) in enumerate(zip(parts, texts, strict=True)):
                if any(ids is None and COMPOSE.search(w) for w, ids in zip(p, known[i], strict=True)):
                    parts[i] = t.replace("\n", " ").split(" ")
                    known[i] = list(map(young.get, parts[i]))
            missing = absent()
        back = {w: old[w] for w in missing if w in old}
        young.update(back)
        missing.difference_update(back)
        # A word with marks after a letter or digit is cut there by the tokenizer too: its stem and its marks are looked up apart.
        joined, new = {}, set()
        for w in missing:
            if w[-1] in MARKS and (stem := w.rstrip(MARKS)) and _ends_in_letter(stem) and "<|" not in w:
                joined[w] = halves = (stem, w[len(stem) :])
                new.update(x for x in halves if x not in young)
            else:
                new.add(w)
        found = self.learn(list(new))
        for w, (stem, marks) in joined.items():  # kept from the second time on, when the stem is known
            (young if stem in young and len(w) <= CACHE_CHARS else rare)[w] = (found[stem] if stem in found else young[stem]) + (found[marks] if marks in found else young[marks])
        for w, ids in found.items():
            (young if len(w) <= CACHE_CHARS and not (marked and COMPOSE.search(w)) else rare)[w] = ids
        young.update(rare)
        out = [b"".join([young[w] if ids is None else ids for w, ids in zip(p, k, strict=True)] if None in k else k) for p, k in zip(parts, known, strict=True)]
        for w in rare:
            del young[w]
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer_at(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Packs a stream of (document index, token count) of one task; pieces are (document, start, length)."""

    def __init__(self, tiers=TIERS):
        self.tiers = sorted(tiers)
        self.waiting: list[list[tuple[int, int, int]]] = [[] for _ in self.tiers]  # by tier: (length, document, start), ascending

    def add(self, doc: int, n: int) -> list[list[tuple[int, int, int]]]:
        """Route a document; returns the sequences that it fills alone."""
        most, whole = self.tiers[-1], []
        for at in range(0, n - n % most, most):
            whole.append([(doc, at, most)])
        if n % most:
            self.wait(n % most, doc, n - n % most)
        return whole

    def wait(self, length: int, doc: int, start: int) -> None:
        tier = next(i for i, t in enumerate(self.tiers) if length <= t)
        insort(self.waiting[tier], (length, doc, start))

    def fill(self, room: int, below: int) -> list[tuple[int, int, int]] | None:
        """Pieces of exactly room tokens from tiers up to below, or None (and nothing taken) if they hold too few."""
        taken = []
        while room:
            for tier in range(below, -1, -1):
                if at := bisect_right(self.waiting[tier], (room, float("inf"), 0)):
                    length, doc, start = self.waiting[tier].pop(at - 1)
                    break
            else:  # none fits whole: cut the shortest that is left
                tier = next((i for i in range(below + 1) if self.waiting[i]), None)
                if tier is None:
                    for piece in taken:
                        self.wait(piece[2], piece[0], piece[1])
                    return None
                full, doc, start = self.waiting[tier].pop(0)
                length = room
                self.wait(full - room, doc, start + room)
            taken.append((doc, start, length))
            room -= length
        return taken

    def pack(self) -> Iterator[list[tuple[int, int, int]]]:
        """All sequences that can be filled to their tier; the rest waits for more documents."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.waiting[tier]:
                length, doc, start = self.waiting[tier].pop()
                rest = self.fill(self.tiers[tier] - length, tier)
                if rest is None:
                    self.wait(length, doc, start)
                    break
                yield [(doc, start, length), *rest]

    def close(self) -> Iterator[list[tuple[int, int, int]]]:
        """Everything that waits, end to end: full windows, then powers of two."""
        left = [p for tier in reversed(self.waiting) for p in reversed(tier)]
        self.waiting = [[] for _ in self.tiers]
        total = sum(p[0] for p in left)
        sizes = [self.tiers[-1]] * (total // self.tiers[-1]) + [1 << b for b in range(self.tiers[-1].bit_length() - 1, -1, -1) if total % self.tiers[-1] >> b & 1]
        at = iter(left)
        length, doc, start = next(at, (0, 0, 0))
        for size in sizes:
            out = []
            while size:
                n = min(size, length)
                out.append((doc, start, n))
                size, length, start = size - n, length - n, start + n
                if not length:
                    length, doc, start = next(at, (0, 0, 0))
            yield out


def step_groups(lengths: list[int], tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: longest first, each to the group with the fewest tokens so far."""
    heap = [(0, g) for g in range(max(1, round(sum(lengths) / tokens)))]
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        load, g = heap[0]
        heapq.heapreplace(heap, (load + lengths[i], g))
        out[i] = g
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, tiers=TIERS) -> DataFrame:
    """One row per piece of a packed sequence; with_ids adds the piece's ids (little-endian unsigned 32-bit) as binary.

    docs needs doc_id and text; other columns are ignored. A null text is empty, and an empty text is its end id alone.
    A null doc_id is kept as it is; repeated rows are packed once each. An empty table gives no rows. Each id of each
    document lies in exactly one piece; a sequence's pieces are gapless from offset 0; every sequence is exactly a power
    of two long, at most the longest tier. Results depend on how the scan splits its input, which a retried task repeats.
    """
    small_batches(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    schema = SCHEMA.format(id=id_type) + (", ids binary" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, base = tokenizer_at(tokenizer_path), Packer(tiers), TaskContext.get().partitionId() << 32
        held: dict[int, tuple] = {}  # document index: (id, ids)
        counters = {"doc": 0, "seq": 0, "group": 0, "tokens": 0}
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        out_schema = None

        def rows(sequences: list) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(9 + with_ids)]
            lengths = [sum(p[2] for p in s) for s in sequences]
            groups = step_groups(lengths)
            for s, total, g in zip(sequences, lengths, groups, strict=True):
                offset = 0
                for doc, start, n in s:
                    key, ids = held[doc]
                    part = ids[4 * start : 4 * (start + n)]
                    values = (key, start, n, zlib.crc32(part), len(ids) // 4, base + counters["seq"], offset, total, base + counters["group"] + g)
                    for c, v in zip(cols, (*values, part) if with_ids else values, strict=True):
                        c.append(v)
                    offset += n
                counters["seq"] += 1
            counters["group"] += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, out_schema.types, strict=True)], schema=out_schema)

        ready: list = []
        for batch in batches:
            if out_schema is None:
                longs = [pa.field(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")[1:]]
                out_schema = pa.schema([pa.field("doc_id", batch.schema.field("doc_id").type), *longs, *([pa.field("ids", pa.binary())] if with_ids else [])])
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(keys), 128):
                found = encode([t or "" for t in texts.slice(at, 128).to_pylist()])
                for key, ids in zip(keys[at : at + 128], found, strict=True):
                    doc, ids = counters["doc"], ids + end
                    held[doc] = (key, ids)
                    ready += packer.add(doc, len(ids) // 4)
                    counters["doc"] += 1
                    counters["tokens"] += len(ids) // 4
                if counters["tokens"] >= WINDOW_TOKENS:
                    ready += packer.pack()
                    yield rows(ready)
                    waits = {p[1] for tier in packer.waiting for p in tier}
                    held = {k: v for k, v in held.items() if k in waits}
                    ready, counters["tokens"] = [], 0
        ready += packer.pack()
        ready += packer.close()
        if ready:
            yield rows(ready)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)
