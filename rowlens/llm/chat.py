"""Chat formatting: conversations, stored by turn, rendered by a compiled template with their loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .chat_template import CHAT, Template, unescape
from .common import tidy

#: A row of output holds about so many code points at most beyond one turn; longer conversations go on in further rows.
CHUNK = 1 << 20
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def format_conversations(turns: DataFrame, template: str = CHAT, chunk: int = CHUNK) -> DataFrame:
    """conv_id, part, start, formatted, spans: the formatted text of each conversation, in rows of bounded size.

    part counts from 0, start is the part's first code point, and spans lists (start, end) of code points in the whole
    conversation that are under the loss mask. turns needs conv_id, turn, role and text. Null roles and texts are empty;
    a null turn comes first, ties go by role, then text; rows with a null conv_id are one conversation; repeated rows are
    turns of their own. An empty table gives no rows. Rows of a conversation meet in one task, sorted, and stream through it.
    """
    compiled = Template(template)
    key = dict(turns.dtypes)["conv_id"]
    schema = f"conv_id {key}, part int, start long, formatted string, spans array<struct<start: long, end: long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((r["conv_id"], {"role": r["role"] or "", "text": r["text"] or ""}) for b in batches for r in b.to_pylist())
        out_schema = pa.schema([("conv_id", pa.int64() if key in ("bigint",) else pa.string() if key == "string" else pa.int32()), ("part", pa.int32()), ("start", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        held, chars = [], 0
        for conv, messages in groupby(rows, key=lambda r: r[0]):
            text, spans, start, at, part = [], [], 0, 0, 0
            turns_seen = 0

            def counted(messages=messages):
                nonlocal turns_seen
                for _, m in messages:
                    turns_seen += 1
                    yield m

            before = 0
            for piece, masked in compiled.stream(counted()):
                if at - start >= chunk and not masked and piece.startswith("<|turn|>") and turns_seen != before:
                    held.append({"conv_id": conv, "part": part, "start": start, "formatted": "".join(text), "spans": spans})
                    yield pa.RecordBatch.from_pylist(held, schema=out_schema)
                    held, text, spans, start, part, before, chars = [], [], [], at, part + 1, turns_seen, 0
                if masked and piece:
                    spans.append({"start": at, "end": at + len(piece)})
                text.append(piece)
                at += len(piece)
            held.append({"conv_id": conv, "part": part, "start": start, "formatted": "".join(text), "spans": spans})
            chars += at - start
            if chars >= chunk or len(held) >= 1000:
                yield pa.RecordBatch.from_pylist(held, schema=out_schema)
                held, chars = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=out_schema)

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(tidy(run), schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation as read from the output of format_conversations (default template), in its row order."""
    key = dict(formatted.dtypes)["conv_id"]
    schema = f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_schema = None
        rows = (r for b in batches for r in b.to_pylist())
        done = []
        for conv, parts in groupby(rows, key=lambda r: r["conv_id"]):
            turns, turns_sha, loss, loss_sha, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            for p in parts:
                for m in _TURN.finditer(p["formatted"]):
                    turns_sha.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                    turns += 1
                for span in p["spans"]:
                    text = unescape(p["formatted"][span["start"] - p["start"] : span["end"] - p["start"]])
                    loss += len(text)
                    loss_sha.update(text.encode("utf-8", "surrogatepass"))
                chars += len(p["formatted"])
            done.append({"conv_id": conv, "n_turns": turns, "turns_sha256": turns_sha.hexdigest(), "loss_chars": loss, "loss_sha256": loss_sha.hexdigest(), "formatted_chars": chars})
            if len(done) >= 1000:
                out_schema = out_schema or _digest_schema(key)
                yield pa.RecordBatch.from_pylist(done, schema=out_schema)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=out_schema or _digest_schema(key))

    return formatted.mapInArrow(tidy(run), schema)


def _digest_schema(key: str) -> pa.Schema:
    kind = pa.int64() if key == "bigint" else pa.string() if key == "string" else pa.int32()
    return pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
