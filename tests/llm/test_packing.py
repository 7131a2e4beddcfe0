import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowlens.llm.packing import Packer, WordTokenizer, pack_documents, step_groups

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
WHOLE = tokenizers.Tokenizer.from_file(PATH)
WORDS = WordTokenizer(PATH)


@given(st.lists(st.integers(1, 5000), max_size=60))
def test_packer_places_each_token_once_without_padding(sizes):
    packer, sequences = Packer(), []
    for i, n in enumerate(sizes):
        sequences += packer.add(i, n)
        if i % 10 == 9:
            sequences += packer.pack()
    sequences += [*packer.pack(), *packer.close()]
    seen = defaultdict(list)
    for s in sequences:
        n = sum(p[2] for p in s)
        assert n <= 2048 and n & (n - 1) == 0
        for doc, start, length in s:
            seen[doc].append((start, length))
    for i, n in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at and length > 0
            at += length
        assert at == n


def test_step_groups_are_balanced():
    lengths = [2048] * 200 + [256] * 300
    groups = step_groups(lengths)
    load = defaultdict(int)
    for n, g in zip(lengths, groups, strict=True):
        load[g] += n
    assert max(load.values()) - min(load.values()) <= 2048


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB é.,%\u0958\n\t\r  　'sßİΣ%$1<|endoftext|>日\U0001f600́")), min_size=1, max_size=8))
def test_words_give_the_ids_of_whole_texts(texts):
    assert [np.frombuffer(g, "<u4").tolist() for g in WORDS(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


LETTERS = "".join(chr(c) for r in ((0x41, 0x5B), (0x61, 0x7B), (0x20, 0x21), (0x0A, 0x0B), (0x300, 0x370), (0xC0, 0x250), (0x1E00, 0x1F00), (0x1F00, 0x2000)) for c in range(*r))


@settings(max_examples=600, deadline=None)
@given(st.lists(st.text(st.sampled_from(LETTERS) | st.characters(codec="utf-8"), max_size=30), min_size=1, max_size=8))
def test_marks_that_compose(texts):
    assert [np.frombuffer(g, "<u4").tolist() for g in WORDS(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_capital_with_every_mark():
    texts = [f"x {chr(c)}{m}{chr(k)} y" for c in range(0x41, 0x5B) for k in range(0x300, 0x370) for m in ("", "\u0323", "a")]
    texts += ["W\u030a", "Y\u030a", "H\u0331", "T\u0308", "J\u030c"]
    assert [np.frombuffer(g, "<u4").tolist() for g in WORDS(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_tokens_in_texts():
    texts = ["a<|endoftext|>b", "<|ENDOFTEXT|> x", "<|startoftext|>", "a <|endoftext|> <| endoftext |>"]
    assert [np.frombuffer(g, "<u4").tolist() for g in WORDS(texts)] == [WHOLE.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_id_once(hard_docs, hard_rows):
    rows = pack_documents(hard_docs, PATH, with_ids=True).collect()
    whole = WHOLE
    want = sorted([*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t, *_ in hard_rows if _ is not None)
    by_sequence = defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    tokens = sum(r["length"] for r in rows)
    assert tokens == sum(len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in hard_rows)
    alone = {r[0] for r in hard_rows if r[0] is not None and [x[0] for x in hard_rows].count(r[0]) == 1}
    docs = defaultdict(dict)
    for r in rows:
        docs[r["doc_id"]][r["start"]] = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
    got = [sum((p for _, p in sorted(docs[d].items())), []) for d in alone]
    assert sorted(got) == sorted([*whole.encode(t or "", add_special_tokens=False).ids, 1] for d, t, *_ in hard_rows if d in alone) and want


def test_empty(no_docs):
    assert pack_documents(no_docs, PATH).count() == 0
