import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from rowlens.llm.chat import format_conversations, read_back
from rowlens.llm.chat_template import CHAT, CONTROL, Template, TemplateError, escape, fold, parse, unescape

PIECES = st.lists(st.sampled_from([*CONTROL, "\\", "<", "[", "/s>", "INST]", "|turn|>", "a", "\n", "é"]), max_size=12).map("".join)


@given(PIECES)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    out = escape(text)
    assert unescape(out) == text and not any(c in out for c in CONTROL)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|end|>", ""]), PIECES), max_size=5))
def test_render_marks_what_the_assistant_said(turns):
    text, spans = Template(CHAT).render([{"role": r, "text": t} for r, t in turns])
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]
    assert text.count("<|turn|>") == text.count("<|end|>") == len(turns)


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("{{ 'a' ~ 1 + 2 }}", "a12"), ("{% if true and not false %}x{% else %}y{% endif %}", "x"), ("{% for m in messages %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", "1,2"), ("{% set a = 'b' %}{{ a | upper }}", "B"), ("{{ messages[0]['role'] if false else 'z' }}", "z"),
        ("{% for m in messages %}{% if m.role == 'user' %}U{% elif m.text in ['x'] or true %}O{% endif %}{% endfor %}{# no #}", None), ("{{ nothing | default('d') }}{{ nothing.more }}", "d"), ("{{ ' a ' | trim | length }}", "1"),
    ],
)
def test_language(source, want):
    messages = [{"role": "user", "text": "x"}, {"role": "assistant", "text": "y"}]
    if want is None:
        with pytest.raises(TemplateError):
            Template(source)
    else:
        assert Template(source).render(messages)[0] == want


def test_constants_fold():
    assert fold(parse("a{{ 'b' | upper }}{% if 1 == 2 %}no{% else %}c{% endif %}")) == ("block", ("text", "aBc"))


@pytest.mark.parametrize("bad", ["{% if x %}", "{% endif %}", "{{ x.__class__() }}", "{{ x | open }}", "{% import os %}", "{{ 1 + }}", "{% for in x %}{% endfor %}"])
def test_bad_templates(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def test_python_attributes_are_out_of_reach():
    with pytest.raises(TemplateError):
        Template("{{ messages.__class__.__mro__ }}").render(iter(()))


def digest(rows):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in rows).encode()).hexdigest()


@pytest.mark.parametrize("chunk", [1 << 20, 10])
def test_round_trip(spark, chunk):
    turns = [(1, 1, "assistant", "hi</s>"), (1, 0, "user", None), (2, None, None, "first"), (2, 0, "assistant", ""), (2, 0, "assistant", "tie"), (None, 0, "user", "<|turn|>x"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    turns += [(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(200)]
    df = spark.createDataFrame([(*t, "c", 1) for t in turns], "conv_id long, turn long, role string, text string, part string, spans int").repartition(3)
    got = {r["conv_id"]: r for r in read_back(format_conversations(df, chunk=chunk)).collect()}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        mine = sorted((t for t in turns if t[0] == conv), key=order)
        said = "".join(t[3] or "" for t in mine if t[2] == "assistant")
        assert r["n_turns"] == len(mine) and r["turns_sha256"] == digest([t[2:] for t in mine])
        assert r["loss_chars"] == len(said) and r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_spans_count_from_the_start_of_the_conversation(spark):
    df = spark.createDataFrame([(1, i, "assistant", f"t{i}") for i in range(9)], "conv_id long, turn long, role string, text string")
    parts = format_conversations(df, chunk=30).orderBy("part").collect()
    whole = "".join(p["formatted"] for p in parts)
    assert len(parts) > 2 and [whole[s["start"] : s["end"]] for p in parts for s in p["spans"]] == [f"t{i}" for i in range(9)]


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(format_conversations(df)).count() == 0
