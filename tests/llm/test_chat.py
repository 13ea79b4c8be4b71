"""Chat formatting: the template language, exact round trips, odd rows."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import chat
from tessera.llm.chat_template import Const, For, Guard, If, Op, Out, Template, TemplateError, Text

PIECES = st.sampled_from([*chat.CONTROL, "[", "<", "<<", "/", "\\", "INST]", "SYS>>", "s>", " ", "\n", "é", "汉", "\U0001f600", "", "[\\INST]", "<\\\\/s>", "ok", " [/INST"])
TEXTS = st.lists(PIECES, max_size=12).map("".join)
ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "</role>", "role>"])


def digest(s):
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=8))
def test_round_trip(turns):
    template = Template(chat.TEMPLATE, chat.CONTROL)
    text, spans = template.render({"role": r, "text": t} for r, t in turns)
    assert list(chat.turns_of(text)) == turns
    assert "".join(template.guard.bare(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_guard_is_reversible(text):
    guard = Guard(chat.CONTROL)
    safe = guard.guard(text)
    assert guard.bare(safe) == text
    assert not any(c in safe for c in chat.CONTROL)
    if not guard._given.search(text):
        assert safe == text


def said(source, messages=(), **given):
    return Template(source, variables=given).render(messages, **given)[0]


def test_expressions():
    assert said("{{ 'a' ~ 1 ~ true ~ none }}|{{ 1 + 2 }}|{{ 'x' + 'y' }}") == "a1true|3|xy"
    assert said("{{ 'yes' if not (1 > 2) and 'b' in 'abc' else 'no' }}") == "yes"
    assert said("{{ 1 == 1 }} {{ 1 != '1' }} {{ 1 <= 1 }} {{ 'a' >= 'b' }} {{ not not 1 }} {{ 'd' not in 'abc' }}") == "true true true false true true"
    assert said("{{ ' A ' | trim | lower }}{{ none | default('d') | upper }}{{ x is defined }}{{ x is not defined }}", x=None) == "aDfalsetrue"
    assert said("{{ 'it\\'s' }} {{ \"{\" }}\n{#- gone -#}\n  z") == "it's {z"
    assert said("{{ 0 or 'b' }}{{ 1 and 'c' }}") == "bc"


def test_loops_and_marks():
    two = [{"role": "user", "text": "q", "n": 3}, {"role": "assistant", "text": "a"}]
    assert said("{% for m in messages %}{{ loop.index }}{{ loop.index0 }}{{ loop.first }}{{ loop.last }}{{ m['role'] }}{{ m.n }};{% endfor %}", two) == "10truefalseuser3;21falsetrueassistant;"
    t = Template("{{ bos }}{% for m in messages %}{% if m.role == 'assistant' %}{% generation %}{{ m.text }}{{ '!' }}{% endgeneration %}{% elif m.role == 'user' %}<{{ m.text }}>{% else %}?{% endif %}{% endfor %}", variables=["bos"])
    assert t.render([*two, {"role": "x"}, two[1]], bos="^") == ("^<q>a!?a!", [(4, 6), (7, 9)])
    assert t.render([], bos="^") == ("^", [])


def test_folding():
    """Constant parts leave no trace in the tree."""
    assert Template("a{{ 'b' ~ 1 }}{% if 1 > 2 %}c{% elif true %}d{% else %}e{% endif %}f").tree == (Text("ab1df"),)
    assert Template("{% for m in messages %}{% if 'a' in 'abc' %}{{ m.x }}{% endif %}{% if false and m.x %}y{% endif %}{% endfor %}").tree == (For("m", (Out(Op("get", (_name("m"), Const("x")))),)),)
    kept = Template("{% for m in messages %}{% if false %}a{% elif m.x %}b{% else %}c{% endif %}{% endfor %}").tree[0].body[0]
    assert isinstance(kept, If) and len(kept.branches) == 2
    Template("{% for m in messages %}{% if m.x %}{{ 1 + 'a' }}{% endif %}{% endfor %}").render([{"x": 0}])  # fails only where it is met


def _name(n):
    from tessera.llm.chat_template import Name

    return Name(n)


@pytest.mark.parametrize(
    "source",
    [
        "{{ x }}", "{{ messages.append }}" + "{{ y }}", "{{ 'a'.upper() }}", "{{ 1 + }}", "{% if 1 %}", "{% endif %}", "{% for m in other %}{% endfor %}", "{% set a = 1 %}", "{{ 'a' | nope }}",
        "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}",
        "{% for m in messages %}{{ m.__class__.__mro__ }}{{ m.a.b() }}{% endfor %}", "{{ " + "(" * 100 + "1" + ")" * 100 + " }}", "{% import os %}", "{{ 1 + 'a' }}", "{{ 'a' < 1 }}", "{% generation %}{% for m in messages %}{% endfor %}{% endgeneration %}", "{{ 'a' 'b' }}", "{{ 'a }}",
    ],
)
def test_sandbox(source):
    with pytest.raises(TemplateError):
        Template(source).render([{"role": "user", "text": "t"}])


def test_no_attributes():
    """A dotted name is a key of a message; Python's attributes are not there."""
    assert said("{% for m in messages %}{{ m.keys }}{{ m.__class__ }}{{ m['__len__'] }}{% endfor %}", [{"role": "u"}]) == ""
    with pytest.raises(TemplateError):
        said("{% for m in messages %}{{ m.role.upper }}{% endfor %}", [{"role": "u"}])
    with pytest.raises(TemplateError):
        Guard(["ab", "bc"])


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out.append((conv, len(turns), digest("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)), len(loss), digest(loss)))
    return sorted(out, key=repr)


def test_odd_rows(spark):
    """Null columns, repeated rows, ties, a hot conversation, long texts, clashing names."""
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "system", None), (None, 1, "user", chat.TRAP), (2, 1, None, "x"), (2, 1, "assistant", None), (3, 1, "assistant", ""), (4, 1, "tool</role>", "[INST]")]
    rows += [(5, i % 70, ["user", "assistant"][i % 2], f"{chat.TRAP}{i}") for i in range(300)] + [(6, 1, "assistant", chat.TRAP * 30_000)]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "Conv_ID long, turn long, role string, text string, spans int").repartition(5)
    parts = chat.format_conversations(turns, part_chars=1000)
    expected = brute(rows)
    for got in (chat.read_back(parts, as_made=True), chat.read_back(parts.repartition(3))):
        assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == expected
    assert parts.where("conv_id = 5").count() > 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0
    with pytest.raises(TemplateError):
        chat.format_conversations(empty, "{{ nothing }}")


def test_other_templates(spark):
    turns = spark.createDataFrame([("c", 1, "user", "hi"), ("c", 2, "assistant", "yo")], "conv_id string, turn int, role string, text string")
    (row,) = chat.format_conversations(turns, "{% for m in messages %}{{ m.role }}:{% generation %}{{ m.text }}{% endgeneration %}\n{% endfor %}", ()).collect()
    assert row.text == "user:hi\nassistant:yo\n" and [tuple(s) for s in row.spans] == [(5, 7), (18, 20)]
