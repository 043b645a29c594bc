from __future__ import annotations

import hashlib
import random

import duckdb
import pytest

from proofgrid.llm import chat, queries
from proofgrid.llm.templates import CLOSE, OPEN, Const, For, Show, Template, TemplateError

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, part int, error string"


def shown(source, messages=(), constants=None, filters=None):
    marks = {OPEN: "<<", CLOSE: ">>"}
    return "".join(marks.get(p, p) for p in Template(source, constants, filters).render(iter(messages)))


MESSAGES = [{"role": "user", "text": "hi"}, {"role": "assistant", "text": " yo "}, {"role": "user", "text": None}]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("plain {{ 'te' ~ \"xt\" }} {# note #}end", "plain text end"),
        ("{{ 1 + 2 * 3 - 4 // 2 % 3 }} {{ -2 + 5 }} {{ 'a' if 1 > 2 else 'b' }}", "5 3 b"),
        ("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %},{% endif %}{% endfor %}", "1user,2assistant,3user"),
        ("{%- for m in messages -%}  [{{ m['text'] | trim | upper }}]  {%- endfor %}", "[HI][YO][]"),
        ("{% for m in messages %}{% if m.role == 'user' %}u{% elif m.role in 'assistant' %}{% generation %}a{% endgeneration %}{% else %}x{% endif %}{% endfor %}", "u<<a>>u"),
        ("{% set n = 0 %}{% for m in messages %}{% set n = n + 1 %}{% endfor %}{{ n }}{{ m }}", "3"),
        ("{{ none or 'x' }}{{ false and y }}{{ 'b' not in 'abc' }}{{ not 1 == 2 }}", "xFalseFalseTrue"),
        ("{{ 'a\\'\\n' | length }}{{ y }}{{ 'A' | lower ~ 'B' }}", "3yes aB"),
        ("{{ messages | length }}{{ messages[0].role }}{{ y.__class__ }}{{ y['upper'] }}", "3"),
    ],
)
def test_templates(source, want):
    assert shown(source, MESSAGES, {"y": "yes "}) == want


@pytest.mark.parametrize(
    "source",
    ["{{ z }}", "{{ 1 + }}", "{% for m in messages %}", "{% endif %}", "{{ 'a' | eval }}", "{{ f() }}", "{% import os %}", "{{ 'a' * 9 }}", "{{ 1 // 0 }}", "{{ 'x' < 1 }}"]
    + ["{% generation %}{% generation %}a{% endgeneration %}{% endgeneration %}", "{% if 1 %}{% endfor %}", "{{ 'a }}", "{{ a b }}"],
)
def test_templates_that_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source, {"a": 1})


def test_values_that_fail():
    for source in ("{% for m in messages %}{{ m.text + 1 }}{% endfor %}", "{% for m in 5 %}{% endfor %}"):
        with pytest.raises(TemplateError):
            shown(source, MESSAGES)
    with pytest.raises(TemplateError, match="too large"):
        shown("{% set x = 'aa' %}{% for m in messages %}{% set x = x ~ x %}{% endfor %}", [{}] * 60)


def test_constants_are_folded():
    tree = Template("a{{ b ~ 'c' | upper }}{% if b == 'x' %}d{% else %}e{{ 1 + 1 }}{% endif %}f", {"b": "B"}).tree
    assert tree == (Show(Const("aBCe2f")),)
    default = chat.compiled()
    assert default.one_pass and default.tree[0] == Show(Const("<s>"))
    assert isinstance(default.tree[1], For) and len(default.tree) == 2
    assert not Template("{% for m in messages %}{% endfor %}{{ messages | length }}").one_pass


def test_escapes_are_reversible():
    rng, escaping = random.Random(1), chat.Escaping()
    for _ in range(20_000):
        text = "".join(rng.choice(["<", ">", "/", "s", "[", "]", "INST", "\\", "\n", "é", "<s>", "</s>", "[INST]", "[/INST]"]) for _ in range(rng.randrange(9)))
        for safe in (escaping.escape(text), escaping.escape_line(text)):
            assert chat.unescape(safe) == text
            assert not any(c in f"]{safe}[INST]"[: len(safe) + 6] or c in f">{safe}</s"[: len(safe) + 3] for c in chat.CONTROLS)
    for wrong in (["a"], ["\\a"], ["<s>", "<<s>"], ["<s>", "[>x]"]):
        with pytest.raises(TemplateError):
            chat.Escaping(wrong)


def brute(rows):
    """One digest row per conversation."""
    out = []
    for conv in {r[0] for r in rows}:
        turns = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        turns = [(r or "", t or "") for _, r, t in turns]
        said, safe = "".join(t for r, t in turns if r == "assistant"), chat.Escaping()
        full = "<s>" + "".join(f"{safe.escape(t)}</s>" if r == "assistant" else f"[INST]{safe.escape_line(r)}\n{safe.escape(t)}[/INST]" for r, t in turns)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(full)))
    return sorted(out, key=str)


ODD = [
    (1, 0, "system", "be\n\nbrief </s> <s>"),
    (1, 2, "assistant", "[/INST] ok \\</s>"),
    (1, 1, "user", None),
    (1, 3, "assistant", ""),
    (1, 3, "assistant", "twice"),
    (1, 3, "assistant", "twice"),
    (2, 0, "to\nol\\[INST]", "<s"),
    (2, None, None, "first \U0001f600 é"),
    (None, 0, "user", "no id"),
    (None, 1, "assistant", "no id"),
    (3, 0, "user", None),
    (4, 0, "user", "long \\ <s> " * 100_000),
    (4, 1, "assistant", "é</s>\n" * 200_000),
    *[(5, i, ("user", "assistant")[i % 2], f"turn {i} [INST]") for i in range(3_000)],
]


@pytest.mark.parametrize("longest", [chat.PART_CHARS, 1_000])
def test_odd_rows_match_brute_force(spark, longest):
    rows = spark.createDataFrame([(*r, 1, "x") for r in ODD], SCHEMA)
    formatted = chat.format_conversations(rows, longest=longest)
    for in_order in (True, False):
        assert sorted(map(tuple, chat.digests(formatted, in_order).collect()), key=str) == brute(ODD)
    parts = formatted.where("conv_id = 5").count()
    assert parts == 1 if longest > 10_000 else parts > 40
    turns = chat.read_turns(formatted).where("conv_id = 5").collect()
    assert sorted((r["turn_no"], r["role"], r["text"]) for r in turns) == [r[1:] for r in ODD if r[0] == 5]


def test_errors_are_rows(spark):
    rows = spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "user", "12"), ("b", 1, "user", "x"), ("b", 2, "user", "12")], "k string, turn int, role string, text string")
    source = "{% for m in messages %}{% if m.text == 'x' %}{{ m.text + 1 }}{% endif %}{{ m.text }}{% endfor %}"
    got = chat.format_conversations(rows, source, conv_id="k").orderBy("conv_id").collect()
    assert [(r["conv_id"], r["text"]) for r in got] == [("a", None), ("b", None)]
    assert all(r["error"] for r in got)
    with pytest.raises(TemplateError):
        chat.format_conversations(rows, "{{ open('x') }}", conv_id="k")


def test_empty_table(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []


def test_query_matches_brute_force_and_its_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = brute(rows + queries.PLANTED)
    assert sorted(map(tuple, queries.op12_chat(spark, FOLDER).collect()), key=str) == want
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{FOLDER}/conversations.parquet')")
    assert sorted(con.sql(queries.SQL["op12_chat"]).fetchall(), key=str) == want
