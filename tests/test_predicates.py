from __future__ import annotations

import base64
import json
import re

import pytest
from pyspark.sql import functions as F

from proofgrid.functions.conditions import ConditionError, condition, used_selections
from proofgrid.functions.fields import EventFields, discover_paths
from proofgrid.functions.literals import base64_alignments, dash_spellings, warn_escaped_star
from proofgrid.functions.predicates import FieldSpec, SelectionError, register_modifier, selection, selection_fields


def verdicts(spark, documents, bodies, project=False):
    """{(document number, selection number): bool} through VARIANT documents."""
    rows = [(i, json.dumps(d)) for i, d in enumerate(documents)]
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.parse_json("j").alias("doc"))
    fields = EventFields.of(df, "doc", discover_paths(df, "doc"), columns=[])
    df, fields = fields.project(df, [n for b in bodies for n in selection_fields(b)]) if project else (df, fields)
    out = df.select("i", *[selection(fields, b).alias(f"c{n}") for n, b in enumerate(bodies)]).collect()
    return {(r["i"], n): r[f"c{n}"] for r in out for n in range(len(bodies))}


# Each row: document, selection, expected.
CASES = [
    # text comparison, case-insensitive by default
    ({"Image": "C:\\Windows\\lsass.exe"}, {"Image|contains": "LSASS"}, True),
    ({"Image": "C:\\Windows\\cmd.exe"}, {"Image|contains": "lsass"}, False),
    ({"Image": "C:\\Windows\\lsass.exe"}, {"Image|startswith": "c:\\windows"}, True),
    ({"Image": "C:\\Windows\\lsass.exe"}, {"Image|startswith": "lsass"}, False),
    ({"Image": "C:\\Windows\\lsass.exe"}, {"Image|endswith": "\\lsass.exe"}, True),
    ({"Image": "C:\\Windows\\lsass.exe"}, {"Image|endswith": "lsass"}, False),
    ({"U": "Admin"}, {"U": "admin"}, True),
    ({"U": "Admin"}, {"U|cased": "admin"}, False),
    ({"U": "Admin"}, {"U|cased": "Admin"}, True),
    ({"U": True}, {"U": "true"}, True),
    ({"U": True}, {"U": 1}, False),
    # wildcards and escapes
    ({"I": "C:\\x\\lsass.exe"}, {"I": "*\\lsass.exe"}, True),
    ({"I": "C:\\x\\cmd.exe"}, {"I": "*\\lsass.exe"}, False),
    ({"I": "abcdef"}, {"I": "abc?ef"}, True),
    ({"I": "abcef"}, {"I": "abc?ef"}, False),
    ({"I": "literal*star"}, {"I": "literal\\*star"}, True),
    ({"I": "literalXstar"}, {"I": "literal\\*star"}, False),
    ({"I": "a.b+c"}, {"I": "a.b+?"}, True),
    ({"I": "axb+c"}, {"I": "a.b+?"}, False),
    ({"I": "C:\\Users\\*"}, {"I": "C:\\Users\\*"}, False),
    ({"I": "C:\\Users*"}, {"I": "C:\\Users\\*"}, True),
    ({"I": "pre foo post"}, {"I|contains": "*foo*"}, True),
    ({"I": "pre foo post"}, {"I|contains": "f*post"}, True),
    ({"I": "two\nlines"}, {"I": "two*lines"}, False),
    ({"I": "\\\\server\\share"}, {"I|startswith": "\\\\\\\\"}, True),
    ({"I": "\\server"}, {"I|startswith": "\\\\\\\\"}, False),
    ({"I": "a\\b"}, {"I|contains": "\\\\"}, True),
    # numbers
    ({"n": 6}, {"n|gt": 5}, True),
    ({"n": 5}, {"n|gt": 5}, False),
    ({"n": 5}, {"n|gte": 5}, True),
    ({"n": 4}, {"n|lt": 5}, True),
    ({"n": 5}, {"n|lte": 5}, True),
    ({"n": "0x10"}, {"n|gte": 16}, True),
    ({"n": "0xFFFFFFFFFFFFFFFFFFFF"}, {"n|gt": 1e20}, True),
    ({"n": "-0x10"}, {"n|lt": 0}, True),
    ({"n": "10"}, {"n": 10}, True),
    ({"n": "0xA"}, {"n": 10}, True),
    ({"n": "ten"}, {"n": 10}, False),
    ({"n": "5d"}, {"n|gt": 1}, False),
    ({"n": "1_000"}, {"n": 1000}, True),
    ({"n": "1__000"}, {"n": 1000}, False),
    ({"n": " 7 "}, {"n": 7}, True),
    ({"n": "nan"}, {"n|gt": 1}, False),
    ({"n": "inf"}, {"n|gt": 1}, True),
    ({"n": True}, {"n|gte": 0}, False),
    ({"n": "-"}, {"n|gt": 0}, False),
    # null, exists
    ({"a": 1}, {"b": None}, True),
    ({"a": None}, {"a": None}, True),
    ({"a": ""}, {"a": None}, True),
    ({"a": []}, {"a": None}, True),
    ({"a": 0}, {"a": None}, False),
    ({"a": None}, {"a|exists": True}, True),
    ({"b": None}, {"a|exists": True}, False),
    ({"b": None}, {"a|exists": False}, True),
    ({"b": 1}, {"a": [None, "x"]}, False),
    ({"a": None}, {"a|contains": ""}, False),
    # addresses
    ({"ip": "10.10.5.44"}, {"ip|cidr": "10.0.0.0/8"}, True),
    ({"ip": "192.168.1.1"}, {"ip|cidr": "10.0.0.0/8"}, False),
    ({"ip": "-"}, {"ip|cidr": "10.0.0.0/8"}, False),
    ({"ip": "010.0.0.1"}, {"ip|cidr": "10.0.0.0/8"}, False),
    ({"ip": "10.0.0.256"}, {"ip|cidr": "10.0.0.0/8"}, False),
    ({"ip": "10.9.9.9"}, {"ip|cidr": "10.1.2.3/8"}, True),
    ({"ip": "fe80::1"}, {"ip|cidr": "fe80::/10"}, True),
    ({"ip": "2001:db8::1"}, {"ip|cidr": "fe80::/10"}, False),
    ({"ip": "10.0.0.1"}, {"ip|cidr": ["fe80::/10", "10.0.0.0/8"]}, True),
    # lists, all
    ({"c": "a -enc b frombase"}, {"c|contains|all": ["-enc", "frombase"]}, True),
    ({"c": "a -enc b"}, {"c|contains|all": ["-enc", "frombase"]}, False),
    ({"c": "a -enc b"}, {"c|contains": ["-enc", "frombase"]}, True),
    ({"t": ["x", "y"]}, {"t": "Y"}, True),
    ({"t": ["x", "y"]}, {"t|all": ["x", "y"]}, True),
    ({"t": ["x", "z"]}, {"t|all": ["x", "y"]}, False),
    ({"t": [1, 9]}, {"t|gt": 5}, True),
    # transforms
    ({"c": "x /create y"}, {"c|contains|windash": "-create"}, True),
    ({"c": "x \u2014create y"}, {"c|contains|windash": " -create"}, True),
    ({"c": "x +create y"}, {"c|contains|windash": "-create"}, False),
    ({"c": base64.b64encode(b"zz whoami /all").decode()}, {"c|contains|base64offset": "whoami"}, True),
    ({"c": base64.b64encode(b"zzz whoami /all").decode()}, {"c|contains|base64offset": "whoami"}, True),
    ({"c": base64.b64encode(b"whoami").decode()}, {"c|base64": "whoami"}, True),
    # regular expressions
    ({"c": "curl http://x | sh"}, {"c|re": r"curl\s.+\|\s*(ba)?sh"}, True),
    ({"c": "CURL"}, {"c|re": "curl"}, True),
    ({"c": "a\u00a0b"}, {"c|re": r"a\sb"}, True),
    ({"c": "a\rb"}, {"c|re": "a.b"}, True),
    ({"c": "a\nb"}, {"c|re": "a.b"}, False),
    ({"c": "aa"}, {"c|re": r"(?P<one_x>a)(?P=one_x)"}, True),
    ({"c": "x["}, {"c|re": r"[[]"}, True),
    ({"c": "\u00c9t\u00e9"}, {"c|contains": "\u00e9T\u00c9"}, True),
    # nested documents
    ({"p": {"Cmd": "x"}}, {"p.cmd": "x"}, True),
    ({"P": {"Cmd": "x"}}, {"cmd": "x"}, True),
    ({"P": {"Cmd": "x"}, "Q": {"Cmd": "x"}}, {"cmd": "x"}, False),
    ({"P": {"Cmd": "x"}, "cmd": "y"}, {"Cmd": "y"}, True),
    ({"l": [{"k": "v"}]}, {"k": "v"}, True),
    ({"l": [{"k": "v"}, {"k": "v"}]}, {"k": "v"}, False),
    ({"r": None, "s": {"r2": 1}}, {"r2": 1}, True),
    ({"a b": "x"}, {"a b": "x"}, True),
    # combinations
    ({"a": "1", "b": "2"}, [{"a": "9"}, {"b": "2"}], True),
    ({"a": {"b": {"c": "needle here"}}}, ["NEEDLE"], True),
    ({"a": {"b": [1, {"c": "hay"}]}}, ["needle", "hay"], True),
    ({"a": {"b": [1, {"c": "hay"}]}}, "needle", False),
    ({"needle": "x"}, "needle", False),
]


def test_selection_table(spark):
    found = verdicts(spark, [c[0] for c in CASES], [c[1] for c in CASES])
    wrong = [c for i, c in enumerate(CASES) if found[(i, i)] is not c[2]]
    assert not wrong


def test_projected_fields_agree(spark):
    """Fields computed once give the same verdicts, and no verdict is NULL."""
    some = CASES[::3]
    found = verdicts(spark, [c[0] for c in some], [c[1] for c in some], project=True)
    assert found == verdicts(spark, [c[0] for c in some], [c[1] for c in some])
    assert None not in found.values()


@pytest.mark.parametrize(
    "body",
    [{}, [], {"a|nope": 1}, {"|contains": 1}, {"a|contains|endswith": 1}, {"a|re": "("}, {"a|re|cased": "x"},
     {"a|cidr": "x"}, {"a|gt": "x"}, [{"a": 1}, "word"]],
)
def test_bad_selections(spark, body):
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(SelectionError):
        selection(EventFields.of(df), body)


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, "Ab", [1, 2], None), (20, "xx", [], "z")], "n int, s string, l array<int>, m string")
    fields = EventFields.of(df)
    got = df.select(
        selection(fields, {"N|gt": 5}).alias("gt"),
        selection(fields, {"S|startswith": "a"}).alias("sw"),
        selection(fields, {"l": 2}).alias("any"),
        selection(fields, {"l": None}).alias("blank"),
        selection(fields, {"m|exists": True}).alias("there"),
        selection(fields, {"unknown": "x"}).alias("unknown"),
        selection(fields, "AB").alias("word"),
    ).collect()
    assert [tuple(r) for r in got] == [
        (False, True, True, False, False, False, True),
        (True, False, False, True, True, False, False),
    ]


def test_literals():
    assert len(set(base64_alignments("whoami"))) == 3
    assert len(dash_spellings("/x")) == 5 and dash_spellings("x") == ["x"]
    assert warn_escaped_star("C:\\Users\\*") and not warn_escaped_star("C:\\Users*")
    assert FieldSpec.parse("a | contains|ALL").modifiers == ("contains", "all")


def test_custom_modifier(spark):
    register_modifier("len", lambda spec, candidate: lambda item: F.length(item.text) == int(candidate))
    df = spark.createDataFrame([("abc",), ("ab",)], "a string")
    assert [r[0] for r in df.select(selection(EventFields.of(df), {"a|len": 3})).collect()] == [True, False]


NAMES = ["sel_a", "sel_b", "filter"]


@pytest.mark.parametrize(
    "text, check",
    [
        ("sel_a", lambda a, b, f: a),
        ("1 of sel*", lambda a, b, f: a or b),
        ("all of sel_*", lambda a, b, f: a and b),
        ("sel_*", lambda a, b, f: a and b),
        ("all of them", lambda a, b, f: a and b and f),
        ("1 of them and not filter", lambda a, b, f: (a or b or f) and not f),
        ("sel_a or sel_b and not filter", lambda a, b, f: a or (b and not f)),
        ("not (sel_a OR sel_b) And filter", lambda a, b, f: not (a or b) and f),
        (["sel_a and filter", "sel_b"], lambda a, b, f: (a and f) or b),
    ],
)
def test_conditions(spark, text, check):
    rows = [(bool(i & 1), bool(i & 2), bool(i & 4)) for i in range(8)]
    df = spark.createDataFrame(rows, "sel_a boolean, sel_b boolean, filter boolean")
    column = condition(text, {n: F.col(n) for n in NAMES})
    got = df.select(*NAMES, column.alias("x")).collect()
    assert all(r["x"] is bool(check(*r[:3])) for r in got)


@pytest.mark.parametrize(
    "text", ["", "nope", "2 of sel*", "sel_a | count() > 5", "sel_a sel_b", "1 of zzz*", "(sel_a", "sel_a and", "sel_a if sel_b else filter"]
)
def test_bad_conditions(spark, text):
    with pytest.raises(ConditionError):
        condition(text, {n: F.lit(True) for n in NAMES})


def test_used_selections():
    assert used_selections("1 of sel*", NAMES) == {"sel_a", "sel_b"}


def test_long_lists_find_what_single_needles_find(spark, monkeypatch):
    """Needle lists, keyword lists and pattern lists against one predicate per member; scalars, lists, nulls, odd letters."""
    import random

    from pyspark.sql import functions as F

    from proofgrid.functions.fields import EventFields
    from proofgrid.functions import predicates
    from proofgrid.functions.predicates import any_of, selection

    monkeypatch.setattr(predicates, "LIST_SIZE", 8)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abkKsiİſé.*") for _ in range(n))
    rows = [(i, word(12), [word(5), None, word(9)], "x" if i % 3 else None) for i in range(150)] + [(150, None, None, None), (151, "", [], "")]
    df = spark.createDataFrame(rows, "id int, text string, many array<string>, other string")
    fields = EventFields.of(df, columns=["text", "many", "other"])
    needles = [word(rng.choice((2, 3))).replace("*", "?" if i % 9 == 0 else "b") for i in range(14)]
    patterns = [rf"{n}[a-z]?" if i % 5 else rf"(?:{n}|b.k)+" for i, n in enumerate(w.replace("?", "") for w in needles)]
    for field in ("text", "many", "other"):
        for way, values in (("contains", needles), ("contains|cased", needles), ("re", patterns)):
            one = any_of([selection(fields, {f"{field}|{way}": v}) for v in values])
            got = df.select("id", selection(fields, {f"{field}|{way}": values}).alias("all"), one.alias("one")).collect()
            assert [r["all"] for r in got] == [r["one"] for r in got], (field, way)
            assert field == "other" or {r["all"] for r in got} == {True, False}
    one = any_of([selection(fields, n) for n in needles])
    got = df.select(selection(fields, needles).alias("all"), one.alias("one")).collect()
    assert [r["all"] for r in got] == [r["one"] for r in got] and {r["all"] for r in got} == {True, False}
    assert df.filter(selection(fields, {"text|contains": [*needles, ""]})).count() == df.filter(F.col("text").isNotNull()).count()


def test_texts_that_patterns_need():
    from proofgrid.functions.literals import required_texts

    table = {
        "COPYRIGHT|LICEN[CS]E": ("copyr", "cen"),
        r"https?://": ("http",),
        r"^\s*(?:foo)bar\d+": ("foobar",),
        r"(abc)+x": ("abc",),
        r"(abc)*": (),
        r"a|\d": (),
        r"(?P<q>['\"]).*(?P=q)": (),
        r"(?-i:ABC)d": ("d",),
        "k": (),
        "[": (),
        r"x{0,3}yy?": ("y",),
    }
    assert {p: required_texts(p) for p in table} == table


def test_listed_patterns_are_tried_where_their_text_was_found(spark):
    patterns = [rf"word{i:03d}\w*\s+x" for i in range(80)] + [r"(?:abcd|efgh)\d+", r"\d{7}", r"(q)?zebra(?(1)!|,)", "word001"]
    java = [p for p in patterns if "zebra" not in p]  # Python's own patterns don't reach into lists
    texts = ["word003abc x", "WORD079 \n X", "word003 y word004", "xABCD7", "efgh", "a 1234567", "qzebra!", "zebra!", "zebra,", "word001", "word00", "", None]
    rows = spark.createDataFrame([(i, t, [None, t]) for i, t in enumerate(texts)], "id int, text string, many array<string>")
    fields = EventFields.of(rows, columns=["text", "many"])
    out = rows.select("id", selection(fields, {"text|re": patterns}).alias("one"), selection(fields, {"many|re": java}).alias("some"))
    want = lambda among: [(i, any(re.search(p, t or "", re.IGNORECASE) for p in among)) for i, t in enumerate(texts)]
    assert sorted((r["id"], r["one"]) for r in out.collect()) == want(patterns)
    assert sorted((r["id"], r["some"]) for r in out.collect()) == want(java)
    plan = out.select("one")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rlike") + plan.count("regexp_like") < 10
