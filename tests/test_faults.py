"""Tests in Python that fail, rules that can't be evaluated, and corpus lines that can't be read."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from proofgrid.functions.fields import EventFields, discover_paths
from proofgrid.functions.predicates import SelectionError, register_test
from proofgrid.operators.replay import replay
from proofgrid.operators.rules import Rule, Ruleset, Source, asked_names, match_or_fail, match_rules, measure_rules, usable
from proofgrid.sources import corpus


def test_failing_tests_skip_events_and_come_out_as_rows(spark):
    # By value: the function travels with the plan, as a user's would.
    register_test("less", lambda text, limit: int(text) < limit)
    rows = [(1, "3", ["9", "1"], "s"), (2, "30", ["x", "1"], "s"), (3, "zz", None, "s"), (4, None, [], "s"), (5, "", ["1", "x"], "other")]
    events = spark.createDataFrame(rows, "id int, n string, many array<string>, src string")
    body = {"low": {"n|less": 5}, "some": {"many|less": 5}, "plain": {"src": "s"}}
    rules = (
        Rule("low", {"low": body["low"], "condition": "low"}),
        Rule("high", {"low": body["low"], "condition": "not low"}, telemetry=("src",)),
        Rule("some", {"some": body["some"], "condition": "some"}, telemetry=("src",)),
        Rule("plain", {"plain": body["plain"], "condition": "plain"}),
    )
    ruleset = Ruleset(rules, {"src": Source("src", {"src": "s"})})
    fields = EventFields.of(events)
    got = {(r["rule"], r["id"]): r["error"] for r in match_or_fail(events, ruleset, fields, ["id"]).collect()}
    hits = {key for key, error in got.items() if error is None}
    assert hits == {("low", 1), ("high", 2), ("high", 4), ("some", 1)} | {("plain", i) for i in (1, 2, 3, 4)}
    # Event 5 lies outside the scope of `high` and `some`, so their tests of it are nobody's concern.
    assert {key for key, error in got.items() if error} == {("low", 3), ("low", 5), ("high", 3), ("some", 2)}
    assert got["low", 3].startswith("ValueError: ")
    assert {(r["rule"], r["id"]) for r in match_rules(events, ruleset, fields, ["id"]).collect()} == hits


def test_broken_rules_are_left_out_with_their_reason(spark):
    events = spark.createDataFrame([("t", 1.0, "{\"a\": 1, \"b\": 2}"), ("t", 2.0, "{\"a\": 2}")], "test_id string, offset_s double, j string")
    events = events.select("test_id", "offset_s", F.parse_json("j").alias("doc"))
    fields = EventFields.of(events, "doc", [("a",), ("b",)], columns=[])
    rules = tuple(
        Rule(name, {"sel": body, "condition": "sel"}, telemetry=(source,), tests=("t",))
        for name, body, source in (("good", {"a": 1}, "fine"), ("net", {"a|cidr": "1.2.3.999"}, "fine"), ("scope", {"a": 1}, "torn"))
    )
    ruleset = Ruleset(rules, {"fine": Source("fine", {"a|exists": True}), "torn": Source("torn", {"b|nothing": 1})})
    good, why = usable(ruleset, fields)
    assert [r.name for r in good.rules] == ["good"] and set(good.sources) == {"fine"} and set(why) == {"net", "scope"}
    with pytest.raises(SelectionError):
        measure_rules(events, ruleset, fields, ["test_id"])
    found: dict[str, str] = {}
    assert [r["rule"] for r in match_rules(events, ruleset, fields, ["test_id"], found).collect()] == ["good"] and found == why
    tests = spark.createDataFrame([("t", 5.0)], "test_id string, duration_s double")
    tests = tests.withColumn("telemetry", F.array().cast("array<string>"))
    out = {r["rule"]: r for r in replay(events, fields, ruleset, tests, 1_700_000_000_000_000).collect()}
    assert {name: r["outcome"] for name, r in out.items()} == {"good": "detected", "net": "error", "scope": "error"}
    assert "1.2.3.999" in out["net"]["detection_error"] and out["good"]["detection_error"] is None
    # A filter of all events that means nothing leaves no rule.
    none, all_of_them = usable(Ruleset(rules[:1], {}, {"a|nothing": 1}), fields)
    assert none.rules == () and set(all_of_them) == {"good"} and match_rules(events, none, fields, ["test_id"]).isEmpty()


def test_rejected_lines_have_their_numbers_in_split_files(spark, tmp_path):
    draw = random.Random(3)
    want = set()
    for scenario, count in (("long", 30_000), ("short", 7), ("odd name", 900)):
        lines = []
        for number in range(1, count + 1):
            kind = draw.choice(("good",) * 30 + ("torn", "list", "null", "blank", "note"))
            line = {"good": '{"a": %d}' % number, "torn": '{"a": ' + "x" * draw.randrange(200), "list": "[1]", "null": " null ", "blank": "  ", "note": " # n"}[kind]
            lines.append(line)
            if kind in ("torn", "list", "null"):
                want.add((scenario, number, "not JSON" if kind == "torn" else "not an object", line))
        (tmp_path / scenario).mkdir()
        (tmp_path / scenario / "events.jsonl").write_text("\n".join(lines) + ("\n" if scenario != "short" else ""))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = corpus.rejected_lines(spark, str(tmp_path))
        assert spark.read.text(f"{tmp_path}/long/events.jsonl").rdd.getNumPartitions() > 10
        assert {(r["scenario"], r["line"], r["reason"], r["value"]) for r in found.collect()} == want and found.count() == len(want)
        first = min(n for s, n, *_ in want if s == "long")
        with pytest.raises(Exception, match=rf"long/events.jsonl:{first}: not "):
            corpus.read_corpus(spark, str(tmp_path), ["long"]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_written_corpora_keep_the_name_of_their_scenario(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1.0, "h", {"a": "1"})], "_test string, _offset double, _host string, document map<string,string>")
    corpus.write_corpus(rows, str(tmp_path), "mine", {})
    assert corpus.read_corpus(spark, str(tmp_path)).first()["scenario"] == "mine"
    assert corpus.read_manifests(spark, str(tmp_path)).first()["folder"] == "mine"
    assert corpus.read_corpus(spark, str(tmp_path), ["mine"]).count() == 1


def test_discovery_goes_to_the_bottom_and_returns_what_is_asked(spark):
    deep = "".join(f'{{"K{i}":' for i in range(1, 21)) + "[[1, {\"end\": 2}]]" + "}" * 20
    documents = [deep, '{"a": {"b": 1}, "a.b": 2, "list": [{"b": [3]}], "none": null}', '{"a": 5, "e": {}, "l": []}', "7", None]
    rows = [(d,) for d in documents] + [('{"x%d": {"y%d": 1}}' % (i, i),) for i in range(3000)]
    df = spark.createDataFrame(rows, "j string").select(F.parse_json("j").alias("doc"))
    keys = tuple(f"K{i}" for i in range(1, 21))
    everything = set(discover_paths(df, "doc"))
    assert {keys + ("[*]", "[*]"), keys + ("[*]", "[*]", "end"), ("a",), ("a", "b"), ("a.b",), ("list", "[*]", "b", "[*]"), ("e",), ("l",)} <= everything
    assert ("x7", "y7") in everything and len([p for p in everything if len(p) == 2]) >= 3000
    assert set(discover_paths(df, "doc", ["B", "a.b", "missing"])) == {("a", "b"), ("a.b",), ("list", "[*]", "b"), ("list", "[*]", "b", "[*]")}
    assert discover_paths(df, "doc", [".".join(keys)]) == [keys, keys + ("[*]",)]
    assert discover_paths(df.filter("1 = 0"), "doc") == [] and discover_paths(df, "doc", []) == []
    library = (Rule("r", {"s": {"B|contains": "x", "k|zz": 1}, "condition": "s"}),)
    assert asked_names(Ruleset(library, {"q": Source("q", [{"c": 1}])})) == ["B", "c", "k"]
    assert asked_names(Ruleset((Rule("w", {"s": ["word"], "condition": "s"}),))) is None
