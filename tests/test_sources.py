from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from proofgrid.operators import capture, coverage, gates, noise
from proofgrid.operators.replay import replay
from proofgrid.operators.rules import Rule, RuleError
from proofgrid.sources import content, corpus, read_events, register_source
from proofgrid.sources.exports import unwrap
from proofgrid.sources.store import RunStore, run_tables, write_run_document
from proofgrid.session import cut_lineage

RULES = {
    "handle.yml": """
name: handle
title: Handle opened
status: production
severity: high
id: 1
attack: {tactics: [credential-access], techniques: [T1003.001]}
telemetry: [access]
detection:
  selection: {TargetImage|endswith: '\\lsass.exe', GrantedAccess: ['0x1010', '0x1410']}
  filter_known: {SourceImage|endswith: '\\agent.exe'}
  condition: selection and not filter_known
validation: {emulation: [dump, ghost], max_latency: 3m}
""",
    "logon.yml": """
title: Remote logon
level: crit
attack: [T1021.001]
telemetry: [logon]
detection:
  selection: {LogonType: 10}
  filter_net: {IpAddress|cidr: 10.0.0.0/8}
  condition: selection and not filter_net
validation: {emulation: [rdp], expect: visible}
tuning: {baseline_profile: desk}
""",
    "cloud.yml": """
title: Root login
severity: medium
telemetry: [audit, nowhere]
detection:
  selection: {eventName: ConsoleLogin, userIdentity.type: root}
  failed: {errorCode|exists: true}
  condition: selection and not failed
validation: {emulation: root, max_latency: 15m}
""",
    "channel.yml": """
title: Uncollected channel
telemetry: [defender]
detection: {selection: {EventID: 5007}, condition: selection}
validation: {emulation: [dump], expect: blind, enabled: true}
""",
    "broken.yml": "title: Broken\ndetection: {selection: {a: 1}, condition: nothing}\n",
    "zagain.yml": "name: handle\ntitle: Same name\ndetection: {selection: {a: 1}, condition: selection}\n",
    "_template.yml": "title: Not a rule\n",
}
SOURCES = """
sources:
  access: {fields: [TargetImage], backends: {fixture: {scope: {Channel: sysmon, EventID: 10}}}, heartbeat: {interval: 5m, grace: 2}}
  logon: {backends: {fixture: {scope: {Channel: Security, EventID: 4624}}}}
  audit: {backends: {fixture: {scope: {source: cloud}}}}
  defender: {backends: {fixture: {scope: {Channel: defender}}}}
"""
EVENTS = {
    "theft": [
        {"_test": "dump", "_offset": 2, "_host": "w1", "Channel": "sysmon", "EventID": 10, "TargetImage": "C:\\Windows\\LSASS.exe", "GrantedAccess": "0x1010", "SourceImage": "C:\\x\\agent.exe"},
        {"_test": "dump", "_offset": 9, "_host": "w1", "Channel": "Sysmon", "EventID": "10", "TargetImage": "C:\\Windows\\lsass.exe", "GrantedAccess": "0x1410", "SourceImage": "C:\\t\\d.exe"},
        {"_test": "rdp", "_offset": 1.5, "Computer": "w2", "Channel": "Security", "EventID": 4624, "LogonType": 10, "IpAddress": "10.1.2.3"},
    ],
    "cloud": [
        {"_test": "root", "_offset": 402, "source": "cloud", "eventName": "ConsoleLogin", "userIdentity": {"type": "Root"}, "responseElements": None},
        {"_test": "other", "_offset": 3, "source": "cloud", "eventName": "ConsoleLogin", "userIdentity": {"type": "Root"}},
    ],
    "quiet": [{"_offset": 60, "Channel": "sysmon", "EventID": 10, "TargetImage": "lsass.exe", "GrantedAccess": "0x1410"}, {"_offset": 61, "Channel": "sysmon", "EventID": 10, "TargetImage": "x\\lsass.exe", "GrantedAccess": "0x1410"}],
    "_hidden": [{"_test": "dump", "Channel": "sysmon"}],
}


@pytest.fixture(scope="module")
def workspace(tmp_path_factory):
    root = tmp_path_factory.mktemp("work")
    (root / "rules" / "sub").mkdir(parents=True)
    for name, text in RULES.items():
        folder = root / "rules" / ("sub" if name == "cloud.yml" else "")
        (folder / name).write_text(text)
    (root / "sources.yml").write_text(SOURCES)
    (root / "tests").mkdir()
    (root / "tests" / "all.yml").write_text(
        "tests:\n" + "".join(f"- {{id: {t}, technique: T1, duration: 10s, expected_telemetry: [access]}}\n" for t in ("dump", "rdp", "root"))
    )
    for scenario, rows in EVENTS.items():
        folder = root / "corpora" / scenario
        folder.mkdir(parents=True)
        lines = ["# header", "", "// note", *map(json.dumps, rows)]
        (folder / "events.jsonl").write_text("\n".join(lines) + "\n")
        (folder / "manifest.yml").write_text(f"scenario: {scenario}\ntests: [dump]\n" + ("" if scenario == "quiet" else 'recorded_at: "2026-05-14T09:12:00Z"\n'))
    return root


def test_content(workspace):
    ruleset, errors = content.load_ruleset(workspace / "rules", workspace / "sources.yml")
    assert [r.name for r in ruleset.rules] == ["channel", "cloud", "handle", "logon"]
    assert sorted(e[0].rsplit("/", 1)[1] for e in errors) == ["broken.yml", "zagain.yml"]
    by = {r.name: r for r in ruleset.rules}
    assert by["handle"].attack == (("T1003.001", "credential-access"),) and by["handle"].max_latency == 180
    assert by["logon"].severity == "critical" and by["logon"].attack == (("T1021.001", None),)
    assert by["cloud"].tests == ("root",) and ruleset.sources["access"].interval == 300
    changed = Rule.from_document({"title": "Handle opened", "detection": {"selection": {"a": 1}, "condition": "selection"}})
    again = Rule.from_document({"title": "Other words", "detection": {"selection": {"a": 1}, "condition": "selection"}})
    assert changed.fingerprint == again.fingerprint != by["handle"].fingerprint
    odd = {"title": "x", "detection": {"a": {"Path": ["C:\\Users\\*", "C:\\Temp*"], "b|re": "\\w\\*"}, "condition": "a"}}
    assert Rule.from_document(odd).escaped_stars == ("C:\\Users\\*",)
    for bad in ({"title": "x"}, {"title": "x", "detection": {"condition": "a"}}, {"title": "x", "detection": {"a": {"b|zz": 1}, "condition": "a"}},
                {"title": "x", "attack": ["T12"], "detection": {"a": {"b": 1}, "condition": "a"}}):
        with pytest.raises(RuleError):
            Rule.from_document(bad)


def test_replay_gives_the_three_states(spark, workspace):
    events = read_events(spark, "corpus", str(workspace / "corpora"))
    assert {r["scenario"] for r in events.select("scenario").distinct().collect()} == {"theft", "cloud", "quiet"}
    ruleset, _ = content.load_ruleset(workspace / "rules", workspace / "sources.yml")
    tests = content.tests_table(spark, content.load_tests(workspace / "tests"))
    out = replay(events, corpus.corpus_fields(events), ruleset, tests, 1_700_000_000_000_000)
    got = {(r["rule"], r["test_id"]): r for r in out.collect()}
    brief = {k: (r["outcome"], r["status"], r["latency"], r["detection_hits"], r["telemetry_hits"]) for k, r in got.items()}
    assert brief == {
        ("handle", "dump"): ("detected", "pass", 9.0, 1, 2),
        ("handle", "ghost"): ("skipped", "skipped", None, 0, 0),
        ("logon", "rdp"): ("visible", "pass", None, 0, 1),
        ("cloud", "root"): ("detected", "pass", 402.0, 1, 1),
        ("channel", "dump"): ("blind", "pass", None, 0, 0),
    }
    assert got["handle", "dump"]["baseline_hits"] == 1 and got["handle", "dump"]["confidence"] == "medium"
    assert got["logon", "rdp"]["severity"] == "critical" and got["handle", "ghost"]["notes"] == ["test not defined"]
    only = read_events(spark, "corpus", str(workspace / "corpora"), scenarios=["cloud"])
    assert only.count() == 2


def test_a_replayed_run_is_stored(spark, workspace, tmp_path):
    events = corpus.read_corpus(spark, str(workspace / "corpora"))
    ruleset, _ = content.load_ruleset(workspace / "rules", workspace / "sources.yml")
    tests = content.tests_table(spark, content.load_tests(workspace / "tests"))
    out = cut_lineage(replay(events, corpus.corpus_fields(events), ruleset, tests, 1_700_000_000_000_000))
    layout = "detected double, visible double, priority string"
    techniques = coverage.technique_coverage(
        out,
        spark.createDataFrame([("T1003", "Dumping", ["credential-access"])], "technique string, name string, tactics array<string>"),
        spark.createDataFrame([], f"technique string, {layout}"),
        spark.createDataFrame([], f"tactic string, {layout}"),
        spark.createDataFrame([], "technique string, reason string"),
    )
    accepted = spark.createDataFrame([], "profile string, rule string, max_hits int")
    loud = noise.noise_findings(out, accepted)
    checked = gates.evaluate_gates(out, gates.GateSettings(fail_on_noise=True), noise=loud)
    run = {"profile": "p", "backend": "corpus", "mode": "replay", "started_at": "2026-03-01 10:00:00", "finished_at": "2026-03-01 10:00:30"}
    store = RunStore(spark, str(tmp_path / "runs"))
    kept = spark.createDataFrame([("x", 1, "{}")], "case_id string, place int, document string")
    store.save("run-1", run["started_at"], run_tables(out, run, checked, loud, techniques, ruleset.table(spark), kept))
    row = store.read("runs").first()
    assert (row["total"], row["detected"], row["visible"], row["blind"], row["skipped"]) == (5, 2, 1, 1, 1)
    assert row["duration_s"] == 30 and row["gates_passed"] is False and row["latency_p50"] == 205.5
    found = {r["kind"]: (r["name"], r["message"]) for r in store.findings("run-1").collect()}
    assert found == {"gate": ("noise-budget", "1 offender(s)"), "noise": ("handle", "handle has 1 quiet-window hit(s), 1 more than accepted")}
    loaded = {(r["rule"], r["test_id"]): r for r in store.load_cases("run-1").collect()}
    assert loaded["handle", "dump"]["attack"][0]["tactic"] == "credential-access" and loaded["handle", "dump"]["emulation"]["mode"] == "replay"
    assert loaded["handle", "ghost"]["emulation"] is None
    assert store.read("rule_snapshots").count() == 4 and store.read("coverage_snapshots").count() == 2


def test_bad_lines(spark, tmp_path):
    folder = tmp_path / "c" / "s"
    folder.mkdir(parents=True)
    (folder / "events.jsonl").write_text('{"a": 1}\n[1]\n{bad\n')
    assert corpus.rejected_lines(spark, str(tmp_path / "c")).count() == 2
    assert corpus.read_corpus(spark, str(tmp_path / "c"), strict=False).count() == 1
    with pytest.raises(Exception, match="events.jsonl"):
        corpus.read_corpus(spark, str(tmp_path / "c")).collect()


def test_manifests_and_inventory(spark, workspace, tmp_path):
    rows = {r["scenario"]: r for r in corpus.read_manifests(spark, str(workspace / "corpora")).collect()}
    assert rows["quiet"]["recorded_at"] is None and str(rows["theft"]["recorded_at"]) == "2026-05-14 09:12:00"
    (tmp_path / "inv.txt").write_text("# hosts\n- w1\n  w2 \n\n-  w1\n")
    assert sorted(r["host"] for r in corpus.read_inventory(spark, str(tmp_path / "inv.txt")).collect()) == ["w1", "w2"]


def test_capture_writes_a_corpus_that_replays(spark, tmp_path):
    rows = [(1, 1_000_000, "h", {"_time": "x", "CommandLine": "a\"b", "user_password": "p"}), (2, 5_000_000, "h", {"CommandLine": "c"}),
            (2, 5_000_000, "h", {"CommandLine": "c"}), (3, 99_000_000, "h", {"CommandLine": "d"}), (4, None, "h", {"CommandLine": "e"})]
    events = spark.createDataFrame(rows, "event_id bigint, us bigint, host string, document map<string,string>").withColumn("k", F.lit(1))
    windows = spark.createDataFrame([(1, "t1", 500_000, 0, 6_000_000), (2, "t2", 4_000_000, 4_000_000, 9_000_000)], "window_id bigint, test_id string, anchor_us bigint, lo bigint, hi bigint").withColumn("k", F.lit(1))
    got = capture.capture(events, windows, ["k"], "document", ["PASSWORD"])
    assert {(r["event_id"], r["_test"], r["_offset"]) for r in got.collect()} == {(1, "t1", 0.5), (2, "t1", 4.5)}
    corpus.write_corpus(got, str(tmp_path / "out"), "mine", {"tests": ["t1", "t2"], "recorded_at": "2026-01-01T00:00:00Z"})
    back = {r["offset_s"]: r for r in corpus.read_corpus(spark, str(tmp_path / "out")).withColumn("j", F.to_json("doc")).collect()}
    assert json.loads(back[0.5]["j"]) == {"_test": "t1", "_offset": 0.5, "_host": "h", "CommandLine": 'a"b', "user_password": "[redacted]"}
    assert back[4.5]["test_id"] == "t1" and back[4.5]["host"] == "h"
    assert corpus.read_manifests(spark, str(tmp_path / "out")).first()["tests"] == ["t1", "t2"]
    with pytest.raises(Exception, match="(?i)exist"):
        corpus.write_corpus(got, str(tmp_path / "out"), "mine", {})
    with pytest.raises(ValueError):
        corpus.write_corpus(got.filter("1 = 0"), str(tmp_path / "out"), "none", {})
    profile = {r["_test"]: r for r in capture.capture_profile(got, ["CommandLine"]).collect()}
    assert profile["t1"]["events"] == 2 and profile["t1"]["with_CommandLine"] == 2


def docs(df):
    return [(json.loads(r["j"]), r["t"]) for r in df.select(F.to_json("doc").alias("j"), F.unix_micros("ts").alias("t")).collect()]


def test_exports(spark, tmp_path):
    raw = json.dumps({"CommandLine": "x", "host": "inner"})
    (tmp_path / "a.json").write_text("\n".join([json.dumps({"result": {"_raw": raw, "host": "outer", "_time": "1700000000"}}), "junk", json.dumps({"preview": True}), json.dumps({"result": {"_raw": "plain", "n": 1}})]))
    assert docs(read_events(spark, "ndjson-export", str(tmp_path / "a.json"))) == [
        ({"CommandLine": "x", "host": "outer", "_time": "1700000000"}, 1_700_000_000_000_000), ({"_raw": "plain", "n": 1}, None)]
    (tmp_path / "b.json").write_text(json.dumps({"hits": {"total": {"value": 2}, "hits": [{"_id": "1", "_source": {"@timestamp": "2026-01-01T00:00:00Z", "a": {"b": 1}}}, {"_id": "2"}]}}, indent=1))
    assert docs(read_events(spark, "search-hits", str(tmp_path / "b.json"), multiline=True)) == [
        ({"@timestamp": "2026-01-01T00:00:00Z", "a": {"b": 1}, "_id": "1"}, 1_767_225_600_000_000), ({"_id": "2"}, None)]
    (tmp_path / "c.json").write_text(json.dumps({"tables": [{"columns": [{"name": "TimeGenerated"}, {"name": "x"}, {"name": "x"}], "rows": [["2026-01-01", 1, 2], ["bad", None]]}]}))
    assert docs(read_events(spark, "tables", str(tmp_path / "c.json"))) == [
        ({"TimeGenerated": "2026-01-01", "x": 2}, 1_767_225_600_000_000), ({"TimeGenerated": "bad", "x": None}, None)]
    bare = spark.createDataFrame([('{"raw": {"a": 1, "_time": 5}, "timestamp": "1700000000", "source": "s"}',), ('{"raw": "text", "UtcTime": "2026-01-01 00:00:00"}',)], "j string").select(F.parse_json("j").alias("doc"))
    assert docs(unwrap(bare)) == [({"a": 1, "_time": 5}, 1_700_000_000_000_000), ({"raw": "text", "UtcTime": "2026-01-01 00:00:00"}, 1_767_225_600_000_000)]
    register_source("mine", lambda s, path: s.range(3))
    assert read_events(spark, "MINE", "x").count() == 3
    with pytest.raises(ValueError):
        read_events(spark, "none", "x")


def test_store(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "history"))

    def save(run_id, day, outcome, profile="p"):
        at = F.lit(f"2026-01-{day:02} 10:00:00").cast("timestamp")
        runs = spark.createDataFrame([(profile, "fixture")], "profile string, backend string").withColumn("started_at", at)
        rows = spark.createDataFrame([("c1", "r", "t", outcome), ("c2", "r", "u", "detected")], "case_id string, rule string, test_id string, outcome string")
        attack = spark.createDataFrame([("c1", "T1", "x"), ("c1", "T2", None)], "case_id string, technique string, tactic string")
        evidence = spark.createDataFrame([("c1", 1, "{}")], "case_id string, ordinal int, document string")
        emulations = spark.createDataFrame([("t", "live")], "test_id string, mode string")
        findings = spark.createDataFrame([(2, "gate"), (1, "noise")], "id int, kind string")
        store.save(run_id, f"2026-01-{day:02} 10:00:00", {"runs": runs, "cases": rows, "case_attack": attack, "evidence": evidence, "emulations": emulations, "findings": findings})

    save("r1", 1, "blind")
    save("r2", 2, "visible")
    save("r3", 3, "detected", "q")
    save("r2", 2, "detected")
    assert store.read("cases").count() == 6
    loaded = {r["case_id"]: r for r in store.load_cases("r2").collect()}
    assert loaded["c1"]["outcome"] == "detected" and [a["technique"] for a in loaded["c1"]["attack"]] == ["T1", "T2"]
    assert loaded["c1"]["emulation"]["mode"] == "live" and loaded["c2"]["attack"] is None and len(loaded["c1"]["evidence"]) == 1
    assert store.latest_run_id() == "r3" and store.latest_run_id("p") == "r2" and store.previous_run_id("r2") == "r1" and store.previous_run_id("r3") is None
    assert [r["id"] for r in store.findings("r1").collect()] == [1, 2] and store.findings("r1", "gate").count() == 1
    assert {r["table"]: r["rows"] for r in store.stats().collect()}["cases"] == 6
    assert store.history().count() == 6
    assert store.prune(F.lit("2026-01-02 12:00:00").cast("timestamp")) == ["r1", "r2"]
    assert store.read("cases").count() == 2 and store.read("runs").count() == 1 and store.read("evidence").count() == 1
    folders = [p for p in (tmp_path / "history").rglob("version=*") if "manifest" not in p.parts]
    assert {p.parent.name for p in folders} == {"run_key=run r3"}
    write_run_document(str(tmp_path / "doc"), {"run": store.read("runs"), "results": store.load_cases("r3")})
    assert spark.read.json(str(tmp_path / "doc" / "results")).count() == 2


def test_a_save_that_dies_changes_nothing(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "history"))
    rows = lambda n, at: spark.range(n).select(F.col("id").cast("string").alias("case_id"), F.lit(at).cast("timestamp").alias("started_at"))
    seen = lambda: {t: sorted((r["run_id"], r["case_id"]) for r in store.read(t).collect()) for t in ("runs", "cases")}
    store.save("007", "2026-01-01", {"runs": rows(1, "2026-01-01"), "cases": rows(3, "2026-01-01")})
    store.save("7", "2026-01-02", {"runs": rows(1, "2026-01-02"), "cases": rows(2, "2026-01-02")})
    before = seen()
    assert before["runs"] == [("007", "0"), ("7", "0")]
    broken = rows(9, "2026-03-01").withColumn("case_id", F.when(F.col("case_id") == "8", F.raise_error(F.lit("lost"))).otherwise(F.col("case_id")))
    for tables in ({"cases": rows(5, "2026-03-01"), "runs": broken}, {"runs": rows(1, "2026-03-01"), "cases": broken}):
        with pytest.raises(Exception, match="lost"):
            store.save("007", "2026-03-01", tables)
        assert seen() == before and store.read("cases", "007").count() == 3
    # What the dead saves left is kept while it may still be written, and then goes.
    assert store.vacuum() == 0
    assert store.vacuum(abandoned_s=-1) == 2 and seen() == before
    store.save("007", "2026-01-05", {"runs": rows(1, "2026-01-05"), "cases": rows(4, "2026-01-05")})
    assert store.read("cases", "007").count() == 4 and store.read("cases", "none").count() == 0
    assert store.prune(F.lit("2026-01-03").cast("timestamp")) == ["7"]
    assert seen() == {"runs": [("007", "0")], "cases": [("007", str(i)) for i in range(4)]}
    assert not list((tmp_path / "history").rglob("run_key=run 7/version=*"))
