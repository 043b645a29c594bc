from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from proofgrid.operators import coverage, gates, heartbeat, history, noise, scorecard
from proofgrid.operators.quantiles import exact_percentiles
from proofgrid.operators.rules import Source
from proofgrid.plans.telemetry import RULES

CASES = (
    "case_id string, rule string, test_id string, outcome string, status string, severity string, latency double, "
    "max_latency double, baseline_hits bigint, baseline_profile string, telemetry array<string>, "
    "attack array<struct<technique:string,tactic:string>>"
)


def cases(spark, *rows):
    full = []
    for i, r in enumerate(rows):
        d = dict(
            rule="r1", test=f"t{i}", outcome="detected", status="pass", severity="high", latency=None, max_latency=300.0,
            baseline=0, profile="", telemetry=["s1"], attack=[("T1003.001", "credential-access")],
        ) | r
        full.append((str(i), d["rule"], d["test"], d["outcome"], d["status"], d["severity"], d["latency"], d["max_latency"],
                     d["baseline"], d["profile"], d["telemetry"], d["attack"]))
    return spark.createDataFrame(full, CASES)


def content(spark):
    layout = "detected double, visible double, priority string"
    return dict(
        reference=spark.createDataFrame([("T1003", "Dumping", ["credential-access"]), ("T1059", "Shell", ["execution", "impact"])], "technique string, name string, tactics array<string>"),
        technique_targets=spark.createDataFrame([("T1003", 0.5, 0.6, "critical")], f"technique string, {layout}"),
        tactic_targets=spark.createDataFrame([("execution", 0.8, 0.85, "low"), ("impact", 0.75, 0.95, "high")], f"tactic string, {layout}"),
        excluded=spark.createDataFrame([("T1600", "out")], "technique string, reason string"),
    )


def test_coverage(spark):
    df = cases(
        spark,
        dict(rule="a"),
        dict(rule="b", outcome="blind", telemetry=["z", "y"]),
        dict(rule="c", outcome="blind", attack=[("T1059.001", None)]),
        dict(rule="d", outcome="skipped", attack=[("T9999", None), ("T1600.002", None), ("", "impact")]),
        dict(rule="e", outcome="visible", attack=[("T1059.001", "execution"), ("T1059.001", "execution")]),
    )
    tech = coverage.technique_coverage(df, **content(spark))
    got = {r["technique"]: r for r in tech.collect()}
    assert set(got) == {"T1003.001", "T1059.001", "T9999"}
    one = got["T1003.001"]
    assert (one["name"], one["target_detected"], one["priority"], one["status"]) == ("Dumping", 0.5, "critical", "partial")
    assert one["missing_telemetry"] == ["y", "z"] and one["rules"] == ["a", "b"]
    two = got["T1059.001"]
    # The first case names no tactic, so the parent's tactics apply, with the stricter targets.
    assert two["tactics"] == ["execution", "impact"]
    assert (two["target_detected"], two["target_visible"], two["priority"]) == (0.8, 0.95, "high")
    assert (two["visible"], two["blind"], two["status"]) == (2, 1, "detection-gap")
    assert got["T9999"]["status"] == "untested" and got["T9999"]["tactics"] == []

    tactics = spark.createDataFrame([("execution", "Execution", 2)], "tactic string, name string, order int")
    rows = {r["tactic"]: r for r in coverage.tactic_coverage(tech, tactics, content(spark)["tactic_targets"]).collect()}
    assert set(rows) == {"credential-access", "execution", "impact", "unmapped"}
    assert rows["execution"]["scoreable"] == 3 and rows["execution"]["order"] == 2 and not rows["execution"]["meets_target"]
    assert rows["unmapped"]["scoreable"] == 0 and rows["unmapped"]["target_detected"] == 0.7
    total = coverage.overall_coverage(tech).first()
    assert (total["scoreable"], total["detected"]) == (5, 1)
    assert [r["technique"] for r in coverage.coverage_gaps(tech, "visibility").collect()] == ["T1003.001", "T1059.001"]
    layer = {r["technique"]: r for r in coverage.layer_rows(tech, content(spark)["excluded"]).collect()}
    assert layer["T1003.001"]["score"] == 50 and not layer["T1600"]["enabled"]


def test_summary(spark):
    df = cases(
        spark, dict(latency=1.0), dict(latency=2.0), dict(latency=10.0), dict(outcome="visible", status="fail", severity="low"),
        dict(outcome="error", status="error"), dict(outcome="blind", attack=[("T1", None)], baseline=3),
    )
    row = coverage.run_summary(df).first()
    assert (row["total"], row["scoreable"], row["detected"], row["error"]) == (6, 5, 3, 1)
    assert (row["detection_rate"], row["visibility_rate"]) == (0.6, 0.8)
    assert (row["latency_p50"], row["latency_p95"]) == (2.0, 9.2)
    assert (row["severity_low"], row["severity_high"], row["noisy_rules"]) == (1, 2, 1)
    assert (row["techniques_total"], row["techniques_covered"]) == (2, 1)
    empty = coverage.run_summary(cases(spark, dict(outcome="skipped", status="skipped", attack=[]))).first()
    assert empty["detection_rate"] == 0 and empty["latency_p50"] is None and empty["techniques_total"] == 0


def test_percentiles_match_the_standard_library(spark):
    import random
    import statistics

    rng = random.Random(5)
    groups = {"hot": [rng.randrange(4_000_000) / 1000 for _ in range(500)] + [7.5] * 300, "one": [3.25], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r["k"]: (r["p5"], r["p95"]) for r in exact_percentiles(df, ["k"], "v", {"p5": 50, "p95": 95}).collect()}
    for k, vs in groups.items():
        q = statistics.quantiles(vs, n=100, method="inclusive") if len(vs) > 1 else [vs[0]] * 99
        assert abs(got[k][0] - q[49]) < 6e-4 and abs(got[k][1] - q[94]) < 6e-4


def test_noise(spark):
    df = cases(
        spark, dict(rule="a", baseline=2, profile="p"), dict(rule="a", baseline=9, profile="p"), dict(rule="b", baseline=1),
        dict(rule="c", baseline=0, profile="p"), dict(rule="d", baseline=5, profile="p"),
    )
    accepted = spark.createDataFrame([("p", "a", 2, "2020-01-01"), ("p", "d", 1, "2090-01-01")], "profile string, rule string, max_hits int, review_by string")
    found = {r["rule"]: (r["hits"], r["allowance"], r["excess"]) for r in noise.noise_findings(df, accepted).collect()}
    assert found == {"b": (1, 0, 1), "d": (5, 1, 4)}
    assert {r["rule"] for r in noise.noisy_rules(df).collect()} == {"a", "b", "d"}
    assert [r["rule"] for r in noise.overdue_reviews(accepted, F.lit(dt.date(2026, 1, 1))).collect()] == ["a"]
    hosts = spark.createDataFrame([("wks-01",), ("WKS-X",), ("srv",)], "h string")
    globs = [("workstation", "wks-*"), ("any", "wks-0?")]
    assert [r[0] for r in hosts.select(noise.profile_of(F.col("h"), globs)).collect()] == ["workstation", "workstation", None]


def test_diff(spark):
    layout = "rule string, test_id string, outcome string, latency double, severity string"
    before = [("a", "t", "detected", 10.0, "high"), ("b", "t", "detected", 10.0, "high"), ("c", "t", "blind", None, "low"),
              ("d", "t", "error", None, "low"), ("e", "t", "visible", None, "low"), ("f", "t", "detected", 0.0, "low"), ("g", "t", "detected", 20.0, "low")]
    after = [("a", "t", "blind", None, "high"), ("b", "t", "detected", 200.0, "high"), ("c", "t", "visible", None, "low"),
             ("d", "t", "detected", 1.0, "low"), ("f", "t", "detected", 500.0, "low"), ("g", "t", "detected", 40.0, "low"), ("n", "t", "skipped", None, "low")]
    old, new = (spark.createDataFrame(x, layout) for x in (before, after))
    kinds = {r["rule"]: r["kind"] for r in history.diff_cases(new, old, include_unchanged=True).collect()}
    assert kinds == {"a": "regression", "b": "slower", "c": "improvement", "d": "unchanged", "e": "removed", "f": "unchanged", "g": "unchanged", "n": "new"}
    deltas = history.diff_cases(new, old)
    assert [r["kind"] for r in history.order_deltas(deltas).collect()] == ["regression", "slower", "new", "removed", "improvement"]
    counts = {r["kind"]: r["n"] for r in history.diff_counts(deltas).collect()}
    assert counts == {"regression": 1, "slower": 1, "new": 1, "removed": 1, "improvement": 1, "unchanged": 0}
    assert {(r["rule"], r["kind"]) for r in history.first_run_deltas(new).collect()} == {("a", "new"), ("c", "new")}
    prints = lambda *names: spark.createDataFrame([(n, n + "1") for n in names], "rule string, fingerprint string")
    assert {(r["rule"], r["change"]) for r in history.logic_changes(prints("a", "b"), prints("b", "c")).collect()} == {("a", "added"), ("c", "removed")}


def test_latest_and_worst(spark):
    rows = [("r1", "a", "t", "detected", 1), ("r2", "a", "t", "blind", 2), ("r3", "a", "t", "visible", 2), ("r1", "a", "u", "detected", 1), ("r2", "b", "t", "error", 2), ("r1", "b", "u", "visible", 1)]
    df = spark.createDataFrame(rows, "run_id string, rule string, test_id string, outcome string, started_at int")
    latest = {(r["rule"], r["test_id"], r["outcome"]) for r in history.latest_outcomes(df).collect()}
    assert latest == {("a", "t", "blind"), ("a", "t", "visible"), ("a", "u", "detected"), ("b", "t", "error"), ("b", "u", "visible")}
    assert {(r["rule"], r["outcome"]) for r in history.worst_outcomes(df).collect()} == {("a", "blind"), ("b", "visible")}


def gate_map(df):
    return {r["gate"]: r for r in df.collect()}


def test_gates(spark):
    df = cases(
        spark, dict(rule="a"), dict(rule="b", outcome="visible", status="pass"), dict(rule="c", outcome="blind", status="fail", severity="low"),
        dict(rule="d", outcome="error", status="error"), dict(rule="e", latency=400.0),
    )
    got = gate_map(gates.evaluate_gates(df, gates.GateSettings(min_detection_rate=0.9, min_visibility_rate=0.9, fail_on_latency_breach=True)))
    assert len(got) == 8
    assert not got["no-errors"]["passed"] and got["no-errors"]["offenders"] == ["d/t3"]
    assert got["expectations-met"]["passed"]
    # The only visible case is documented: the gate passes, the rate stays, the case is named.
    assert got["detection-rate"]["passed"] and got["detection-rate"]["actual"] == 0.5 and got["detection-rate"]["offenders"] == ["b/t1"]
    assert not got["visibility-rate"]["passed"] and got["visibility-rate"]["offenders"] == ["c/t2"]
    assert not got["latency-budget"]["passed"]
    assert not got["no-regressions"]["applicable"] and not got["coverage-targets"]["applicable"]
    assert not gates.run_passed(gates.evaluate_gates(df)).first()["passed"]
    assert gates.run_passed(gates.evaluate_gates(cases(spark, {}))).first()["passed"]


def test_gate_offenders_are_capped_but_counted(spark):
    df = cases(spark, *[dict(rule=f"r{i:03}", outcome="blind", status="fail") for i in range(45)])
    row = gate_map(gates.evaluate_gates(df))["expectations-met"]
    assert row["n"] == 45 and row["offenders"] == [f"r{i:03}/t{i}" for i in range(20)]


def test_coverage_and_regression_gates(spark):
    settings = gates.GateSettings(fail_on_coverage_target=True, fail_on_noise=True)
    layout = "tactic string, order int, priority string, scoreable bigint, meets_target boolean"
    tactics = spark.createDataFrame([("impact", 1, "high", 3, False), ("execution", 2, "critical", 2, False), ("x", 3, "low", 2, False)], layout)
    df = cases(spark, dict(outcome="blind", status="fail", attack=[("T1", "impact")]), dict(outcome="visible", status="pass", attack=[("T2", "execution")]))
    deltas = spark.createDataFrame([("r", "t", "regression", "high"), ("q", "t", "regression", "low")], "rule string, test_id string, kind string, severity string")
    loud = spark.createDataFrame([("n1", 3, "high"), ("n2", 9, "critical"), ("n3", 1, "low")], "rule string, excess int, severity string")
    got = gate_map(gates.evaluate_gates(df, settings, deltas, tactics, loud))
    assert not got["coverage-targets"]["passed"] and got["coverage-targets"]["offenders"] == ["impact"]
    assert got["no-regressions"]["applicable"] and got["no-regressions"]["offenders"] == ["r/t"]
    assert got["noise-budget"]["offenders"] == ["n2", "n1"]
    documented = cases(spark, dict(outcome="visible", status="pass", attack=[("T2", "execution")]))
    row = gate_map(gates.evaluate_gates(documented, settings, None, tactics))["coverage-targets"]
    assert row["passed"] and row["offenders"] == ["execution", "impact"]
    none = tactics.filter("1 = 0")
    assert not gate_map(gates.evaluate_gates(documented, settings, None, none))["coverage-targets"]["applicable"]


def test_heartbeat_states(spark):
    ages = {"h0": 0, "h899": 899, "h900": 900, "h901": 901, "h2700": 2700, "h2701": 2701, "ahead": -50}
    seen = spark.createDataFrame([("s", h, -a * 1_000_000) for h, a in ages.items()] * 2, "source string, host string, us bigint")
    inventory = spark.createDataFrame([("s", "never"), ("s", "h0")], "source string, host string")
    beats = heartbeat.heartbeat(seen, inventory, F.lit(0))
    got = {r["host"]: (r["state"], r["age_s"], r["events"]) for r in beats.collect()}
    assert {h: v[0] for h, v in got.items()} == {
        "h0": "alive", "h899": "alive", "h900": "alive", "h901": "late", "h2700": "late", "h2701": "silent", "ahead": "alive", "never": "silent"
    }
    assert got["ahead"][1] == 0 and got["never"] == ("silent", None, 0) and got["h0"][2] == 2
    counts = heartbeat.heartbeat_counts(beats).first()
    assert (counts["silent"], counts["late"], counts["alive"], counts["healthy"]) == (2, 2, 4, False)
    assert [r["host"] for r in heartbeat.worst_first(beats).collect()][:2] == ["h2701", "never"]
    own = heartbeat.heartbeat(seen, policy={"s": (10_000.0, 1.0)}, as_of_us=F.lit(0))
    assert {r["state"] for r in own.collect()} == {"alive"}
    assert heartbeat.source_policy([Source("a", interval=5.0), Source("b")]) == {"a": (5.0, 3.0)}
    assert heartbeat.lookback_seconds(900, 0.5) == 1800


def test_scorecard(spark):
    rows = [("a", "id", "production", "detected", 100.0, True, ["t"], 0, 0, 90.0, 100.0, 100.0, 100.0),
            ("b", "", "experimental", "visible", 100.0, True, ["t"], 1, 1, 50.0, 50.0, 50.0, 50.0),
            ("c", "id", "deprecated", "detected", 100.0, True, [], 0, 0, 50.0, 50.0, 50.0, 50.0)]
    rules = spark.createDataFrame(rows, "rule string, id string, status string, expected string, max_latency double, enabled boolean, tests array<string>, unused_selections int, unknown_keys int, robustness double, telemetry_score double, attack_score double, documentation double")
    past = spark.createDataFrame([("r", "a", "detected", 150.0, 0), ("r", "b", "visible", None, 4)], "run_id string, rule string, outcome string, latency double, baseline_hits int")
    got = {r["rule"]: r for r in scorecard.score_rules(rules, past, ["a", "b", "c"]).collect()}
    assert got["a"]["validation"] == 85 and got["a"]["total"] == 93.8 and got["a"]["grade"] == "A" and got["a"]["weakest"] == "validation"
    assert got["b"]["validation"] == 45 and got["b"]["hygiene"] == 0 and got["b"]["weakest"] == "hygiene"
    assert got["c"]["validation"] == 0 and got["c"]["hygiene"] == 70
    roll = scorecard.score_rollup(scorecard.score_rules(rules, past, ["a", "b", "c"])).first()
    assert (roll["grade_a"], roll["grade_f"], roll["below"]) == (1, 2, 2)
    tests = spark.createDataFrame([("other",)], "test_id string")
    assert {r["validation"] for r in scorecard.score_rules(rules, past, ["a"], tests).collect()} == {45.0}


def test_library_selection():
    names = lambda **k: [r.name for r in RULES.select(**k).rules]
    assert "view-any" not in names() and "view-any" in names(include_inactive=True)
    assert names(techniques=["T1003"]) == ["click-odd", "error-burst", "mixed-pair"]
    assert names(techniques=["T1003.001"]) == ["click-odd", "mixed-pair"]
    assert names(tactics=["Impact"], min_severity="critical") == ["purchase-spike"]
    assert names(statuses=["PRODUCTION"], exclude=["purchase-spike"]) == ["error-burst"]
