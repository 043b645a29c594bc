from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from proofgrid.functions.fields import EventFields
from proofgrid.operators.cases import Baseline, classify, observe, plan_cases, search_window
from proofgrid.operators.rules import Rule, Ruleset, Source, measure_rules

LAYOUT = (
    "case_id string, expected string, max_latency double, skip_reason string, run_skip_reason string, mode string, "
    "executed boolean, emulation_error string, exit_code int, detection_hits bigint, detection_error string, "
    "detection_truncated boolean, telemetry_hits bigint, telemetry_error string, telemetry_truncated boolean, "
    "baseline_hits bigint, baseline_error string, first_us bigint, started_us bigint"
)
BASE = dict(
    case_id="c", expected="detected", max_latency=300.0, skip_reason=None, run_skip_reason=None, mode="live", executed=True,
    emulation_error=None, exit_code=None, detection_hits=0, detection_error=None, detection_truncated=False, telemetry_hits=0,
    telemetry_error=None, telemetry_truncated=False, baseline_hits=0, baseline_error=None, first_us=None, started_us=0,
)
ORDER = [part.split()[0] for part in LAYOUT.split(", ")]


def verdicts(spark, *changes, **options):
    rows = [tuple({**BASE, **change, "case_id": str(i)}[k] for k in ORDER) for i, change in enumerate(changes)]
    out = classify(spark.createDataFrame(rows, LAYOUT), **options).collect()
    return [r for _, r in sorted((int(r["case_id"]), r) for r in out)]


def test_status_matrix(spark):
    table = [
        (1, 5, "detected", "detected", "pass"),
        (0, 5, "detected", "visible", "fail"),
        (0, 0, "detected", "blind", "fail"),
        (0, 5, "visible", "visible", "pass"),
        (0, 0, "visible", "blind", "fail"),
        (0, 0, "blind", "blind", "pass"),
        (0, 5, "blind", "visible", "unexpected_pass"),
        (1, 5, "visible", "detected", "unexpected_pass"),
        (1, 5, "skipped", "detected", "error"),
    ]
    rows = verdicts(spark, *[dict(detection_hits=h, telemetry_hits=p, expected=e) for h, p, e, _, _ in table])
    assert [(r["outcome"], r["status"]) for r in rows] == [(o, s) for *_, o, s in table]


def test_order_of_reasons(spark):
    changes = [
        dict(skip_reason="validation disabled", detection_error="x"),
        dict(skip_reason="case", run_skip_reason="run"),
        dict(started_us=None, emulation_error="boom"),
        dict(mode="dry-run", emulation_error="boom"),
        dict(emulation_error="boom", detection_hits=3),
        dict(detection_hits=None),
        dict(detection_error="timeout", detection_hits=None),
        dict(telemetry_hits=None),
        dict(telemetry_hits=4, telemetry_error="gone"),
        dict(detection_hits=2, telemetry_hits=4, telemetry_error="gone"),
    ]
    rows = verdicts(spark, *changes)
    assert [(r["outcome"], r["status"], r["confidence"]) for r in rows] == [
        ("skipped", "skipped", "high"),
        ("skipped", "skipped", "high"),
        ("skipped", "skipped", "high"),
        ("skipped", "skipped", "high"),
        ("error", "error", "low"),
        ("error", "error", "low"),
        ("error", "error", "low"),
        ("visible", "fail", "low"),
        ("visible", "fail", "low"),
        ("detected", "pass", "low"),
    ]
    assert rows[1]["notes"] == ["run"]
    assert rows[4]["detection_hits"] == 0 and rows[4]["error"].endswith("boom")
    assert rows[9]["telemetry_hits"] == 0


def test_confidence_and_latency(spark):
    rows = verdicts(
        spark,
        dict(detection_hits=1, telemetry_hits=1, first_us=9_000_000),
        dict(detection_hits=1, telemetry_hits=1, first_us=-5, baseline_hits=2),
        dict(detection_hits=9, telemetry_hits=1, detection_truncated=True, first_us=0),
        dict(detection_hits=1, telemetry_hits=9, mode="replay", executed=False, first_us=301_000_400),
        dict(detection_hits=1, telemetry_hits=2, first_us=1, baseline_hits=5, baseline_error="late"),
        dict(detection_hits=1, telemetry_hits=1, first_us=1, exit_code=3),
    )
    assert [r["confidence"] for r in rows] == ["high", "high", "medium", "medium", "high", "high"]
    assert [r["latency"] for r in rows] == [9.0, None, 0.0, 301.0, 0.0, 0.0]
    assert rows[1]["first_us"] == -5 and rows[1]["noisy"]
    assert rows[3]["breached"] and any("301s against a 300s" in n for n in rows[3]["notes"])
    assert rows[4]["baseline_hits"] == 0
    assert any("exit code 3" in n for n in rows[5]["notes"])


def test_strict_compat_truncates_probe(spark):
    rows = verdicts(spark, dict(detection_hits=1, telemetry_hits=2, first_us=0), strict_compat=True)
    assert rows[0]["confidence"] == "medium"


def test_plan(spark):
    rules = spark.createDataFrame(
        [Row(rule="a", tests=["t1", "t2"], enabled=True), Row(rule="b", tests=["t1"], enabled=False), Row(rule="c", tests=[], enabled=True)],
        "rule string, tests array<string>, enabled boolean",
    )
    tests = spark.createDataFrame([("t1",)], "test_id string")
    got = {(r["rule"], r["test_id"]): r["skip_reason"] for r in plan_cases(rules, tests).collect()}
    assert got == {("a", "t1"): None, ("a", "t2"): "test not defined", ("b", "t1"): "validation disabled"}
    assert {r["skip_reason"] for r in plan_cases(rules).collect()} == {None, "validation disabled"}
    assert plan_cases(rules, tests, ["t2"]).count() == 1


@pytest.mark.parametrize("budget, after", [(100.0, 360), (900.0, 960)])
def test_window(spark, budget, after):
    lo, hi = search_window(F.lit(1_000_000_000), F.lit(1_010_000_000), F.lit(budget))
    row = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert (row.lo, row.hi) == (880_000_000, 1_010_000_000 + after * 1_000_000)


def test_observe_counts_hits_probes_and_noise(spark):
    library = Ruleset(
        (
            Rule.from_document({"title": "Err", "telemetry": ["log"], "detection": {"s": {"kind": "error"}, "condition": "s"}}),
            Rule.from_document({"title": "No scope", "detection": {"s": {"kind": "info"}, "condition": "s"}}),
        ),
        {"log": Source("log", {"kind": ["error", "info"]})},
    )
    rows = [(10, "a", "error"), (20, "a", "info"), (30, "b", "error"), (31, "a", "error"), (500, "a", "error"), (5, "a", "error")]
    events = spark.createDataFrame(rows, "us bigint, host string, kind string")
    marked = measure_rules(events, library, EventFields.of(events, columns=["kind"]), ["us", "host"])
    cases = spark.createDataFrame(
        [("c1", "err", "a", 10, 40), ("c2", "err", "b", 0, 20), ("c3", "no-scope", "a", 0, 100)],
        "case_id string, rule string, host string, lo bigint, hi bigint",
    )
    quiet = Baseline(F.lit(0), F.lit(9), F.col("host"))
    for prune in (False, True):
        got = {
            r["case_id"]: (r["detection_hits"], r["first_us"], r["telemetry_hits"], r["baseline_hits"], r["detection_truncated"])
            for r in observe(cases, marked, library, quiet, "host", result_cap=1, prune=prune).collect()
        }
        assert got == {"c1": (2, 10, 3, 1, True), "c2": (0, None, 0, 0, False), "c3": (1, 20, None, 0, False)}
    live = {r["case_id"]: r["detection_hits"] for r in observe(cases, marked, library).collect()}
    assert live == {"c1": 3, "c2": 2, "c3": 1}
