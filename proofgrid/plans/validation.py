"""Queries: rule scan, case planning, observation, verdicts, summary, evidence, gates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.operators import capture, coverage, gates, noise
from proofgrid.functions.scalars import case_id
from proofgrid.operators.cases import Baseline, observe, plan_cases
from proofgrid.operators.quantiles import exact_percentiles
from proofgrid.operators.rules import match_rules, measure_rules
from proofgrid.operators.timeline import attribute_events, first_in_windows, on_days
from proofgrid.session import cut_lineage, shared_folder
from proofgrid.sources import clustered
from proofgrid.plans.telemetry import (
    QUIET_US,
    RESULT_CAP,
    RULES,
    Query,
    observed,
    obs_sql,
    planned,
    results,
    table,
    telemetry,
    telemetry_fields,
    with_events,
    with_results,
    EV,
    RULE_ROWS,
    HITS,
    PROBES,
    CASES,
)


def matches(spark: SparkSession, sf_dir: str, keep: tuple[str, ...]) -> DataFrame:
    events = telemetry(spark, sf_dir)
    return match_rules(events, RULES, telemetry_fields(events), keep)


def multi_rule_scan(spark, sf_dir):
    return matches(spark, sf_dir, ("event_id", "user_id"))


def rule_hit_counts(spark, sf_dir):
    return matches(spark, sf_dir, ("user_id", "value")).groupBy("rule").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("user_id").alias("hosts"), F.max("value").alias("top_value")
    )


def case_plan(spark, sf_dir):
    """Tests are the event types seen per host; only signups and purchases are catalogued."""
    events = telemetry(spark, sf_dir)
    catalogue = events.filter(F.col("event_type").isin("signup", "purchase")).select(
        F.concat_ws("/", "event_type", "user_id").alias("test_id")
    )
    declared = events.select(
        F.concat_ws("/", "event_type", "user_id").alias("test_id")
    ).distinct()
    rules = declared.select("test_id", F.inline(F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), F.lit(r.active).alias("enabled"))
        for r in RULES.rules
    ]))).withColumn("tests", F.array("test_id")).drop("test_id")
    return plan_cases(rules, catalogue).select("rule", "test_id", "severity", "skip_reason")


CASE_PLAN_SQL = """
WITH lib(rule, severity, enabled) AS (VALUES """ + ", ".join(
    f"('{r.name}', '{r.severity}', {r.active})" for r in RULES.rules
) + """),
known AS (SELECT DISTINCT event_type || '/' || user_id AS test_id FROM events WHERE event_type IN ('signup', 'purchase')),
declared AS (SELECT DISTINCT event_type || '/' || user_id AS test_id FROM events)
SELECT rule, d.test_id, severity,
       CASE WHEN NOT enabled THEN 'validation disabled' WHEN k.test_id IS NULL THEN 'test not defined' END AS skip_reason
FROM declared d CROSS JOIN lib LEFT JOIN known k ON k.test_id = d.test_id
"""


def rule_select(spark, sf_dir):
    """Hits of the rules a profile selects: high severity and up, active, parent technique T1003 or T1002."""
    chosen = RULES.select(platforms=["WEB"], techniques=["t1003", "T1002"], min_severity="high", exclude=["purchase-spike"])
    events = telemetry(spark, sf_dir)
    return (
        match_rules(events, chosen, telemetry_fields(events), ["user_id"])
        .groupBy("rule", "user_id").agg(F.count(F.lit(1)).alias("hits"))
    )


OBS_COLUMNS = ("case_id", "rule", "detection_hits", "first_us", "telemetry_hits", "baseline_hits")


def case_hits_attributed(spark, sf_dir):
    return observed(spark, sf_dir).select(*OBS_COLUMNS)


def case_hits_interval(spark, sf_dir):
    return observed(spark, sf_dir, attributed=False).select(*OBS_COLUMNS)


def case_hits_pruned(spark, sf_dir):
    """The cases of the latest run, from events stored by day and source: other days aren't opened.

    Their windows reach into the days around it, quiet windows included.
    """
    place = f"{shared_folder(spark).rstrip('/')}/proofgrid/clustered/{uuid.uuid4().hex}"
    clustered.write_events(table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))), place)
    events = clustered.read_events(spark, place).withColumn("doc", F.try_parse_json("props"))
    latest = clustered.read_events(spark, place).agg(F.max("day")).scalar()
    cases = planned(events.filter(F.col("day") == latest))
    near = on_days(events, cases.select((F.col("lo") - QUIET_US).alias("lo"), "hi"))
    marked = measure_rules(near, RULES, telemetry_fields(near), ["user_id", "us"])
    quiet = Baseline(F.col("lo") - QUIET_US, F.col("lo") - 1, F.col("user_id"))
    return observe(cases, marked, RULES, quiet, "user_id", RESULT_CAP).select(*OBS_COLUMNS)


PRUNED_SQL = "WITH " + ",\n".join([EV, RULE_ROWS, HITS, PROBES, CASES, obs_sql()]) + """
SELECT case_id, rule, detection_hits, first_us, telemetry_hits, baseline_hits FROM obs
WHERE day = (SELECT max(CAST(ts AS DATE)) FROM events)"""


def obs_query(attributed: bool) -> str:
    return "WITH " + ",\n".join([EV, RULE_ROWS, HITS, PROBES, CASES, obs_sql(attributed)]) + """
SELECT case_id, rule, detection_hits, first_us, telemetry_hits, baseline_hits FROM obs"""


def event_attribution_earliest(spark, sf_dir):
    """Every event given to one signup window of its host: the earliest start that covers it."""
    events = telemetry(spark, sf_dir).select("event_id", "user_id", "us", "event_type")
    windows = events.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("window_id"), "user_id", F.col("us").alias("anchor_us"),
        (F.col("us") - 3_600_000_000).alias("lo"), (F.col("us") + 172_800_000_000).alias("hi"),
    )
    owned = attribute_events(events, windows, ["user_id"], ["window_id", "anchor_us"])
    return owned.select("event_id", "window_id", (F.col("us") - F.col("anchor_us")).alias("offset_us"))


ATTRIBUTION_SQL = """
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type FROM events),
w AS (SELECT event_id AS window_id, user_id, us AS anchor_us, us - 3600000000 AS lo, us + 172800000000 AS hi
      FROM e WHERE event_type = 'signup'),
j AS (SELECT e.event_id, w.window_id, e.us - w.anchor_us AS offset_us,
             row_number() OVER (PARTITION BY e.event_id ORDER BY w.lo, w.window_id) AS n
      FROM e JOIN w ON w.user_id = e.user_id AND e.us BETWEEN w.lo AND w.hi)
SELECT event_id, window_id, offset_us FROM j WHERE n = 1
"""


def classify_three_state(spark, sf_dir):
    return results(spark, sf_dir).groupBy("rule", "outcome").agg(
        F.count(F.lit(1)).alias("cases"),
        F.sum("detection_hits").alias("hits"),
        F.sum("telemetry_hits").alias("probe_hits"),
        F.max("latency").alias("max_latency_seen"),
    )


def case_status(spark, sf_dir):
    return results(spark, sf_dir).select("case_id", "outcome", "status", "confidence", "latency", "breached", "noisy", "gap")


def confidence_notes(spark, sf_dir):
    return results(spark, sf_dir).select(
        "case_id", "confidence", F.size("notes").alias("n_notes"), F.array_join("notes", " / ").alias("notes")
    )


NOTES_SQL = """,
n AS (SELECT *, list_filter([
    CASE WHEN outcome = 'visible' THEN telemetry_hits || ' source event(s) seen, none matched by the rule' END,
    CASE WHEN outcome = 'blind' THEN 'no source event seen in the test window' END,
    CASE WHEN confidence = 'medium' THEN 'results were capped, so the latency is uncertain' END,
    CASE WHEN baseline_hits > 0 THEN baseline_hits || ' quiet-window hit(s)' END
  ], lambda x: x IS NOT NULL) AS l FROM res WHERE latency IS NULL OR latency <= max_latency
  UNION ALL SELECT *, list_filter([
    CASE WHEN confidence = 'medium' THEN 'results were capped, so the latency is uncertain' END,
    'detected after ' || printf('%.0f', latency) || 's against a ' || printf('%.0f', max_latency) || 's budget',
    CASE WHEN baseline_hits > 0 THEN baseline_hits || ' quiet-window hit(s)' END
  ], lambda x: x IS NOT NULL) AS l FROM res WHERE latency > max_latency)
SELECT case_id, confidence, len(l) AS n_notes, array_to_string(l, ' / ') AS notes FROM n"""


def latency_percentiles(spark, sf_dir):
    return exact_percentiles(results(spark, sf_dir), ["rule"], "latency", {"p50": 50, "p95": 95})


PERCENTILE_CTE = """
lat AS (SELECT {key} AS g, list_sort(list(CAST(round(latency * 1000) AS BIGINT))) AS l, count(*) AS n
        FROM res WHERE latency IS NOT NULL GROUP BY 1),
pct AS (SELECT g,
  ((l[50*(n-1)//100 + 1] * (100 - (50*(n-1)) % 100) + l[least(50*(n-1)//100 + 2, n)] * ((50*(n-1)) % 100) + 50) // 100) / 1000.0 AS p50,
  ((l[95*(n-1)//100 + 1] * (100 - (95*(n-1)) % 100) + l[least(95*(n-1)//100 + 2, n)] * ((95*(n-1)) % 100) + 50) // 100) / 1000.0 AS p95
  FROM lat)"""


def run_summary(spark, sf_dir):
    """One summary per run (day)."""
    return coverage.run_summary(cut_lineage(results(spark, sf_dir)), ("day",))


SUMMARY_SQL = with_results(
    """
SELECT s.*, t.techniques_total, t.techniques_covered, p50 AS latency_p50, p95 AS latency_p95 FROM (
SELECT day, count(*) AS total,
  """
    + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in V.OUTCOMES)
    + ", "
    + ", ".join(f"count(*) FILTER (status = '{s}') AS status_{s}" for s in V.STATUSES)
    + ", "
    + ", ".join(
        f"count(*) FILTER (severity = '{s}' AND outcome <> 'detected') AS severity_{s}" for s in V.SEVERITIES
    )
    + """, count(*) FILTER (baseline_hits > 0) AS noisy_rules, count(*) AS scoreable,
  count(*) FILTER (outcome = 'detected') / count(*)::DOUBLE AS detection_rate,
  count(*) FILTER (outcome <> 'blind') / count(*)::DOUBLE AS visibility_rate
FROM res GROUP BY day) s LEFT JOIN pct ON g = s.day
JOIN (SELECT day, count(DISTINCT technique) AS techniques_total,
             count(DISTINCT technique) FILTER (outcome = 'detected') AS techniques_covered
      FROM res JOIN attack USING (rule) GROUP BY day) t USING (day)
""",
    PERCENTILE_CTE.format(key="day"),
)


def evidence_topk(spark, sf_dir):
    """The first three matching events of every case."""
    events = telemetry(spark, sf_dir)
    found = match_rules(events, RULES, telemetry_fields(events), ["event_id", "user_id", "us", "value"])
    windows = planned(events).select("case_id", "rule", "user_id", "lo", "hi")
    return first_in_windows(found, windows, ["rule", "user_id"], 3, "event_id").select(
        "case_id", "place", "event_id", "value"
    )


def evidence_summary(spark, sf_dir):
    """Matching events shortened to the rule's fields, or to the first flat fields."""
    events = telemetry(spark, sf_dir)
    fields = telemetry_fields(events)
    brief = events.select(
        "event_id",
        F.when(F.col("event_type") == "error", capture.summary(fields, ["K", "value", "CommandLine"]))
        .otherwise(capture.summary(fields, ["CommandLine"]))
        .alias("summary"),
    )
    entries = F.transform(F.map_entries("summary"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return brief.select("event_id", F.array_join(entries, ";").alias("summary"))


EVIDENCE_SUMMARY_SQL = """
SELECT event_id, CASE event_type WHEN 'error' THEN 'K=' || json_extract_string(props, '$.k') || ';value=' || CAST(value AS VARCHAR)
  ELSE 'k=' || json_extract_string(props, '$.k') END AS summary FROM events
"""

EVIDENCE_SQL = with_results(
    """
SELECT case_id, place, event_id, value FROM (
  SELECT c.case_id, x.event_id, x.value, CAST(row_number() OVER (PARTITION BY c.case_id ORDER BY x.us, x.event_id) AS INTEGER) AS place
  FROM cases c JOIN hits x ON x.rule = c.rule AND x.user_id = c.user_id AND x.us BETWEEN c.lo AND c.hi) WHERE place <= 3
"""
)


def result_cap(spark, sf_dir):
    """Per rule and host: what a search capped at ten events would keep."""
    found = matches(spark, sf_dir, ("event_id", "user_id"))
    totals = capture.result_cap(found, ["rule", "user_id"], 10)
    kept = capture.capped_events(found, ["rule", "user_id"], "event_id", 10).groupBy("rule", "user_id").agg(
        F.max("event_id").alias("last_kept")
    )
    return totals.join(kept, ["rule", "user_id"])


ACCEPTED = (("web", "error-burst", 40), ("web", "view-any", 2), ("other", "click-odd", 99))


def accepted_noise(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ACCEPTED, "profile string, rule string, max_hits int")


def noise_findings(spark, sf_dir):
    return noise.noise_findings(results(spark, sf_dir), accepted_noise(spark))


NOISE_SQL = with_results(
    """
SELECT f.rule, f.baseline_hits AS hits, coalesce(max_hits, 0)::BIGINT AS allowance,
       f.baseline_hits - coalesce(max_hits, 0) AS excess, f.severity, f.profile, f.outcome
FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY test_id, case_id) AS n FROM res WHERE baseline_hits > 0) f
LEFT JOIN accepted a ON a.rule = f.rule AND a.profile = f.profile
WHERE f.n = 1 AND f.baseline_hits > coalesce(max_hits, 0)
""",
    "accepted(profile, rule, max_hits) AS (VALUES " + ", ".join(f"('{p}', '{r}', {m})" for p, r, m in ACCEPTED) + ")",
)


def baseline_noise(spark, sf_dir):
    return results(spark, sf_dir).groupBy("rule").agg(
        F.count_if("noisy").alias("noisy_cases"), F.sum("baseline_hits").alias("baseline_hits"), F.max("baseline_hits").alias("worst")
    )


SETTINGS = gates.GateSettings(
    min_severity="high", min_detection_rate=0.9, min_visibility_rate=0.2, fail_on_noise=True, fail_on_latency_breach=True
)


def gate_rows(spark, sf_dir):
    found = cut_lineage(results(spark, sf_dir))
    out = gates.evaluate_gates(found, SETTINGS, noise=noise.noise_findings(found, accepted_noise(spark)))
    return out.select(
        "gate", "applicable", "passed", "n", "accepted", "target", F.round("actual", 9).alias("actual"),
        F.array_join("offenders", ",").alias("offenders"),
    )


GATES_SQL = with_results(
    """
SELECT g.gate, g.applicable,
  CASE WHEN g.target IS NULL THEN coalesce(s.n, 0) = 0 ELSE NOT (g.applicable AND r.actual < g.target) OR coalesce(s.n, 0) = 0 END AS passed,
  coalesce(s.n, 0) AS n, coalesce(a.n, 0) AS accepted, g.target, round(r.actual, 9) AS actual,
  coalesce(CASE WHEN coalesce(s.n, 0) > 0 THEN s.offenders WHEN r.actual < g.target THEN a.offenders END, '') AS offenders
FROM (VALUES ('no-errors', true, NULL), ('expectations-met', true, NULL), ('no-regressions', false, NULL),
      ('detection-rate', true, 0.9::DOUBLE), ('visibility-rate', true, 0.2::DOUBLE), ('noise-budget', true, NULL),
      ('latency-budget', true, NULL), ('coverage-targets', false, NULL)) g(gate, applicable, target)
LEFT JOIN side s ON s.gate = g.gate LEFT JOIN side a ON a.gate = g.gate || '/accepted'
LEFT JOIN (SELECT 'detection-rate' AS gate, count(*) FILTER (outcome = 'detected') / count(*)::DOUBLE AS actual FROM res
           UNION ALL SELECT 'visibility-rate', count(*) FILTER (outcome <> 'blind') / count(*)::DOUBLE FROM res) r ON r.gate = g.gate
""",
    """
accepted(profile, rule, max_hits) AS (VALUES """ + ", ".join(f"('{p}', '{r}', {m})" for p, r, m in ACCEPTED) + """),
marks AS (
  SELECT 'expectations-met' AS gate, rule || '/' || test_id AS o, 0::DOUBLE AS a, rule AS b, test_id AS c FROM res WHERE status = 'fail' AND s_rank >= 3
  UNION ALL SELECT 'detection-rate', rule || '/' || test_id, 0, rule, test_id FROM res WHERE outcome = 'visible' AND status <> 'pass'
  UNION ALL SELECT 'detection-rate/accepted', rule || '/' || test_id, 0, rule, test_id FROM res WHERE outcome = 'visible' AND status = 'pass'
  UNION ALL SELECT 'visibility-rate', rule || '/' || test_id, 0, rule, test_id FROM res WHERE outcome = 'blind' AND status <> 'pass'
  UNION ALL SELECT 'visibility-rate/accepted', rule || '/' || test_id, 0, rule, test_id FROM res WHERE outcome = 'blind' AND status = 'pass'
  UNION ALL SELECT 'latency-budget', rule || '/' || test_id, 0, rule, test_id FROM res WHERE latency > max_latency AND s_rank >= 3
  UNION ALL SELECT 'noise-budget', f.rule, -(f.baseline_hits - coalesce(max_hits, 0)), f.rule, '' FROM
    (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY test_id, case_id) AS n FROM res WHERE baseline_hits > 0) f
    LEFT JOIN accepted x ON x.rule = f.rule AND x.profile = f.profile
    WHERE f.n = 1 AND f.baseline_hits > coalesce(max_hits, 0) AND f.s_rank >= 3),
side AS (SELECT gate, max(t) AS n, string_agg(o, ',' ORDER BY n) FILTER (n <= 20) AS offenders FROM
  (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY a, b, c) AS n, count(*) OVER (PARTITION BY gate) AS t FROM marks) GROUP BY gate)""",
)

def case_ids_unique(spark, sf_dir):
    """Every case of the run has an id of its own."""
    cases = planned(telemetry(spark, sf_dir)).select(case_id(F.lit("run"), F.col("rule"), F.col("test_id")).alias("id"), "rule")
    return cases.groupBy("rule").agg(F.count("*").alias("cases"), F.count_distinct("id").alias("ids"))


CASE_IDS_SQL = "WITH " + ",\n".join([EV, RULE_ROWS, HITS, PROBES, CASES]) + """
SELECT rule, count(*) AS cases, count(DISTINCT case_id) AS ids FROM cases GROUP BY rule"""


def case_hits_null_host(spark, sf_dir):
    """Cases of which every third has no host: nothing can match them, so they are blind, not missing."""
    events = telemetry(spark, sf_dir)
    marked = measure_rules(events, RULES, telemetry_fields(events), ["user_id", "us"])
    cases = planned(events).withColumn("user_id", F.when(F.col("signup_id") % 3 > 0, F.col("user_id")))
    seen = observe(cases, marked, RULES, attribution="user_id")
    return seen.select("case_id", "detection_hits", "telemetry_hits", "first_us")


NULL_HOST_SQL = "WITH " + ",\n".join([EV, RULE_ROWS, HITS, PROBES, CASES, obs_sql(True)]) + """
SELECT case_id, CASE WHEN signup_id % 3 > 0 THEN detection_hits ELSE 0 END AS detection_hits,
  CASE WHEN signup_id % 3 > 0 THEN telemetry_hits ELSE 0 END AS telemetry_hits,
  CASE WHEN signup_id % 3 > 0 THEN first_us END AS first_us
FROM obs"""

QUERIES = {
    "case_ids_unique": Query(case_ids_unique, CASE_IDS_SQL),
    "case_hits_null_host": Query(case_hits_null_host, NULL_HOST_SQL),
    "multi_rule_scan": Query(multi_rule_scan, with_events("SELECT event_id, user_id, rule FROM hits")),
    "rule_hit_counts": Query(
        rule_hit_counts,
        with_events("SELECT rule, count(*) AS hits, count(DISTINCT user_id) AS hosts, max(value) AS top_value FROM hits GROUP BY rule"),
    ),
    "case_plan": Query(case_plan, CASE_PLAN_SQL),
    "rule_select": Query(
        rule_select,
        with_events("SELECT rule, user_id, count(*) AS hits FROM hits WHERE rule IN ('error-burst', 'mixed-pair') GROUP BY 1, 2"),
    ),
    "case_hits_attributed": Query(case_hits_attributed, obs_query(True)),
    "case_hits_interval": Query(case_hits_interval, obs_query(False)),
    "case_hits_pruned": Query(case_hits_pruned, PRUNED_SQL),
    "event_attribution_earliest": Query(event_attribution_earliest, ATTRIBUTION_SQL),
    "classify_three_state": Query(
        classify_three_state,
        with_results(
            """SELECT rule, outcome, count(*) AS cases, sum(detection_hits)::BIGINT AS hits,
            sum(telemetry_hits)::BIGINT AS probe_hits, max(latency) AS max_latency_seen FROM res GROUP BY 1, 2"""
        ),
    ),
    "case_status": Query(
        case_status,
        with_results(
            """SELECT case_id, outcome, status, confidence, latency, coalesce(latency > max_latency, false) AS breached,
            baseline_hits > 0 AS noisy,
            CASE outcome WHEN 'visible' THEN 'detection' WHEN 'blind' THEN 'visibility' END AS gap FROM res"""
        ),
    ),
    "confidence_notes": Query(confidence_notes, with_results(NOTES_SQL).replace("res1)\n,", "res1),")),
    "latency_percentiles": Query(
        latency_percentiles,
        with_results("SELECT g AS rule, p50, p95 FROM pct", PERCENTILE_CTE.format(key="rule")),
    ),
    "run_summary": Query(run_summary, SUMMARY_SQL),
    "evidence_topk": Query(evidence_topk, EVIDENCE_SQL),
    "evidence_summary": Query(evidence_summary, EVIDENCE_SUMMARY_SQL),
    "result_cap": Query(
        result_cap,
        with_events(
            """SELECT rule, user_id, max(t) AS total, least(max(t), 10) AS kept, max(t) > 10 AS truncated,
            max(event_id) FILTER (n <= 10) AS last_kept FROM (SELECT *, count(*) OVER (PARTITION BY rule, user_id) AS t,
            row_number() OVER (PARTITION BY rule, user_id ORDER BY event_id) AS n FROM hits) GROUP BY 1, 2"""
        ),
    ),
    "baseline_noise": Query(
        baseline_noise,
        with_results(
            """SELECT rule, count(*) FILTER (baseline_hits > 0) AS noisy_cases, sum(baseline_hits)::BIGINT AS baseline_hits,
            max(baseline_hits) AS worst FROM res GROUP BY rule"""
        ),
    ),
    "noise_findings": Query(noise_findings, NOISE_SQL),
    "gates": Query(gate_rows, GATES_SQL),
}
