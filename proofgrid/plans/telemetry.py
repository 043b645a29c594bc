"""How the benchmark tables stand in for telemetry, rules, tests and content.

events are telemetry (user_id is the host, event_type the log source, props a JSON
document); every signup is an emulated test of that host; its day is the run.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.fields import EventFields
from proofgrid.operators.cases import Baseline, classify, observe, search_window
from proofgrid.operators.rules import Rule, Ruleset, Source, measure_rules

RESULT_CAP = 3
QUIET_US = 3_600_000_000


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # Times without a zone are UTC, whatever the session was started with.
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with UTC time, microseconds and the parsed document; unused columns are pruned."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select(
        "event_id",
        ts.alias("ts"),
        F.unix_micros(ts).alias("us"),
        "user_id",
        "event_type",
        "value",
        F.try_parse_json("props").alias("doc"),
    )


def telemetry_fields(events: DataFrame) -> EventFields:
    """Field lookup with the documented shape of props, so no discovery pass is needed."""
    return EventFields.of(events, "doc", [("k",)], columns=["event_type", "value", "user_id"])


SOURCES = {
    name: Source(name, {"event_type|cased": name}, ("value", "k"), *policy)
    for name, policy in {
        "error": (86400.0, 2.0),
        "purchase": (None, None),
        "view": (43200.0, None),
        "click": (86400.0, 3.0),
        "signup": (172800.0, 1.5),
    }.items()
}


def _rule(name, severity, status, techniques, telemetry, expected, max_latency, detection, **more) -> Rule:
    return Rule.from_document(
        {
            "id": f"id-{name}" if name != "view-any" else "",
            "name": name,
            "title": name.replace("-", " ").title(),
            "severity": severity,
            "status": status,
            "attack": [{"id": t, "tactic": tactic} for t, tactic in techniques],
            "platforms": ["web"] if name != "mixed-pair" else ["web", "app"],
            "telemetry": telemetry,
            "tags": [severity, "all"],
            "detection": detection,
            "validation": {"emulation": ["signup"], "expect": expected, "max_latency": max_latency},
            "tuning": {"baseline_profile": "web" if name in ("error-burst", "view-any") else "", "expected_daily_volume": 25},
            **more,
        }
    )


RULES = Ruleset(
    (
        _rule(
            "click-odd", "medium", "test", [("T1003.001", None)], ["click"], "visible", "1h",
            {"sel": {"event_type|cased": "click", "k|gte": 50}, "filter": {"value|lt": 20}, "condition": "sel and not filter"},
        ),
        _rule(
            "error-burst", "high", "production", [("T1001.001", "collection"), ("T1003", "impact")], ["error"],
            "detected", "1h", {"sel": {"event_type|cased": "error", "value|gt": 50}, "condition": "sel"},
        ),
        _rule(
            "mixed-pair", "high", "experimental", [("T1002", "impact"), ("T1003.001", "discovery")],
            ["error", "purchase"], "blind", "6h",
            {
                "sel_low": {"event_type|cased": "error", "k|lt": 10},
                "sel_high": {"event_type|cased": "purchase", "k|gte": 90},
                "condition": "1 of sel_*",
            },
        ),
        _rule(
            "purchase-spike", "critical", "production", [("T1002", "impact")], ["purchase"], "detected", "1d",
            {"sel": {"event_type|cased": "purchase", "value|gt": 100}, "condition": "sel"},
        ),
        _rule(
            "view-any", "low", "deprecated", [("T1001", "collection"), ("T1004", None)], ["view"], "detected", "2h",
            {"sel": {"event_type|cased": "view", "value|gte": 0}, "unused": {"k": 1}, "condition": "sel"}, extra="x",
        ),
    ),
    SOURCES,
)

CASE_COLUMNS = (
    "rule", "severity", "expected", "max_latency", "techniques", "tactics", "telemetry", "baseline_profile"
)


def rule_structs(ruleset: Ruleset = RULES) -> "F.Column":
    """The library as an array of structs for `inline`; it is as small as the plan itself."""
    parts = []
    for r in ruleset.rules:
        attack = F.array(
            *[
                F.struct(F.lit(t).alias("technique"), F.lit(tac).cast("string").alias("tactic"))
                for t, tac in r.attack
            ]
        )
        parts.append(
            F.struct(
                F.lit(r.name).alias("rule"),
                F.lit(r.severity).alias("severity"),
                F.lit(r.expected).alias("expected"),
                F.lit(r.max_latency).alias("max_latency"),
                attack.alias("attack"),
                F.array(*map(F.lit, r.telemetry)).alias("telemetry"),
                F.lit(r.baseline_profile).alias("baseline_profile"),
            )
        )
    return F.array(*parts)


def planned(events: DataFrame, ruleset: Ruleset = RULES) -> DataFrame:
    """Cases: every rule against every signup, with its search window and quiet window."""
    tests = events.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("signup_id"), "user_id", F.col("us").alias("started_us")
    )
    cases = tests.select("*", F.inline(rule_structs(ruleset)))
    lo, hi = search_window(F.col("started_us"), F.col("started_us"), F.col("max_latency"))
    return cases.select(
        F.concat_ws("/", "rule", "signup_id").alias("case_id"),
        F.col("signup_id").cast("string").alias("test_id"),
        "*",
        lo.alias("lo"),
        hi.alias("hi"),
        F.to_date(F.timestamp_micros("started_us")).alias("day"),
    )


def observed(spark: SparkSession, sf_dir: str, attributed: bool = True) -> DataFrame:
    events = telemetry(spark, sf_dir)
    marked = measure_rules(events, RULES, telemetry_fields(events), ["user_id", "us"])
    quiet = Baseline(F.col("lo") - QUIET_US, F.col("lo") - 1, F.col("user_id"))
    return observe(
        planned(events), marked, RULES, quiet, "user_id" if attributed else None, RESULT_CAP
    )


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified cases of the attributed run."""
    live = observed(spark, sf_dir).withColumns({"mode": F.lit("live"), "executed": F.lit(True)})
    return classify(live)


# ----------------------------------------------------------------- SQL side

EV = """
ev AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value,
              CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"""

MATCH = {
    "click-odd": "event_type = 'click' AND k >= 50 AND NOT value < 20",
    "error-burst": "event_type = 'error' AND value > 50",
    "mixed-pair": "(event_type = 'error' AND k < 10) OR (event_type = 'purchase' AND k >= 90)",
    "purchase-spike": "event_type = 'purchase' AND value > 100",
    "view-any": "event_type = 'view' AND value >= 0",
}
SCOPE = {r.name: "event_type IN (" + ", ".join(f"'{t}'" for t in r.telemetry) + ")" for r in RULES.rules}

RULE_ROWS = "rules(rule, severity, expected, max_latency, profile) AS (VALUES " + ", ".join(
    f"('{r.name}', '{r.severity}', '{r.expected}', CAST({r.max_latency} AS DOUBLE), '{r.baseline_profile}')"
    for r in RULES.rules
) + ")"

ATTACK_ROWS = "attack(rule, pos, technique, tactic) AS (VALUES " + ", ".join(
    f"('{r.name}', {i}, '{t}', {repr(tac) if tac else 'NULL'})" for r in RULES.rules for i, (t, tac) in enumerate(r.attack)
) + ")"

HITS = "hits AS (" + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, event_id, user_id, us, ts, value FROM ev WHERE {where}" for rule, where in MATCH.items()
) + ")"
PROBES = "probes AS (" + " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, user_id, us FROM ev WHERE {where}" for rule, where in SCOPE.items()
) + ")"

CASES = """
cases AS (
  SELECT r.rule || '/' || e.event_id AS case_id, CAST(e.event_id AS VARCHAR) AS test_id, e.event_id AS signup_id,
         r.rule, r.severity, r.expected, r.max_latency, r.profile, e.user_id, e.us AS started_us,
         e.us - 120000000 AS lo,
         e.us + CAST((greatest(300, r.max_latency) + 60) * 1000000 AS BIGINT) AS hi,
         CAST(e.ts AS DATE) AS day
  FROM rules r, ev e WHERE e.event_type = 'signup')"""


def obs_sql(attributed: bool = True) -> str:
    own = "AND x.user_id = c.user_id" if attributed else ""
    return f"""
h AS (SELECT c.case_id, count(*) AS n, min(x.us) AS first_us FROM cases c JOIN hits x
      ON x.rule = c.rule {own} AND x.us BETWEEN c.lo AND c.hi GROUP BY 1),
p AS (SELECT c.case_id, count(*) AS n FROM cases c JOIN probes x
      ON x.rule = c.rule {own} AND x.us BETWEEN c.lo AND c.hi GROUP BY 1),
b AS (SELECT c.case_id, count(*) AS n FROM cases c JOIN hits x
      ON x.rule = c.rule {own} AND x.us BETWEEN c.lo - {QUIET_US} AND c.lo - 1 GROUP BY 1),
obs AS (SELECT c.*, coalesce(h.n, 0) AS detection_hits, h.first_us, coalesce(p.n, 0) AS telemetry_hits,
               coalesce(b.n, 0) AS baseline_hits
        FROM cases c LEFT JOIN h USING (case_id) LEFT JOIN p USING (case_id) LEFT JOIN b USING (case_id))"""


RES = f"""
res0 AS (SELECT *,
  CASE WHEN detection_hits > 0 THEN 'detected' WHEN telemetry_hits > 0 THEN 'visible' ELSE 'blind' END AS outcome,
  CASE WHEN detection_hits > {RESULT_CAP} OR telemetry_hits > {RESULT_CAP} THEN 'medium' ELSE 'high' END AS confidence,
  CASE WHEN first_us >= started_us THEN ((first_us - started_us + 500) // 1000) / 1000.0 END AS latency
  FROM obs),
res1 AS (SELECT *,
  CASE outcome WHEN 'blind' THEN 0 WHEN 'visible' THEN 1 ELSE 2 END AS o_rank,
  CASE expected WHEN 'blind' THEN 0 WHEN 'visible' THEN 1 ELSE 2 END AS e_rank,
  CASE severity WHEN 'informational' THEN 0 WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END AS s_rank
  FROM res0),
res AS (SELECT *, CASE WHEN o_rank > e_rank THEN 'unexpected_pass' WHEN o_rank = e_rank THEN 'pass' ELSE 'fail' END AS status
  FROM res1)"""


def with_results(body: str, *more: str) -> str:
    parts = [EV, RULE_ROWS, ATTACK_ROWS, HITS, PROBES, CASES, obs_sql(), RES, *more]
    return "WITH " + ",\n".join(parts) + "\n" + body


def with_events(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([EV, RULE_ROWS, HITS, *more]) + "\n" + body
