"""Queries: runs by day and segment, diffs, latest outcomes, scores.

A run is a day of one profile (the host's market segment). A host may be tested several
times in a run; its last case stands, as the later of two results with one key does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.operators import coverage, gates, noise, scorecard
from proofgrid.operators import history as H
from proofgrid.plans.telemetry import RULES, Query, results, table, with_results
from proofgrid.session import cut_lineage


def case_history(spark: SparkSession, sf_dir: str, classified: DataFrame | None = None) -> DataFrame:
    """Last result of every (run, rule, host). Written once: several steps read it."""
    segments = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("profile")
    )
    found = (results(spark, sf_dir) if classified is None else classified).join(segments, "user_id")
    columns = ("outcome", "status", "latency", "severity", "baseline_hits", "started_us")
    # The host leads: it tells most groups apart, so the aggregate's sorts rarely look at the other keys.
    last = found.groupBy("user_id", "rule", "day", "profile").agg(F.max_by(F.struct(*columns), F.struct("started_us", "signup_id")).alias("last"))
    rows = last.select(
        F.concat_ws("/", "profile", "day").alias("run_id"), "profile", F.col("day").cast("timestamp").alias("started_at"), "day", "rule",
        F.col("user_id").cast("string").alias("test_id"), "last.*",
    )
    return cut_lineage(rows)


def runs_of(history: DataFrame) -> DataFrame:
    return history.select("run_id", "profile", "started_at").distinct()


HIST = """
hist AS (SELECT run_id, profile, day, rule, test_id, outcome, status, latency, severity, baseline_hits FROM (
  SELECT c_mktsegment || '/' || day AS run_id, c_mktsegment AS profile, day, rule, CAST(user_id AS VARCHAR) AS test_id, outcome,
    status, latency, severity, baseline_hits,
    row_number() OVER (PARTITION BY c_mktsegment, day, rule, user_id ORDER BY started_us DESC, signup_id DESC) AS n
  FROM res JOIN customer ON c_custkey = user_id) WHERE n = 1),
runs AS (SELECT DISTINCT run_id, profile, day FROM hist),
prev AS (SELECT *, lag(run_id) OVER (PARTITION BY profile ORDER BY day) AS previous_run_id FROM runs),
latest AS (SELECT *, rank() OVER (PARTITION BY rule, test_id ORDER BY day DESC) AS n FROM hist)"""

DIFF = """
pairs AS (SELECT coalesce(n.run_id, b.run_id) AS run_id, coalesce(n.rule, b.rule) AS rule, coalesce(n.test_id, b.test_id) AS test_id,
    b.outcome AS "before", n.outcome AS "after", b.latency AS before_latency, n.latency AS after_latency,
    coalesce(n.severity, b.severity) AS severity
  FROM (SELECT h.* FROM hist h JOIN prev p USING (run_id)
        WHERE previous_run_id IS NOT NULL OR outcome IN ('visible', 'blind')) n
  FULL JOIN (SELECT p.run_id, h.rule, h.test_id, h.outcome, h.latency, h.severity
             FROM hist h JOIN prev p ON p.previous_run_id = h.run_id) b
  ON n.run_id = b.run_id AND n.rule = b.rule AND n.test_id = b.test_id),
ranked AS (SELECT *, list_position(['blind', 'visible', 'detected'], "before") AS o, list_position(['blind', 'visible', 'detected'], "after") AS w FROM pairs),
deltas AS (SELECT *, CASE WHEN "before" IS NULL THEN 'new' WHEN "after" IS NULL THEN 'removed' WHEN w < o THEN 'regression'
    WHEN w > o THEN 'improvement' WHEN "after" = 'detected' AND before_latency <> 0 AND after_latency > greatest(2 * before_latency, 30)
    THEN 'slower' ELSE 'unchanged' END AS kind FROM ranked)"""


def run_diff(spark, sf_dir):
    past = case_history(spark, sf_dir)
    return H.diff_history(past, H.previous_runs(runs_of(past)))


RUN_DIFF_SQL = with_results(
    """
SELECT run_id, rule, test_id, kind, "before", "after", before_latency, after_latency, severity,
  CASE WHEN kind = 'regression' AND "after" = 'blind' THEN 'source went dark'
       WHEN kind = 'regression' THEN 'source present, rule no longer matches'
       WHEN kind = 'new' THEN 'first result of this case' WHEN kind = 'slower' THEN 'detected much later than before'
       WHEN kind = 'removed' THEN 'no longer planned' ELSE '' END AS note
FROM deltas WHERE kind <> 'unchanged'""",
    HIST,
    DIFF,
)


def diff_counts(spark, sf_dir):
    past = case_history(spark, sf_dir)
    return H.diff_counts(H.diff_history(past, H.previous_runs(runs_of(past)), include_unchanged=True), ("run_id",))


DIFF_COUNTS_SQL = with_results(
    f"""
SELECT r.run_id, k.kind, count(d.kind) AS n FROM (SELECT DISTINCT run_id FROM deltas) r
CROSS JOIN (VALUES {", ".join(f"('{k}')" for k in V.DELTA_KINDS)}) k(kind)
LEFT JOIN deltas d ON d.run_id = r.run_id AND d.kind = k.kind GROUP BY 1, 2""",
    HIST,
    DIFF,
)


def previous_run(spark, sf_dir):
    return H.previous_runs(runs_of(case_history(spark, sf_dir))).select("run_id", "profile", "previous_run_id")


def run_list(spark, sf_dir):
    """The ten newest runs of a profile, and the latest of every profile."""
    runs = runs_of(case_history(spark, sf_dir))
    newest = H.list_runs(runs, 10, profile="BUILDING").select(F.lit("list").alias("kind"), "run_id")
    return newest.unionByName(H.latest_run(runs).select(F.lit("latest").alias("kind"), "run_id"))


RUN_LIST_SQL = with_results(
    """
SELECT 'list' AS kind, run_id FROM (SELECT run_id FROM runs WHERE profile = 'BUILDING' ORDER BY day DESC LIMIT 10)
UNION ALL SELECT 'latest', max_by(run_id, day) FROM runs GROUP BY profile""",
    HIST,
)


def latest_outcome(spark, sf_dir):
    return H.latest_outcomes(case_history(spark, sf_dir)).select("rule", "test_id", "run_id", "outcome", "status")


def worst_outcome(spark, sf_dir):
    return H.worst_outcomes(case_history(spark, sf_dir))


def rule_history(spark, sf_dir):
    return H.rule_history(case_history(spark, sf_dir), 30).select("rule", "position", "run_id", "test_id", "outcome", "latency")


RULE_HISTORY_SQL = with_results(
    """
SELECT rule, CAST(row_number() OVER (PARTITION BY rule ORDER BY n DESC) AS INTEGER) AS position, run_id, test_id, outcome, latency FROM (
  SELECT *, row_number() OVER (PARTITION BY rule ORDER BY day DESC, run_id DESC, test_id DESC) AS n FROM hist) WHERE n <= 30""",
    HIST,
)


def logic_changes(spark, sf_dir):
    """Documents as rules: the hash of the whole text as the fingerprint, every source as a run after the one before."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("lang").alias("rule"), F.sha2("text", 256).alias("fingerprint"), F.expr("cast(substr(source, 4) as int)").alias("run")
    )
    runs = docs.select("run").distinct()
    before = docs.withColumn("run", F.col("run") + 1)
    pairs = runs.join(runs.select((F.col("run") + 1).alias("run")), "run")
    return H.logic_changes(docs.join(pairs, "run"), before.join(pairs, "run"), ["run"])


LOGIC_SQL = """
WITH d AS (SELECT CAST(substr(source, 4) AS INTEGER) AS run, lang AS rule, sha256(text) AS fingerprint FROM documents),
p AS (SELECT DISTINCT run FROM d WHERE run - 1 IN (SELECT run FROM d)),
a AS (SELECT * FROM d WHERE run IN (FROM p)), b AS (SELECT run + 1 AS run, rule, fingerprint FROM d WHERE run + 1 IN (FROM p))
SELECT *, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT *, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
"""


def duplicate_ids(spark, sf_dir):
    """Documents that share one text, named by the hash of the whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("text_id"))
    return H.duplicate_keys(docs, "text_id", "doc_id")


DUPLICATE_SQL = """
SELECT doc_id, sha256(text) AS text_id, n FROM (SELECT *, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1
"""

# Static dimension scores of the library, as the rule table would carry them.
STATIC = {
    "click-odd": (60.0, 100.0, 80.0, 55.0),
    "error-burst": (85.0, 100.0, 100.0, 90.0),
    "mixed-pair": (70.0, 90.0, 95.0, 40.0),
    "purchase-spike": (95.0, 100.0, 100.0, 100.0),
    "view-any": (20.0, 60.0, 75.0, 10.0),
}


def rule_dimension(spark: SparkSession) -> DataFrame:
    rows = [(name, *map(float, scores)) for name, scores in STATIC.items()]
    static = spark.createDataFrame(
        rows, "rule string, robustness double, telemetry_score double, attack_score double, documentation double"
    )
    return RULES.table(spark).drop("telemetry", "attack").join(static, "rule")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = case_history(spark, sf_dir)
    return scorecard.score_rules(rule_dimension(spark), past, [r.name for r in RULES.rules])


SCORE_CTE = f"""
lib(rule, id, status, expected, max_latency, unused, unknown, robustness, telemetry, attack_s, documentation) AS (VALUES {", ".join(
    f"('{r.name}', '{r.id}', '{r.status}', '{r.expected}', {r.max_latency}::DOUBLE, {len(r.unused_selections)}, {len(r.unknown_keys)}, "
    + ", ".join(f"{x}::DOUBLE" for x in STATIC[r.name]) + ")" for r in RULES.rules)}),
seen AS (SELECT run_id, rule, min(list_position(['blind', 'visible', 'detected'], outcome)) AS o, max(latency) AS latency,
         bool_or(baseline_hits > 0) AS noisy FROM hist GROUP BY 1, 2),
dims AS (SELECT r.run_id, l.rule, ['blind', 'visible', 'detected'][s.o] AS outcome,
  greatest(0, least(CASE WHEN l.expected <> 'detected' THEN 50 ELSE 100 END::DOUBLE, 100 - CASE WHEN s.o IS NULL THEN 25 WHEN s.o = 1 THEN 70 WHEN s.o = 2 THEN 55
    WHEN s.latency > l.max_latency THEN 15 ELSE 0 END))::DOUBLE AS validation, robustness, telemetry, attack_s AS attack, documentation,
  greatest(0, 100 - CASE WHEN l.id = '' THEN 25 ELSE 0 END - CASE WHEN unused > 0 THEN 25 ELSE 0 END - CASE WHEN unknown > 0 THEN 10 ELSE 0 END
    - CASE WHEN noisy THEN 40 ELSE 0 END - CASE l.status WHEN 'experimental' THEN 10 WHEN 'deprecated' THEN 30 WHEN 'unsupported' THEN 30 ELSE 0 END)::DOUBLE AS hygiene
  FROM (SELECT DISTINCT run_id FROM hist) r CROSS JOIN lib l LEFT JOIN seen s ON s.run_id = r.run_id AND s.rule = l.rule),
sc0 AS (SELECT *, round((validation * 0.28::DOUBLE + robustness * 0.20::DOUBLE + telemetry * 0.16::DOUBLE + attack * 0.14::DOUBLE
  + documentation * 0.12::DOUBLE + hygiene * 0.10::DOUBLE) / {sum(scorecard.WEIGHTS.values())!r}::DOUBLE, 1) AS total,
  least(validation, robustness, telemetry, attack, documentation, hygiene) AS lowest FROM dims),
sc AS (SELECT *, CASE WHEN validation = lowest THEN 'validation' WHEN robustness = lowest THEN 'robustness' WHEN telemetry = lowest THEN 'telemetry'
  WHEN attack = lowest THEN 'attack' WHEN documentation = lowest THEN 'documentation' ELSE 'hygiene' END AS weakest,
  CASE WHEN total >= 90 THEN 'A' WHEN total >= 80 THEN 'B' WHEN total >= 70 THEN 'C' WHEN total >= 60 THEN 'D' ELSE 'F' END AS grade FROM sc0)"""


def rollup(spark, sf_dir):
    return scorecard.score_rollup(scores(spark, sf_dir))


ROLLUP_SQL = with_results(
    """
SELECT *, CASE WHEN average >= 90 THEN 'A' WHEN average >= 80 THEN 'B' WHEN average >= 70 THEN 'C' WHEN average >= 60 THEN 'D' ELSE 'F' END AS grade
FROM (SELECT run_id, round(avg(total), 1) AS average, """
    + ", ".join(f"count(*) FILTER (grade = '{g}') AS grade_{g.lower()}" for g in "ABCDF")
    + ", "
    + ", ".join(f"round(avg({d}), 1) AS avg_{d}" for d in scorecard.WEIGHTS)
    + ", count(*) FILTER (total < 70) AS below FROM sc GROUP BY run_id)",
    HIST,
    SCORE_CTE,
)

# Content for the full gate evaluation.
GATE_TARGETS = (("impact", 0.8, 0.95, "high"), ("collection", 0.05, 0.1, "critical"), ("credential-access", 0.9, 0.99, "critical"))
FULL = gates.GateSettings(
    min_severity="medium", min_detection_rate=0.01, min_visibility_rate=0.9, fail_on_noise=True, fail_on_latency_breach=True,
    fail_on_coverage_target=True,
)


def gates_full(spark, sf_dir):
    """All eight gates at once: regressions of every run, noise without allowance, tactic targets."""
    found = cut_lineage(results(spark, sf_dir))
    layout = "detected double, visible double, priority string"
    targets = spark.createDataFrame(GATE_TARGETS, f"tactic string, {layout}")
    techniques = coverage.technique_coverage(
        found,
        spark.createDataFrame([("T1003", "Dumping", ["credential-access"])], "technique string, name string, tactics array<string>"),
        spark.createDataFrame([], f"technique string, {layout}"),
        targets,
        spark.createDataFrame([], "technique string, reason string"),
    )
    tactics = coverage.tactic_coverage(
        techniques, spark.createDataFrame([("impact", "Impact", 3), ("collection", "Collection", 2)], "tactic string, name string, order int"), targets
    )
    past = case_history(spark, sf_dir, found)
    # The gates read these twice, to count and to name.
    deltas = cut_lineage(H.diff_history(past, H.previous_runs(runs_of(past))))
    tactics = cut_lineage(tactics)
    loud = noise.noise_findings(found, spark.createDataFrame([], "profile string, rule string, max_hits int"))
    out = gates.evaluate_gates(found, FULL, deltas, tactics, loud)
    return out.select("gate", "applicable", "passed", "n", "accepted", F.array_join("offenders", ",").alias("offenders"))


GATES_FULL_SQL = with_results(
    """
SELECT g.gate, true AS applicable,
  CASE WHEN g.target IS NULL THEN coalesce(s.n, 0) = 0 ELSE r.actual >= g.target OR coalesce(s.n, 0) = 0 END AS passed,
  coalesce(s.n, 0) AS n, coalesce(a.n, 0) AS accepted,
  coalesce(CASE WHEN coalesce(s.n, 0) > 0 THEN s.offenders WHEN r.actual < g.target OR g.gate = 'coverage-targets' THEN a.offenders END, '') AS offenders
FROM (VALUES ('no-errors', NULL), ('expectations-met', NULL), ('no-regressions', NULL), ('detection-rate', 0.01::DOUBLE),
      ('visibility-rate', 0.9::DOUBLE), ('noise-budget', NULL), ('latency-budget', NULL), ('coverage-targets', NULL)) g(gate, target)
LEFT JOIN side s ON s.gate = g.gate LEFT JOIN side a ON a.gate = g.gate || '/accepted'
LEFT JOIN (SELECT 'detection-rate' AS gate, count(*) FILTER (outcome = 'detected') / count(*)::DOUBLE AS actual FROM res
           UNION ALL SELECT 'visibility-rate', count(*) FILTER (outcome <> 'blind') / count(*)::DOUBLE FROM res) r ON r.gate = g.gate""",
    HIST,
    DIFF,
    f"""
target(tactic, d, v, priority) AS (VALUES {", ".join(f"('{t}', {d}::DOUBLE, {v}::DOUBLE, '{p}')" for t, d, v, p in GATE_TARGETS)}),
att AS (SELECT res.*, attack.technique, attack.tactic AS own, attack.pos FROM res JOIN attack USING (rule)),
tech AS (SELECT technique, count(*) FILTER (outcome = 'detected') AS detected, count(*) FILTER (outcome = 'blind') AS blind, count(*) AS scoreable
  FROM att GROUP BY 1),
first AS (SELECT technique, own FROM (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY rule, test_id, pos) AS n FROM att) WHERE n = 1),
tac AS (SELECT coalesce(own, CASE WHEN split_part(technique, '.', 1) = 'T1003' THEN 'credential-access' END, 'unmapped') AS tactic,
  sum(detected) / sum(scoreable)::DOUBLE AS dr, (sum(scoreable) - sum(blind)) / sum(scoreable)::DOUBLE AS vr
  FROM tech JOIN first USING (technique) GROUP BY 1),
critical AS (SELECT tactic, CASE priority WHEN 'critical' THEN 0 ELSE 1 END * 1000 + CASE tactic WHEN 'impact' THEN 3 WHEN 'collection' THEN 2 ELSE 99 END AS a,
  tactic IN (SELECT own FROM att WHERE outcome IN ('visible', 'blind') AND status <> 'pass' AND own IS NOT NULL) AS drift
  FROM tac JOIN target USING (tactic) WHERE (dr < d OR vr < v) AND priority IN ('critical', 'high')),
marks AS (
  SELECT 'expectations-met' AS gate, rule || '/' || test_id AS o, 0::DOUBLE AS a, rule AS b, test_id AS c FROM res WHERE status = 'fail' AND s_rank >= 2
  UNION ALL SELECT 'no-regressions', rule || '/' || test_id, 0, rule || '/' || test_id, '' FROM deltas WHERE kind = 'regression' AND severity IN ('medium', 'high', 'critical')
  UNION ALL SELECT 'detection-rate', rule || '/' || test_id, 0, rule, test_id FROM res WHERE outcome = 'visible' AND status <> 'pass'
  UNION ALL SELECT 'detection-rate/accepted', rule || '/' || test_id, 0, rule, test_id FROM res WHERE outcome = 'visible' AND status = 'pass'
  UNION ALL SELECT 'visibility-rate', rule || '/' || test_id, 0, rule, test_id FROM res WHERE outcome = 'blind' AND status <> 'pass'
  UNION ALL SELECT 'visibility-rate/accepted', rule || '/' || test_id, 0, rule, test_id FROM res WHERE outcome = 'blind' AND status = 'pass'
  UNION ALL SELECT 'latency-budget', rule || '/' || test_id, 0, rule, test_id FROM res WHERE latency > max_latency AND s_rank >= 2
  UNION ALL SELECT 'coverage-targets' || CASE WHEN drift THEN '' ELSE '/accepted' END, tactic, a, tactic, '' FROM critical
  UNION ALL SELECT 'noise-budget', rule, -baseline_hits, rule, '' FROM
    (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY test_id, case_id) AS n FROM res WHERE baseline_hits > 0) WHERE n = 1 AND s_rank >= 2),
side AS (SELECT gate, max(t) AS n, string_agg(o, ',' ORDER BY n) FILTER (n <= 20) AS offenders FROM
  (SELECT *, row_number() OVER (PARTITION BY gate ORDER BY a, b, c) AS n, count(*) OVER (PARTITION BY gate) AS t FROM marks) GROUP BY gate)""",
)

QUERIES = {
    "gates_full": Query(gates_full, GATES_FULL_SQL),
    "run_diff": Query(run_diff, RUN_DIFF_SQL),
    "diff_counts": Query(diff_counts, DIFF_COUNTS_SQL),
    "previous_run": Query(previous_run, with_results("SELECT run_id, profile, previous_run_id FROM prev", HIST)),
    "run_list": Query(run_list, RUN_LIST_SQL),
    "latest_outcome": Query(
        latest_outcome, with_results("SELECT rule, test_id, run_id, outcome, status FROM latest WHERE n = 1", HIST)
    ),
    "worst_outcome": Query(
        worst_outcome,
        with_results(
            """SELECT rule, min_by(outcome, list_position(['blind', 'visible', 'detected'], outcome)) AS outcome
            FROM latest WHERE n = 1 GROUP BY rule""",
            HIST,
        ),
    ),
    "rule_history": Query(rule_history, RULE_HISTORY_SQL),
    "logic_changes": Query(logic_changes, LOGIC_SQL),
    "duplicate_ids": Query(duplicate_ids, DUPLICATE_SQL),
    "scorecard": Query(
        scores,
        with_results(
            """SELECT run_id, rule, outcome, validation, robustness, telemetry, attack, documentation, hygiene, total, weakest, grade
            FROM sc""",
            HIST,
            SCORE_CTE,
        ),
    ),
    "scorecard_rollup": Query(rollup, ROLLUP_SQL),
}
