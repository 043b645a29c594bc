"""Queries: technique and tactic coverage over orders as cases.

An order is a case: its customer's nation is the technique (T1000 + region, three-digit
nation), the region the tactic, the status the outcome, the priority the rule and the
market segment the log source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.operators import audit, coverage
from proofgrid.plans.telemetry import Query, table

TACTIC_TARGETS = (("africa", 0.5, 0.7, "critical"), ("asia", 0.6, 0.65, "high"), ("europe", 0.3, 0.6, "low"))
TECHNIQUE_TARGETS = (("T1002", 0.49, 0.66, "high"), ("T1003.003", 0.9, 0.95, "critical"))
EXCLUDED = (("T1004.009", "not in use"), ("T1001.001", "out of scope"))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    technique = F.format_string("T%04d.%03d", F.col("n_regionkey") + 1000, F.col("n_nationkey"))
    # Nations with an even key name their tactic; the others take it from the reference.
    tactic = F.when(F.col("n_nationkey") % 2 == 0, F.lower("r_name"))
    refs = nations.select("n_nationkey", F.array(F.struct(technique.alias("technique"), tactic.alias("tactic"))).alias("attack"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    outcome = (
        F.when(F.col("o_orderstatus") == "F", F.lit("detected"))
        .when(F.col("o_orderstatus") == "O", F.lit("visible"))
        .otherwise(F.lit("blind"))
    )
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(refs, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderpriority").alias("rule"),
            F.col("o_orderkey").cast("string").alias("test_id"),
            outcome.alias("outcome"),
            F.array("c_mktsegment").alias("telemetry"),
            "attack",
        )
    )


def content(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Reference and targets. The reference knows parents only, so sub-techniques fall back."""
    regions = table(spark, sf_dir, "region")
    reference = regions.select(
        F.format_string("T%04d", F.col("r_regionkey") + 1000).alias("technique"),
        F.concat(F.lit("Region "), F.col("r_name")).alias("name"),
        F.array(F.lower("r_name"), F.lit("discovery")).alias("tactics"),
    )
    return {
        "reference": reference,
        "technique_targets": spark.createDataFrame(TECHNIQUE_TARGETS, "technique string, detected double, visible double, priority string"),
        "tactic_targets": spark.createDataFrame(TACTIC_TARGETS, "tactic string, detected double, visible double, priority string"),
        "excluded": spark.createDataFrame(EXCLUDED, "technique string, reason string"),
    }


def techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.technique_coverage(cases(spark, sf_dir), **content(spark, sf_dir))


def flat(df: DataFrame) -> DataFrame:
    """Lists as comma-separated text and rates to nine places."""
    lists = [f.name for f in df.schema.fields if f.dataType.simpleString() == "array<string>"]
    rates = [c for c in ("detection_rate", "visibility_rate") if c in df.columns]
    return df.withColumns({c: F.array_join(c, ",") for c in lists} | {c: F.round(c, 9) for c in rates})


def tactic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "region").select(
        F.lower("r_name").alias("tactic"), F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("order")
    )
    return coverage.tactic_coverage(techniques(spark, sf_dir), names, content(spark, sf_dir)["tactic_targets"])


TECH_CTE = f"""
tt(technique, detected, visible, priority) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, '{d}')" for a, b, c, d in TECHNIQUE_TARGETS)}),
ta(tactic, detected, visible, priority) AS (VALUES {", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, '{d}')" for a, b, c, d in TACTIC_TARGETS)}),
xx(technique) AS (VALUES {", ".join(f"('{a}')" for a, _ in EXCLUDED)}),
cs AS (SELECT o_orderpriority AS rule, CAST(o_orderkey AS VARCHAR) AS test_id, c_mktsegment AS seg,
  CASE o_orderstatus WHEN 'F' THEN 'detected' WHEN 'O' THEN 'visible' ELSE 'blind' END AS outcome,
  printf('T%04d.%03d', n_regionkey + 1000, n_nationkey) AS technique, printf('T%04d', n_regionkey + 1000) AS parent,
  n_nationkey % 2 = 0 AS own, lower(r_name) AS region,
  'Region ' || r_name AS name
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT technique, parent, name, region, bool_or(own) AS own, count(*) FILTER (outcome = 'detected') AS detected,
  count(*) FILTER (outcome = 'visible') AS visible, count(*) FILTER (outcome = 'blind') AS blind, count(*) AS scoreable,
  string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules,
  coalesce(string_agg(DISTINCT seg, ',' ORDER BY seg) FILTER (outcome = 'blind'), '') AS missing_telemetry
  FROM cs WHERE technique NOT IN (SELECT technique FROM xx) AND parent NOT IN (SELECT technique FROM xx) GROUP BY 1, 2, 3, 4),
t0 AS (SELECT f.*, coalesce(a.detected, b.detected, greatest(0.7, c.detected)) AS target_detected,
  coalesce(a.visible, b.visible, greatest(0.9, c.visible)) AS target_visible,
  coalesce(a.priority, b.priority, CASE WHEN c.priority IN ('critical', 'high') THEN c.priority ELSE 'medium' END) AS priority,
  f.detected / f.scoreable::DOUBLE AS dr, (f.scoreable - f.blind) / f.scoreable::DOUBLE AS vr
  FROM f LEFT JOIN tt a ON a.technique = f.technique LEFT JOIN tt b ON b.technique = f.parent LEFT JOIN ta c ON c.tactic = f.region),
t AS (SELECT *, dr >= target_detected AS meets_detection, vr >= target_visible AS meets_visibility,
  CASE WHEN blind = scoreable THEN 'visibility-gap' WHEN detected = 0 THEN 'detection-gap'
       WHEN dr >= target_detected AND vr >= target_visible THEN 'covered' ELSE 'partial' END AS status,
  CASE WHEN own THEN region ELSE region || ',discovery' END AS tactics FROM t0)"""

TECH_SELECT = """technique, name, tactics, rules, detected, visible, blind, 0::BIGINT AS errored, 0::BIGINT AS skipped, scoreable,
  round(dr, 9) AS detection_rate, round(vr, 9) AS visibility_rate, target_detected, target_visible, meets_detection,
  meets_visibility, priority, status, missing_telemetry"""

TACTIC_CTE = """
m AS (SELECT technique, detected, blind, scoreable, unnest(string_split(tactics, ',')) AS tactic FROM t),
g AS (SELECT tactic, string_agg(technique, ',' ORDER BY technique) AS techniques, sum(detected)::BIGINT AS detected,
  sum(blind)::BIGINT AS blind, sum(scoreable)::BIGINT AS scoreable FROM m GROUP BY tactic),
tac AS (SELECT g.*, g.detected / g.scoreable::DOUBLE AS dr, (g.scoreable - g.blind) / g.scoreable::DOUBLE AS vr,
  coalesce(ta.detected, 0.7) AS target_detected, coalesce(ta.visible, 0.9) AS target_visible,
  coalesce(ta.priority, 'medium') AS priority, coalesce(r_name, g.tactic) AS name,
  coalesce(r_regionkey, 99)::INTEGER AS "order"
  FROM g LEFT JOIN ta ON ta.tactic = g.tactic LEFT JOIN region ON lower(r_name) = g.tactic)"""
TACTIC_SELECT = """tactic, techniques, detected, blind, scoreable, round(dr, 9) AS detection_rate, round(vr, 9) AS visibility_rate,
  target_detected, target_visible, priority, name, "order", dr >= target_detected AND vr >= target_visible AS meets_target"""


def with_techniques(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([TECH_CTE, *more]) + "\n" + body


def coverage_targets(spark, sf_dir):
    return techniques(spark, sf_dir).select("technique", "target_detected", "target_visible", "priority", "status")


def coverage_gaps(spark, sf_dir):
    found = techniques(spark, sf_dir)
    lines = [
        coverage.coverage_gaps(found, kind).select(F.lit(kind).alias("kind"), "technique", "priority", "visible", "blind")
        for kind in ("detection", "visibility")
    ]
    return lines[0].unionByName(lines[1])


def layer(spark, sf_dir):
    return coverage.layer_rows(techniques(spark, sf_dir), content(spark, sf_dir)["excluded"])


LAYER_SQL = """
SELECT technique, CAST(round_even(dr * 100, 0) AS INTEGER) AS score,
  CASE status WHEN 'covered' THEN '#2f9e5f' WHEN 'partial' THEN '#c9a227' WHEN 'detection-gap' THEN '#e08b1a' ELSE '#c0392b' END AS colour,
  true AS enabled, false AS show_children, status, detected, visible, blind,
  replace(rules, ',', ', ') AS rules, replace(missing_telemetry, ',', ', ') AS missing_telemetry FROM t
UNION ALL SELECT technique, NULL, '#3f444c', false, NULL, 'excluded', NULL, NULL, NULL, NULL, NULL FROM xx
"""


def failing(spark, sf_dir):
    return flat(coverage.failing_tactics(tactic_rows(spark, sf_dir)))


def technique_names(spark, sf_dir):
    """Cases per technique with the reference's name, tactics and telemetry (all from parents)."""
    counted = (
        cases(spark, sf_dir).select(F.explode("attack.technique").alias("technique")).groupBy("technique").agg(F.count(F.lit(1)).alias("cases"))
    )
    reference = content(spark, sf_dir)["reference"].withColumn(
        "telemetry", F.when(F.endswith("technique", F.lit("1")), F.array(F.lit("web"))).otherwise(F.array(F.lit("app"), F.lit("web")))
    )
    return flat(coverage.technique_lookup(counted, reference))


NAMES_SQL = """
SELECT printf('T%04d.%03d', n_regionkey + 1000, n_nationkey) AS technique, count(*) AS cases, 'Region ' || r_name AS name,
  lower(r_name) || ',discovery' AS tactics, CASE WHEN n_regionkey = 1 THEN 'web' ELSE 'app,web' END AS telemetry
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY n_regionkey, n_nationkey, r_name
"""


def coverage_index(spark, sf_dir):
    """Rules (priorities) indexed by the techniques their cases touch."""
    return audit.index_by(
        cases(spark, sf_dir).select("rule", F.col("attack.technique").alias("techniques")), "techniques"
    ).select(F.col("key").alias("technique"), F.array_join("rules", ",").alias("rules"))


QUERIES = {
    "coverage_technique": Query(lambda s, d: flat(techniques(s, d)), with_techniques(f"SELECT {TECH_SELECT} FROM t")),
    "coverage_tactic": Query(
        lambda s, d: flat(tactic_rows(s, d)), with_techniques(f"SELECT {TACTIC_SELECT} FROM tac", TACTIC_CTE)
    ),
    "coverage_overall": Query(
        lambda s, d: flat(coverage.overall_coverage(techniques(s, d))),
        with_techniques(
            """SELECT sum(detected)::BIGINT AS detected, sum(blind)::BIGINT AS blind, sum(scoreable)::BIGINT AS scoreable,
            round(sum(detected) / sum(scoreable)::DOUBLE, 9) AS detection_rate,
            round((sum(scoreable) - sum(blind)) / sum(scoreable)::DOUBLE, 9) AS visibility_rate FROM t"""
        ),
    ),
    "coverage_targets": Query(
        coverage_targets, with_techniques("SELECT technique, target_detected, target_visible, priority, status FROM t")
    ),
    "coverage_gaps": Query(
        coverage_gaps,
        with_techniques(
            """SELECT 'detection' AS kind, technique, priority, visible, blind FROM t WHERE visible > 0
            UNION ALL SELECT 'visibility', technique, priority, visible, blind FROM t WHERE blind > 0"""
        ),
    ),
    "failing_tactics": Query(
        failing,
        with_techniques(
            f"SELECT {TACTIC_SELECT} FROM tac WHERE scoreable > 0 AND NOT (dr >= target_detected AND vr >= target_visible)", TACTIC_CTE
        ),
    ),
    "technique_names": Query(technique_names, NAMES_SQL),
    "layer_rows": Query(layer, with_techniques(LAYER_SQL)),
    "rule_index": Query(
        coverage_index,
        "WITH " + TECH_CTE + " SELECT technique, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM cs GROUP BY technique",
    ),
}
