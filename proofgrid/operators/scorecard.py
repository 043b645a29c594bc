"""Rule scores from history, and their rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Weight of each dimension and the grade thresholds.
WEIGHTS = {
    "validation": 0.28,
    "robustness": 0.20,
    "telemetry": 0.16,
    "attack": 0.14,
    "documentation": 0.12,
    "hygiene": 0.10,
}
GRADES = (("A", 90.0), ("B", 80.0), ("C", 70.0), ("D", 60.0), ("F", 0.0))
# Points lost.
OUTCOME_LOSS = {"visible": 55.0, "blind": 70.0, "error": 20.0}
NO_RESULT, OVER_BUDGET, UNKNOWN_TEST, DISABLED, GAP_CAP = 25.0, 15.0, 40.0, 30.0, 50.0
NO_ID, UNUSED, UNKNOWN_KEY, NOISY = 25.0, 25.0, 10.0, 40.0
STATUS_LOSS = {"experimental": 10.0, "deprecated": 30.0, "unsupported": 30.0}


def clamp(points: Column) -> Column:
    return F.least(F.greatest(points, F.lit(0.0)), F.lit(100.0))


def loss(when: Column, points: float) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.lit(points)).otherwise(F.lit(0.0))


def grade(total: Column) -> Column:
    out = F.lit(GRADES[-1][0])
    for letter, floor in reversed(GRADES[:-1]):
        out = F.when(total >= floor, F.lit(letter)).otherwise(out)
    return out


def score_rules(
    rules: DataFrame, history: DataFrame, rule_names: Sequence[str], known_tests: DataFrame | None = None
) -> DataFrame:
    """Score every rule (of `rule_names`, the library) in every run of the history.

    `rules`: rule, id, status, expected, max_latency, enabled, tests, unused_selections,
    unknown_keys and the four static scores robustness, telemetry_score, attack_score,
    documentation. `history`: run_id, rule, outcome, latency, baseline_hits per case.

    The worst outcome of a rule's cases in a run stands for the run.
    """
    c = F.col
    order = F.expr(
        "CASE outcome WHEN 'blind' THEN 0 WHEN 'visible' THEN 1 WHEN 'detected' THEN 2 WHEN 'error' THEN 3 END"
    )
    seen = history.groupBy("run_id", "rule").agg(
        F.min_by("outcome", order).alias("outcome"),
        F.max("latency").alias("latency"),
        F.max(c("baseline_hits") > 0).alias("noisy"),
    )
    # Rules without a case in a run are scored too: no result.
    library = F.array(*[F.lit(name) for name in rule_names])
    every = history.select("run_id").distinct().select("run_id", F.explode(library).alias("rule"))
    df = every.join(rules, "rule").join(seen, ["run_id", "rule"], "left")
    if known_tests is not None:
        missing = (
            rules.select("rule", F.explode("tests").alias("test_id"))
            .join(known_tests.select("test_id").distinct(), "test_id", "left_anti")
            .select("rule", F.lit(True).alias("_unknown"))
            .distinct()
        )
        df = df.join(missing, "rule", "left")
    else:
        df = df.withColumn("_unknown", F.lit(False))
    result = F.lit(0.0)
    for outcome, points in OUTCOME_LOSS.items():
        result = F.when(c("outcome") == outcome, F.lit(points)).otherwise(result)
    proof = (
        F.lit(100.0)
        - loss(c("_unknown"), UNKNOWN_TEST)
        - loss(~c("enabled"), DISABLED)
        - loss(c("outcome").isNull(), NO_RESULT)
        - loss((c("outcome") == "detected") & (c("latency") > c("max_latency")), OVER_BUDGET)
        - result
    )
    proof = F.when(c("expected") != "detected", F.least(proof, F.lit(GAP_CAP))).otherwise(proof)
    state = F.lit(0.0)
    for status, points in STATUS_LOSS.items():
        state = F.when(c("status") == status, F.lit(points)).otherwise(state)
    tidy = (
        F.lit(100.0)
        - loss(c("id") == "", NO_ID)
        - loss(c("unused_selections") > 0, UNUSED)
        - loss(c("unknown_keys") > 0, UNKNOWN_KEY)
        - loss(c("noisy"), NOISY)
        - state
    )
    scored = df.select(
        "run_id",
        "rule",
        "outcome",
        F.when(F.size("tests") == 0, F.lit(0.0)).otherwise(clamp(proof)).alias("validation"),
        clamp(c("robustness")).alias("robustness"),
        clamp(c("telemetry_score")).alias("telemetry"),
        clamp(c("attack_score")).alias("attack"),
        clamp(c("documentation")).alias("documentation"),
        clamp(tidy).alias("hygiene"),
    )
    weighted = sum(c(name) * F.lit(weight) for name, weight in WEIGHTS.items()) / F.lit(sum(WEIGHTS.values()))
    lowest = F.least(*[c(name) for name in WEIGHTS])
    weakest = F.coalesce(*[F.when(c(name) == lowest, F.lit(name)) for name in WEIGHTS])
    return scored.withColumns({"total": F.round(weighted, 1), "weakest": weakest}).withColumn("grade", grade(c("total")))


def score_rollup(scores: DataFrame, below: float = 70.0) -> DataFrame:
    """Per run: average, its grade, rules per grade, average per dimension, rules below a mark."""
    return (
        scores.groupBy("run_id")
        .agg(
            F.round(F.avg("total"), 1).alias("average"),
            *[F.count_if(F.col("grade") == letter).alias(f"grade_{letter.lower()}") for letter, _ in GRADES],
            *[F.round(F.avg(name), 1).alias(f"avg_{name}") for name in WEIGHTS],
            F.count_if(F.col("total") < below).alias("below"),
        )
        .withColumn("grade", grade(F.col("average")))
    )


def worst_rules(scores: DataFrame, limit: int = 10) -> DataFrame:
    return scores.orderBy("total", "rule", "run_id").limit(limit)
