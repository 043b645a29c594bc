"""Queries: rules that can't be evaluated, and tests in Python that fail."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from proofgrid.functions.predicates import register_test
from proofgrid.operators.cases import Baseline, classify, observe
from proofgrid.operators.rules import Rule, Ruleset, match_or_fail, measure_rules
from proofgrid.plans.telemetry import (
    EV, QUIET_US, RESULT_CAP, RULES, Query, planned, telemetry, telemetry_fields, with_results,
)

BROKEN = {"network": {"value|cidr": "999.1"}, "pattern": {"event_type|re": "("}, "order": {"value|gt": "much"}}


def _with_broken() -> Ruleset:
    """The library and three rules with a value that means nothing."""
    like = RULES.rules[0]
    broken = [replace(like, name=f"bad-{name}", detection={"sel": body, "condition": "sel"}) for name, body in BROKEN.items()]
    return replace(RULES, rules=(*RULES.rules, *broken))


def cases_of_broken_rules(spark, sf_dir):
    """One run over a library with broken rules: their cases are errors, the others keep their verdicts."""
    library = _with_broken()
    events = telemetry(spark, sf_dir)
    errors: dict[str, str] = {}
    marked = measure_rules(events, library, telemetry_fields(events), ["user_id", "us"], errors)
    quiet = Baseline(F.col("lo") - QUIET_US, F.col("lo") - 1, F.col("user_id"))
    seen = observe(planned(events, library), marked, library, quiet, "user_id", RESULT_CAP, errors=errors)
    cases = classify(seen.withColumns({"mode": F.lit("live"), "executed": F.lit(True)}))
    return cases.groupBy("rule", "outcome").agg(
        F.count("*").alias("cases"), F.count("detection_error").alias("reasons"), F.sum("detection_hits").alias("hits")
    )


BROKEN_SQL = with_results(
    """SELECT rule, outcome, count(*) AS cases, 0 AS reasons, CAST(sum(detection_hits) AS BIGINT) AS hits FROM res GROUP BY 1, 2
    UNION ALL SELECT b.rule, 'error', count(*), count(*), 0
    FROM ev, (VALUES ('bad-network'), ('bad-pattern'), ('bad-order')) b(rule) WHERE event_type = 'signup' GROUP BY 1"""
)


def pred_fallback(spark, sf_dir):
    """A test in Python that fails for some values: no match under a condition or its negation, but a row with the error."""

    def share(text: str, least: int) -> bool:
        number = int(text)
        if number == 0:
            raise ValueError("nothing to share")
        return 60 // number >= least

    register_test("share", share)
    body = {"sel": {"k|share": 3}}
    rules = [Rule("shared", {**body, "condition": "sel"}), Rule("kept", {**body, "condition": "not sel"}, telemetry=("error",))]
    events = telemetry(spark, sf_dir)
    return match_or_fail(events, Ruleset(tuple(rules), RULES.sources), telemetry_fields(events), ["event_id"])


FALLBACK_SQL = f"""WITH {EV}
SELECT event_id, 'shared' AS rule, CASE WHEN k = 0 THEN 'ValueError: nothing to share' END AS error FROM ev WHERE k = 0 OR 60 // k >= 3
UNION ALL
SELECT event_id, 'kept', CASE WHEN k = 0 THEN 'ValueError: nothing to share' END FROM ev
WHERE event_type = 'error' AND (k IS NULL OR k = 0 OR 60 // k < 3)
"""

QUERIES = {
    "cases_of_broken_rules": Query(cases_of_broken_rules, BROKEN_SQL),
    "pred_fallback": Query(pred_fallback, FALLBACK_SQL),
}
