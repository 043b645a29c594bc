"""A whole offline validation: recorded events on a timeline, cases, verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.functions.fields import EventFields
from proofgrid.operators.capture import rebase
from proofgrid.operators.cases import Baseline, classify, observe, plan_cases, search_window
from proofgrid.operators.rules import Ruleset, measure_rules


def replay(
    events: DataFrame,
    fields: EventFields,
    ruleset: Ruleset,
    tests: DataFrame,
    started_us: int,
    wanted_tests: Sequence[str] = (),
    pre: float = V.PRE_WINDOW,
    post: float = V.POST_WINDOW,
    quiet: float = V.QUIET_WINDOW,
    result_cap: int | None = None,
    strict_compat: bool = False,
) -> DataFrame:
    """Classified cases of `ruleset` against a corpus replayed at `started_us`.

    `events` has test_id, offset_s and doc; `tests` test_id and duration_s. Every test is
    anchored at the start; attribution keeps the tests apart. The quiet window ends where
    the tests begin. Cases of a rule that can't be evaluated come out as errors with the reason.
    """
    quiet_us = started_us - int(quiet * 1e6)
    emulations = tests.select(
        "test_id", F.lit(started_us).alias("started_us"), (F.lit(started_us) + F.round(F.col("duration_s") * 1e6).cast("bigint")).alias("finished_us")
    )
    anchors = emulations.select("test_id", F.col("started_us").alias("anchor_us"))
    timeline = rebase(events, anchors, F.lit(quiet_us))
    errors: dict[str, str] = {}
    marked = measure_rules(timeline, ruleset, fields, ["test_id", "us"], errors)
    cases = plan_cases(ruleset.table(events.sparkSession), tests, wanted_tests).join(emulations, "test_id", "left")
    lo, hi = search_window(F.col("started_us"), F.col("finished_us"), F.col("max_latency"), pre, post)
    cases = cases.withColumns({"lo": lo, "hi": hi})
    baseline = Baseline(F.lit(quiet_us), F.lit(started_us), F.lit(V.BASELINE_TEST))
    seen = observe(cases, marked, ruleset, baseline, "test_id", result_cap, errors=errors)
    replayed = seen.withColumns({"mode": F.lit("replay"), "executed": F.lit(False)})
    return classify(replayed, strict_compat)
