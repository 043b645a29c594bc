"""Pass/fail gates over a classified run."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid import vocabulary as V

OFFENDERS = 20


@dataclass(frozen=True)
class GateSettings:
    min_severity: str = "medium"
    fail_on_error: bool = True
    fail_on_regression: bool = True
    min_detection_rate: float = 0.0
    min_visibility_rate: float = 0.0
    fail_on_noise: bool = False
    fail_on_latency_breach: bool = False
    fail_on_coverage_target: bool = False


def is_accepted(outcome: Column, status: Column) -> Column:
    """A gap the rule documents: not detected, and exactly as expected."""
    return (status == "pass") & (outcome != "detected")


def case_flags(cases: DataFrame, settings: GateSettings) -> DataFrame:
    """Cases as (gate, offender, sort key) rows, one for each gate a case counts against."""
    c = F.col
    severe = V.severity_rank(c("severity")) >= V.SEVERITIES.index(settings.min_severity)
    accepted = is_accepted(c("outcome"), c("status"))
    flags = {
        "no-errors": c("status") == "error",
        "expectations-met": (c("status") == "fail") & severe,
        "detection-rate": (c("outcome") == "visible") & ~accepted,
        "detection-rate/accepted": (c("outcome") == "visible") & accepted,
        "visibility-rate": (c("outcome") == "blind") & ~accepted,
        "visibility-rate/accepted": (c("outcome") == "blind") & accepted,
        "latency-budget": F.coalesce(c("latency") > c("max_latency"), F.lit(False)) & severe,
    }
    marks = F.array_compact(F.array(*[F.when(flag, F.lit(gate)) for gate, flag in flags.items()]))
    return cases.select(
        F.explode(marks).alias("gate"),
        F.concat_ws("/", "rule", "test_id").alias("offender"),
        F.struct(F.lit(0.0).alias("a"), c("rule").alias("b"), c("test_id").alias("c"), c("case_id").alias("d")).alias("place"),
    )


def evaluate_gates(
    cases: DataFrame,
    settings: GateSettings = GateSettings(),
    deltas: DataFrame | None = None,
    tactics: DataFrame | None = None,
    noise: DataFrame | None = None,
) -> DataFrame:
    """One row per gate: applicable, passed, count, target, actual, offenders (at most 20).

    Accepted gaps never fail a rate gate, and never change a rate.
    """
    empty = F.lit("")
    floor = V.SEVERITIES.index(settings.min_severity)
    severe = lambda c: V.severity_rank(V.normalise_severity(c)) >= floor

    def marks(df: DataFrame, gate: Column, offender: Column, order: Column) -> DataFrame:
        place = F.struct(order.cast("double").alias("a"), offender.alias("b"), empty.alias("c"), empty.alias("d"))
        return df.select(gate.alias("gate"), offender.alias("offender"), place.alias("place"))

    found = case_flags(cases, settings)
    if deltas is not None:
        regressions = deltas.filter((F.col("kind") == "regression") & severe(F.col("severity")))
        found = found.unionByName(
            marks(regressions, F.lit("no-regressions"), F.concat_ws("/", "rule", "test_id"), F.lit(0))
        )
    if noise is not None:
        loud = noise.filter(severe(F.col("severity")))
        found = found.unionByName(marks(loud, F.lit("noise-budget"), F.col("rule"), -F.col("excess")))
    if tactics is not None:
        unaccepted = F.col("outcome").isin("visible", "blind") & ~is_accepted(F.col("outcome"), F.col("status"))
        drifting = (
            cases.filter(unaccepted)
            .select(F.explode("attack.tactic").alias("tactic"))
            .filter(F.col("tactic").isNotNull())
            .distinct()
            .withColumn("_drift", F.lit(True))
        )
        critical = tactics.filter(
            (F.col("scoreable") > 0) & ~F.col("meets_target") & F.col("priority").isin("critical", "high")
        ).join(drifting, "tactic", "left")
        gate = F.when(F.col("_drift"), F.lit("coverage-targets")).otherwise(F.lit("coverage-targets/accepted"))
        place = V.priority_rank(F.col("priority")) * 1000 + F.col("order")
        found = found.unionByName(
            marks(critical, gate, F.col("tactic"), place)
        )

    counts = found.groupBy("gate").agg(F.count(F.lit(1)).alias("n"))
    # Only the first twenty of a gate are ever gathered.
    first = Window.partitionBy("gate").orderBy("place")
    named = (
        found.withColumn("_n", F.row_number().over(first))
        .filter(F.col("_n") <= OFFENDERS)
        .groupBy("gate")
        .agg(F.sort_array(F.collect_list(F.struct("_n", "offender"))).getField("offender").alias("offenders"))
    )
    totals = cases.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in V.RANKED_OUTCOMES]
    ).withColumn("scoreable", F.col("detected") + F.col("visible") + F.col("blind"))
    rates = totals.select(
        F.explode(
            F.create_map(
                F.lit("detection-rate"), V.ratio(F.col("detected"), F.col("scoreable")),
                F.lit("visibility-rate"), V.ratio(F.col("scoreable") - F.col("blind"), F.col("scoreable")),
            )
        ).alias("gate", "actual")
    )
    settled = {
        "no-errors": (settings.fail_on_error, None),
        "expectations-met": (True, None),
        "no-regressions": (settings.fail_on_regression and deltas is not None, None),
        "detection-rate": (settings.min_detection_rate > 0, settings.min_detection_rate),
        "visibility-rate": (settings.min_visibility_rate > 0, settings.min_visibility_rate),
        "noise-budget": (settings.fail_on_noise, None),
        "latency-budget": (settings.fail_on_latency_breach, None),
        "coverage-targets": (settings.fail_on_coverage_target and tactics is not None, None),
    }
    gates = cases.sparkSession.createDataFrame(
        [(i, g, *settled[g]) for i, g in enumerate(V.GATES)],
        "position int, gate string, applicable boolean, target double",
    )
    side = counts.join(named, "gate", "left")
    accepted = side.select(
        F.regexp_replace("gate", "/accepted$", "").alias("gate"),
        F.col("n").alias("accepted"),
        F.col("offenders").alias("_accepted_names"),
        F.endswith(F.col("gate"), F.lit("/accepted")).alias("_is"),
    ).filter("_is").drop("_is")
    out = gates.join(side, "gate", "left").join(accepted, "gate", "left").join(rates, "gate", "left")
    n, ok = F.coalesce("n", F.lit(0)), F.coalesce("accepted", F.lit(0))
    is_rate = F.col("target").isNotNull()
    below = is_rate & F.col("applicable") & (F.col("actual") < F.col("target"))
    passed = F.when(is_rate, ~below | (n == 0)).otherwise(n == 0)
    names = F.when(n > 0, F.col("offenders")).when(
        below | (F.col("gate") == "coverage-targets"), F.col("_accepted_names")
    )
    nothing = F.array().cast("array<string>")
    out = out.select(
        "position",
        "gate",
        "applicable",
        passed.alias("passed"),
        n.alias("n"),
        ok.alias("accepted"),
        "target",
        "actual",
        F.coalesce(names, nothing).alias("offenders"),
    )
    if tactics is not None:
        some = tactics.agg((F.count(F.lit(1)) > 0).alias("some")).scalar()
        out = out.withColumn("applicable", F.col("applicable") & ((F.col("gate") != "coverage-targets") | some))
    return out


def run_passed(gates: DataFrame) -> DataFrame:
    """Whether every applicable gate passed."""
    return gates.agg(F.coalesce(F.bool_and(~F.col("applicable") | F.col("passed")), F.lit(True)).alias("passed"))
