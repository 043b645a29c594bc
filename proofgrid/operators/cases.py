"""Validation cases: planning, observing and the three-state verdict."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.functions.scalars import case_id
from proofgrid.operators.rules import Ruleset, probe_keys, tag_codes
from proofgrid.operators.timeline import BUCKET_SECONDS, count_in_windows, within_span


def plan_cases(rules: DataFrame, tests: DataFrame | None = None, wanted_tests: Sequence[str] = (), run: Column | None = None) -> DataFrame:
    """One case per (rule, test). Rules without tests plan nothing.

    `tests` is the catalogue (column ``test_id``); a test outside it is skipped with a reason.
    """
    cases = rules.select("*", F.explode("tests").alias("test_id")).drop("tests")
    if wanted_tests:
        cases = cases.filter(F.col("test_id").isin(*wanted_tests))
    reason = F.when(~F.col("enabled"), F.lit("validation disabled"))
    if tests is not None:
        known = tests.select(F.col("test_id"), F.lit(True).alias("_known")).distinct()
        cases = cases.join(known, "test_id", "left")
        reason = reason.when(F.col("_known").isNull(), F.lit("test not defined"))
    return cases.withColumn("skip_reason", reason).drop("_known").withColumn(
        "case_id", case_id(F.lit("") if run is None else run, F.col("rule"), F.col("test_id"))
    )


def search_window(started_us: Column, finished_us: Column, max_latency: Column, pre: float = V.PRE_WINDOW, post: float = V.POST_WINDOW) -> tuple[Column, Column]:
    """Where a case looks: from `pre` seconds before the test to past its latency budget."""
    after = F.greatest(F.lit(post), max_latency) + F.lit(V.WINDOW_MARGIN)
    lo = started_us - F.lit(int(pre * 1e6))
    hi = finished_us + F.round(after * F.lit(1e6)).cast("bigint")
    return lo, hi


@dataclass(frozen=True)
class Baseline:
    """Where noise is measured: [lo, hi] on the events carrying `key`."""

    lo: Column
    hi: Column
    key: Column


def observe(
    cases: DataFrame,
    marked: DataFrame,
    ruleset: Ruleset,
    baseline: Baseline | None = None,
    attribution: str | None = None,
    result_cap: int | None = None,
    bucket_seconds: int = BUCKET_SECONDS,
    prune: bool = False,
    errors: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add detection_hits, telemetry_hits, baseline_hits, first_us and truncation to cases.

    `marked` comes from `measure_rules` with columns ``tag``, ``us`` and, with attribution,
    the attribution column. `cases` has case_id, rule, lo, hi and the same column. Without
    attribution every event in a window counts, as on a live platform.

    Counts are exact. `result_cap` only sets the truncation flags that a capped search
    would have reported; nothing is dropped. `prune` reads only the time span the windows
    cover, for cases that touch a small part of a long history. `errors` are the rules that
    `measure_rules` left out: their cases get detection_error and no counts of hits.
    """
    keys = ["tag"] + (["owner"] if attribution else [])
    owner = {"owner": F.col(attribution)} if attribution else {}
    events = marked.select("tag", *[c.alias(n) for n, c in owner.items()], "us")
    codes, probes = tag_codes(ruleset), probe_keys(ruleset)

    def code_of(names: dict[str, str | None]) -> Column:
        known = [(rule, codes[name]) for rule, name in names.items() if name is not None]
        table = F.create_map(*[F.lit(part) for pair in known for part in pair]) if known else None
        return F.lit(None).cast("int") if table is None else F.try_element_at(table, F.col("rule"))

    def ask(measure: str, tag: Column, lo: Column, hi: Column, key: Column | None) -> Column:
        parts = [F.lit(measure).alias("measure"), tag.alias("tag"), lo.alias("lo"), hi.alias("hi")]
        return F.struct(*parts, *([key.alias("owner")] if attribution else []))

    own = owner.get("owner")
    broken = errors or {}
    hit = code_of({r.name: f"hit:{r.name}" for r in ruleset.rules if r.name not in broken})
    probes = {name: key for name, key in probes.items() if name not in broken}
    asks = [
        ask("hit", hit, F.col("lo"), F.col("hi"), own),
        ask("probe", code_of(probes), F.col("lo"), F.col("hi"), own),
    ]
    if baseline is not None:
        asks.append(ask("noise", hit, baseline.lo, baseline.hi, baseline.key))
    requests = cases.select("case_id", F.inline(F.array(*asks))).filter(F.col("tag").isNotNull())
    if prune:
        events = within_span(events, requests)
    seen = count_in_windows(
        events,
        requests,
        keys,
        ["case_id"],
        bucket_seconds=bucket_seconds,
        label="measure",
        labels=("hit", "probe", "noise"),
    ).select(
        "case_id",
        F.col("hits_hit").alias("detection_hits"),
        F.col("first_us_hit").alias("first_us"),
        F.col("hits_probe").alias("telemetry_hits"),
        F.col("hits_noise").alias("baseline_hits"),
    )
    out = cases.join(seen, "case_id", "left")
    if broken:
        reasons = F.create_map(*[F.lit(part) for pair in broken.items() for part in pair])
        out = out.withColumn("detection_error", F.try_element_at(reasons, F.col("rule")))
    over = (
        (lambda c: F.coalesce(F.col(c) > result_cap, F.lit(False)))
        if result_cap is not None
        else (lambda c: F.lit(False))
    )
    return out.withColumns({"detection_truncated": over("detection_hits"), "telemetry_truncated": over("telemetry_hits")})


OBSERVATION_DEFAULTS = {
    "skip_reason": "string",
    "run_skip_reason": "string",
    "mode": "string",
    "executed": "boolean",
    "emulation_error": "string",
    "exit_code": "int",
    "detection_hits": "bigint",
    "detection_error": "string",
    "detection_truncated": "boolean",
    "telemetry_hits": "bigint",
    "telemetry_error": "string",
    "telemetry_truncated": "boolean",
    "baseline_hits": "bigint",
    "baseline_error": "string",
    "first_us": "bigint",
    "started_us": "bigint",
}


def classify(observed: DataFrame, strict_compat: bool = False) -> DataFrame:
    """Outcome, status, confidence, latency and notes of observed cases.

    Needs ``expected`` and ``max_latency``; any other observation column may be absent. A
    case without ``started_us`` had no emulation. NULL detection_hits means the query never
    ran, NULL telemetry_hits that no probe exists. `strict_compat` also reports a probe with
    more than one event as truncated, as a search that stops at the first event would.
    """
    absent = {c: F.lit(None).cast(t) for c, t in OBSERVATION_DEFAULTS.items() if c not in observed.columns}
    df = observed.withColumns(absent) if absent else observed
    c = F.col
    false = F.lit(False)

    probe_failed = c("telemetry_error").isNotNull()
    has_probe = ~probe_failed & c("telemetry_hits").isNotNull()
    skip = F.coalesce(
        c("run_skip_reason"),
        c("skip_reason"),
        F.when(c("started_us").isNull(), F.lit("the test did not run")),
        F.when(c("mode") == "dry-run", F.lit("dry run: nothing was executed to detect")),
    )
    error = F.coalesce(
        F.concat(F.lit("test failed: "), F.nullif(c("emulation_error"), F.lit(""))),
        F.concat(F.lit("rule query failed: "), c("detection_error")),
        F.when(c("detection_hits").isNull(), F.lit("rule query missing")),
    )
    ran = skip.isNull() & error.isNull()
    hits = c("detection_hits") > 0
    outcome = (
        F.when(skip.isNotNull(), F.lit("skipped"))
        .when(error.isNotNull(), F.lit("error"))
        .when(hits, F.lit("detected"))
        .when(~has_probe, F.lit("visible"))
        .when(c("telemetry_hits") > 0, F.lit("visible"))
        .otherwise(F.lit("blind"))
    )
    probe_cut = F.coalesce(c("telemetry_truncated"), false)
    if strict_compat:
        probe_cut = probe_cut | F.coalesce(c("telemetry_hits") > 1, false)
    truncated = F.coalesce(c("detection_truncated"), false) | (has_probe & probe_cut)
    replayed = F.coalesce((c("mode") == "replay") & ~F.coalesce(c("executed"), false), false)
    low = probe_failed | (~hits & ~has_probe)
    confidence = (
        F.when(skip.isNotNull(), F.lit("high"))
        .when(error.isNotNull() | low, F.lit("low"))
        .when(truncated | replayed, F.lit("medium"))
        .otherwise(F.lit("high"))
    )
    delta = (c("first_us") - c("started_us")) / F.lit(1e6)
    latency = F.when(ran & hits & (delta >= 0), F.round(delta, 3))
    noise = F.when(c("baseline_error").isNotNull(), F.lit(0)).otherwise(F.coalesce(c("baseline_hits"), F.lit(0)))

    df = df.withColumns(
        {
            "outcome": outcome,
            "confidence": confidence,
            "latency": latency,
            "first_us": F.when(ran & hits, c("first_us")),
            "_skip": skip,
            "_error": error,
            "_probe": has_probe,
            "_cut": truncated,
            "_replay": replayed,
        }
    )
    observed_rank, expected_rank = V.outcome_rank(c("outcome")), V.outcome_rank(c("expected"))
    status = (
        F.when(c("outcome").isin("skipped", "error"), c("outcome"))
        .when((observed_rank < 0) | (expected_rank < 0), F.lit("error"))
        .when(observed_rank > expected_rank, F.lit("unexpected_pass"))
        .when(observed_rank == expected_rank, F.lit("pass"))
        .otherwise(F.lit("fail"))
    )
    zero = F.lit(0).cast("bigint")
    counts = {
        "detection_hits": F.when(ran, c("detection_hits")).otherwise(zero),
        "telemetry_hits": F.when(ran & c("_probe"), c("telemetry_hits")).otherwise(zero),
        "baseline_hits": F.when(ran, noise.cast("bigint")).otherwise(zero),
    }
    breached = F.coalesce(c("latency") > c("max_latency"), false)
    seconds = lambda x: F.format_string("%.0f", x)
    notes = F.array_compact(
        F.array(
            c("_skip"),
            F.when(c("_skip").isNull(), c("_error")),
            *[
                F.when(c("_skip").isNull() & c("_error").isNull() & when, text)
                for when, text in (
                    (probe_failed, F.concat(F.lit("probe failed ("), c("telemetry_error"), F.lit("), taken as absent"))),
                    (~hits & ~c("_probe"), F.lit("no probe: rule gap and source gap look alike")),
                    ((c("outcome") == "visible") & c("_probe"), F.concat(c("telemetry_hits").cast("string"), F.lit(" source event(s) seen, none matched by the rule"))),
                    (c("outcome") == "blind", F.lit("no source event seen in the test window")),
                    (c("_cut"), F.lit("results were capped, so the latency is uncertain")),
                    (c("_replay"), F.lit("replay of a recording, nothing executed")),
                    (F.coalesce(c("exit_code") != 0, false), F.concat(F.lit("test exit code "), c("exit_code").cast("string"))),
                    (breached, F.concat(F.lit("detected after "), seconds(c("latency")), F.lit("s against a "), seconds(c("max_latency")), F.lit("s budget"))),
                    (c("baseline_error").isNotNull(), F.concat(F.lit("quiet-window query failed: "), c("baseline_error"))),
                    (c("baseline_error").isNull() & F.coalesce(c("baseline_hits") > 0, false), F.concat(c("baseline_hits").cast("string"), F.lit(" quiet-window hit(s)"))),
                )
            ],
        )
    )
    # Notes read the observed counts, so they are built before the counts are reset.
    df = df.withColumns({"status": status, "notes": notes, "breached": breached})
    df = df.withColumns({"error": F.when(c("_skip").isNull(), c("_error")), **counts})
    df = df.withColumns({"noisy": c("baseline_hits") > 0, "scoreable": V.is_scoreable(c("outcome")), "gap": V.gap_kind(c("outcome"))})
    return df.drop("_skip", "_error", "_probe", "_cut", "_replay")
