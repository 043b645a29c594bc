"""Fixed names, ranks and defaults that results depend on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations and their order.
SEVERITIES = ("informational", "low", "medium", "high", "critical")
SEVERITY_ALIASES = {"info": "informational", "crit": "critical"}
RANKED_OUTCOMES = ("blind", "visible", "detected")
OUTCOMES = ("detected", "visible", "blind", "error", "skipped")
STATUSES = ("pass", "fail", "unexpected_pass", "error", "skipped")
RULE_STATUSES = ("experimental", "test", "production", "deprecated", "unsupported")
CONFIDENCES = ("low", "medium", "high")
PRIORITIES = ("critical", "high", "medium", "low", "informational")
DELTA_KINDS = ("regression", "slower", "new", "removed", "improvement", "unchanged")
BEAT_STATES = ("silent", "late", "alive")
GATES = (
    "no-errors",
    "expectations-met",
    "no-regressions",
    "detection-rate",
    "visibility-rate",
    "noise-budget",
    "latency-budget",
    "coverage-targets",
)

# Defaults.
BASELINE_TEST = "__baseline__"
PRE_WINDOW = 120.0
POST_WINDOW = 300.0
WINDOW_MARGIN = 60.0
QUIET_WINDOW = 3600.0
INGEST_LAG = 60.0
DETECTED_TARGET = 0.70
VISIBLE_TARGET = 0.90
BEAT_INTERVAL = 900.0
BEAT_GRACE = 3.0
SLOWDOWN_FACTOR = 2.0
SLOWDOWN_FLOOR = 30.0


def rank_of(column: Column, ordered: tuple[str, ...], otherwise: int | None = None) -> Column:
    """Position of a value in an ordered tuple of names; `otherwise` for any other value."""
    table = F.create_map(*[part for i, name in enumerate(ordered) for part in (F.lit(name), F.lit(i))])
    found = F.try_element_at(table, column)
    return found if otherwise is None else F.coalesce(found, F.lit(otherwise))


def severity_rank(column: Column) -> Column:
    return rank_of(column, SEVERITIES)


def outcome_rank(column: Column) -> Column:
    """blind 0, visible 1, detected 2, anything else -1."""
    return rank_of(column, RANKED_OUTCOMES, -1)


def priority_rank(column: Column) -> Column:
    return rank_of(column, PRIORITIES, 9)


def normalise_severity(column: Column, default: str = "medium") -> Column:
    """Lower-cased severity with short forms resolved; unknown text takes the default."""
    text = F.lower(F.btrim(column))
    for short, full in SEVERITY_ALIASES.items():
        text = F.when(text == short, F.lit(full)).otherwise(text)
    return F.when(text.isin(*SEVERITIES), text).otherwise(F.lit(default))


def gap_kind(outcome: Column) -> Column:
    return F.when(outcome == "visible", F.lit("detection")).when(
        outcome == "blind", F.lit("visibility")
    )


def is_scoreable(outcome: Column) -> Column:
    return outcome.isin(*RANKED_OUTCOMES)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Share as a double, 0 when there is nothing to divide by."""
    return F.when(
        denominator > 0, numerator.cast("double") / denominator.cast("double")
    ).otherwise(F.lit(0.0))
