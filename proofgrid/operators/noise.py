"""Quiet-window noise against accepted allowances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.functions.literals import TextPattern


def first_noisy(cases: DataFrame) -> DataFrame:
    """Per rule, its first case (by rule, test) with quiet-window hits."""
    order = Window.partitionBy("rule").orderBy("test_id", "case_id")
    return (
        cases.filter(F.col("baseline_hits") > 0)
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") == 1)
        .drop("_n")
    )


def noise_findings(cases: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rules noisier than accepted: cases carry baseline_profile; accepted holds profile, rule, max_hits."""
    allowed = accepted.select("profile", "rule", "max_hits")
    noisy = first_noisy(cases).withColumn("profile", F.col("baseline_profile"))
    return (
        noisy.join(allowed, ["profile", "rule"], "left")
        .withColumn("allowance", F.coalesce("max_hits", F.lit(0)).cast("bigint"))
        .filter(F.col("baseline_hits") > F.col("allowance"))
        .select(
            "rule",
            F.col("baseline_hits").alias("hits"),
            "allowance",
            (F.col("baseline_hits") - F.col("allowance")).alias("excess"),
            "severity",
            "profile",
            "outcome",
        )
    )


def noisy_rules(cases: DataFrame) -> DataFrame:
    return cases.filter(F.col("baseline_hits") > 0).select("rule").distinct()


def glob_regex(pattern: str) -> str:
    return f"(?is)^{TextPattern.of(pattern).regex()}$"


def profile_of(host: Column, globs: list[tuple[str, str]]) -> Column:
    """Baseline profile of a host: the first (profile, glob) whose glob matches, else NULL."""
    return F.coalesce(
        *[F.when(host.rlike(glob_regex(glob)), F.lit(profile)) for profile, glob in globs],
        F.lit(None).cast("string"),
    )


def daily_volume(matches: DataFrame, rules: DataFrame, at: str = "ts") -> DataFrame:
    """Hits per rule and day against the declared daily volume."""
    daily = matches.groupBy("rule", F.to_date(at).alias("day")).agg(F.count(F.lit(1)).alias("hits"))
    limits = rules.select("rule", F.col("expected_daily_volume").cast("bigint").alias("expected"))
    return daily.join(limits, "rule", "left").withColumn(
        "over", F.coalesce(F.col("hits") > F.col("expected"), F.lit(False))
    )


def overdue_reviews(accepted: DataFrame, today: Column) -> DataFrame:
    """Accepted noise whose review date has passed."""
    return accepted.filter(F.to_date("review_by") < today)


def quiet_hours(matches: DataFrame, length: str = "1 hour", slide: str | None = None, at: str = "ts") -> DataFrame:
    """Hits per rule and time window; `slide` gives overlapping windows for a trend."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    return (
        matches.groupBy("rule", span.alias("w"))
        .agg(F.count(F.lit(1)).alias("hits"))
        .select("rule", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hits")
    )
