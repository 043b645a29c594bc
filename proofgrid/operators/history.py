"""Results across runs: latest and previous, diffs, rule changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid import vocabulary as V

CASE = ["rule", "test_id"]


def latest_outcomes(history: DataFrame) -> DataFrame:
    """Result of every (rule, test) in its most recent run of any profile; ties stay."""
    recent = Window.partitionBy(*CASE).orderBy(F.col("started_at").desc())
    return history.withColumn("_n", F.rank().over(recent)).filter(F.col("_n") == 1).drop("_n")


def worst_outcomes(history: DataFrame) -> DataFrame:
    """Per rule, the worst of its tests' latest outcomes; operational states are ignored."""
    ranked = latest_outcomes(history).filter(V.is_scoreable(F.col("outcome")))
    return ranked.groupBy("rule").agg(F.min_by("outcome", V.outcome_rank(F.col("outcome"))).alias("outcome"))


def rule_history(history: DataFrame, limit: int = 30) -> DataFrame:
    """The last `limit` results of every rule, numbered oldest first."""
    newest = Window.partitionBy("rule").orderBy(F.col("started_at").desc(), F.col("run_id").desc(), F.col("test_id").desc())
    kept = history.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= limit)
    oldest = Window.partitionBy("rule").orderBy(F.col("_n").desc())
    return kept.withColumn("position", F.row_number().over(oldest)).drop("_n")


def list_runs(runs: DataFrame, limit: int, profile: str | None = None, backend: str | None = None) -> DataFrame:
    for column, wanted in (("profile", profile), ("backend", backend)):
        if wanted is not None:
            runs = runs.filter(F.col(column) == wanted)
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("profile").agg(
        F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"), F.max("started_at").alias("started_at")
    )


def previous_runs(runs: DataFrame) -> DataFrame:
    """Every run with the run of its profile before it."""
    order = Window.partitionBy("profile").orderBy("started_at", "run_id")
    return runs.withColumn("previous_run_id", F.lag("run_id").over(order))


def delta_kind(before: Column, after: Column, before_latency: Column, after_latency: Column) -> Column:
    """Kind of change of one case; outcomes are NULL where the case is absent."""
    old, new = V.outcome_rank(before), V.outcome_rank(after)
    slower = (
        (after == "detected")
        & (before_latency != 0)
        & (after_latency > F.greatest(before_latency * V.SLOWDOWN_FACTOR, F.lit(V.SLOWDOWN_FLOOR)))
    )
    return (
        F.when(before.isNull(), F.lit("new"))
        .when(after.isNull(), F.lit("removed"))
        .when((old < 0) | (new < 0), F.lit("unchanged"))
        .when(new < old, F.lit("regression"))
        .when(new > old, F.lit("improvement"))
        .when(F.coalesce(slower, F.lit(False)), F.lit("slower"))
        .otherwise(F.lit("unchanged"))
    )


def delta_note(kind: Column, after: Column) -> Column:
    return (
        F.when((kind == "regression") & (after == "blind"), F.lit("source went dark"))
        .when((kind == "regression") & (after == "visible"), F.lit("source present, rule no longer matches"))
        .when(kind == "new", F.lit("first result of this case"))
        .when(kind == "slower", F.lit("detected much later than before"))
        .when(kind == "removed", F.lit("no longer planned"))
        .otherwise(F.lit(""))
    )


def diff_cases(current: DataFrame, previous: DataFrame, keys: list[str] = CASE, include_unchanged: bool = False) -> DataFrame:
    """Case by case change; both sides hold `keys`, outcome, latency and severity."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(prefix + c) for c in ("outcome", "latency", "severity")])

    both = side(current, "after_").join(side(previous, "before_"), keys, "full_outer")
    kind = delta_kind(*[F.col(c) for c in ("before_outcome", "after_outcome", "before_latency", "after_latency")])
    out = both.withColumn("kind", kind)
    if not include_unchanged:
        out = out.filter(F.col("kind") != "unchanged")
    return out.select(
        *keys,
        "kind",
        F.col("before_outcome").alias("before"),
        F.col("after_outcome").alias("after"),
        "before_latency",
        "after_latency",
        F.coalesce("after_severity", "before_severity").alias("severity"),
        delta_note(F.col("kind"), F.col("after_outcome")).alias("note"),
    )


def first_run_deltas(current: DataFrame, keys: list[str] = CASE) -> DataFrame:
    """A first run has nothing to compare with: only its gaps are reported, as new."""
    gaps = current.filter(F.col("outcome").isin("visible", "blind"))
    empty = current.sparkSession.createDataFrame([], current.schema)
    return diff_cases(gaps, empty, keys)


def diff_history(history: DataFrame, runs: DataFrame, include_unchanged: bool = False) -> DataFrame:
    """Every run against the previous run of its profile, in one pass over the history.

    `runs` comes from `previous_runs`. The history meets itself on (run, case): each result
    is compared with the result of the same case one run earlier.
    """
    links = runs.select("run_id", "previous_run_id")
    now = history.join(links, "run_id")
    first = now.filter(F.col("previous_run_id").isNull() & F.col("outcome").isin("visible", "blind"))
    # A result is the "before" of the run that follows its own.
    following = links.filter(F.col("previous_run_id").isNotNull()).select(
        F.col("run_id").alias("_next"), F.col("previous_run_id").alias("run_id")
    )
    before = history.join(following, "run_id").drop("run_id").withColumnRenamed("_next", "run_id")
    later = now.filter(F.col("previous_run_id").isNotNull())
    keys = ["run_id", *CASE]
    return diff_cases(later.unionByName(first), before, keys, include_unchanged)


def diff_counts(deltas: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Number of deltas of each kind, zeros included; one column per kind without keys as rows."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in V.DELTA_KINDS]
    wide = deltas.groupBy(*keys).agg(*counts)
    ids = [F.col(k) for k in keys]
    return wide.unpivot(ids, list(V.DELTA_KINDS), "kind", "n")


def order_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.orderBy(V.rank_of(F.col("kind"), V.DELTA_KINDS), "rule")


def logic_changes(current: DataFrame, previous: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Rule logic added or removed between two sets of (rule, fingerprint), for each value of the columns `within`."""
    columns = [*within, "rule", "fingerprint"]
    now, then = current.select(*columns), previous.select(*columns)
    added = now.subtract(then).withColumn("change", F.lit("added"))
    return added.unionByName(then.subtract(now).withColumn("change", F.lit("removed")))


def duplicate_keys(df: DataFrame, key: str, sharer: str) -> DataFrame:
    """Keys carried by more than one row, with each sharer as its own row."""
    repeated = (
        df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
    return df.select(key, sharer).join(repeated, key)
