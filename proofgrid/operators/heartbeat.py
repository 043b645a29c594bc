"""Liveness of every host on every log source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.functions.fields import EventFields
from proofgrid.functions.predicates import selection, selection_fields
from proofgrid.operators.rules import Source


def observations(events: DataFrame, sources: Sequence[Source], fields: EventFields, host: Column, at: str = "us") -> DataFrame:
    """(source, host, us) for every source an event belongs to, from one scan for all sources."""
    scoped = [s for s in sources if s.scope]
    events, fields = fields.project(events, [n for s in scoped for n in selection_fields(s.scope)])
    names = [F.when(selection(fields, s.scope), F.lit(s.id)) for s in scoped]
    return events.select(
        F.explode(F.array_compact(F.array(*names))).alias("source"), host.alias("host"), F.col(at).alias("us")
    ).filter(F.col("host").isNotNull() & F.col("us").isNotNull())


def corpus_observations(events: DataFrame, corpora: DataFrame) -> DataFrame:
    """Recorded events on absolute time: the recording start plus each offset.

    Recordings without a start are left out. `events` has scenario and offset_s, `corpora`
    scenario and recorded_at.
    """
    started = corpora.filter(F.col("recorded_at").isNotNull()).select("scenario", "recorded_at")
    return events.join(started, "scenario").withColumn(
        "us", F.unix_micros("recorded_at") + F.round(F.col("offset_s") * 1e6).cast("bigint")
    )


def beat_state(age: Column, interval: Column, grace: Column) -> Column:
    return (
        F.when(age.isNull(), F.lit("silent"))
        .when(age <= interval, F.lit("alive"))
        .when(age <= interval * grace, F.lit("late"))
        .otherwise(F.lit("silent"))
    )


def heartbeat(
    seen: DataFrame,
    inventory: DataFrame | None = None,
    as_of_us: Column | None = None,
    policy: Mapping[str, tuple[float, float]] | None = None,
    interval: float = V.BEAT_INTERVAL,
    grace: float = V.BEAT_GRACE,
) -> DataFrame:
    """One beat per (source, host): last seen, count, age and state.

    `inventory` holds the (source, host) pairs that should report; those never heard from
    are silent with no age. Without `as_of_us` each source is judged at its own latest
    event. `policy` gives per-source interval and grace, which win over the arguments.
    """
    folded = seen.groupBy("source", "host").agg(F.max("us").alias("last_us"), F.count(F.lit(1)).alias("events"))
    if inventory is not None:
        expected = inventory.select("source", "host").distinct()
        folded = folded.join(expected, ["source", "host"], "full_outer")
    if as_of_us is None:
        latest = folded.groupBy("source").agg(F.max("last_us").alias("as_of_us"))
        folded = folded.join(latest, "source", "left")
    else:
        folded = folded.withColumn("as_of_us", as_of_us)

    def by_source(position: int, default: float) -> Column:
        out = F.lit(float(default))
        for source, values in (policy or {}).items():
            out = F.when(F.col("source") == source, F.lit(float(values[position]))).otherwise(out)
        return out

    age = F.greatest((F.col("as_of_us") - F.col("last_us")) / F.lit(1e6), F.lit(0.0))
    return folded.select(
        "source",
        "host",
        "last_us",
        F.coalesce("events", F.lit(0)).alias("events"),
        F.when(F.col("last_us").isNotNull(), age).alias("age_s"),
        by_source(0, interval).alias("interval_s"),
        by_source(1, grace).alias("grace"),
        "as_of_us",
    ).withColumn("state", beat_state(F.col("age_s"), F.col("interval_s"), F.col("grace")))


def source_policy(sources: Sequence[Source], interval: float = V.BEAT_INTERVAL, grace: float = V.BEAT_GRACE) -> dict[str, tuple[float, float]]:
    return {
        s.id: (s.interval if s.interval is not None else interval, s.grace if s.grace is not None else grace)
        for s in sources
        if s.interval is not None or s.grace is not None
    }


def heartbeat_counts(beats: DataFrame) -> DataFrame:
    """Beats of each state per source, whether the source is healthy, and its as-of time."""
    return beats.groupBy("source").agg(
        *[F.count_if(F.col("state") == s).alias(s) for s in V.BEAT_STATES],
        (F.count_if(F.col("state") == "silent") == 0).alias("healthy"),
        F.max("as_of_us").alias("as_of_us"),
    )


def worst_first(beats: DataFrame) -> DataFrame:
    return beats.orderBy(V.rank_of(F.col("state"), V.BEAT_STATES, 9), "host")


def hosts_seen(events: DataFrame, host: Column) -> DataFrame:
    return events.select(host.alias("host")).filter(F.col("host").isNotNull()).distinct()


def lookback_seconds(interval: float, grace: float) -> float:
    """How far back a live query must read to decide a beat."""
    return interval * max(grace, 1.0) * 2
