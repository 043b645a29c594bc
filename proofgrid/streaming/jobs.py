"""Streaming forms of the batch operators.

Matching is stateless and reuses the batch plan. Aggregates keep state per (rule, window) or
(source, host) and combine on the map side first, so a hot host costs one state row per
micro-batch. Sinks are idempotent: a replayed micro-batch overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofgrid import vocabulary as V
from proofgrid.functions.fields import EventFields
from proofgrid.operators.cases import classify, observe
from proofgrid.operators.heartbeat import heartbeat, observations
from proofgrid.operators.rules import Ruleset, Source, match_rules, measure_rules


def rule_hits(
    events: DataFrame,
    ruleset: Ruleset,
    fields: EventFields,
    keep: Sequence[str],
    identity: str,
    at: str,
    delay: str,
    arrived: str | None = None,
) -> DataFrame:
    """Hits of every rule; an event delivered twice within the delay counts once.

    Removing repeats drops rows behind the watermark. With `arrived`, the column of arrival times, rows that come later than
    the delay pass beside it: their hits are kept, marked `late`, and may repeat.
    """
    once = lambda rows: rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([identity])
    if arrived is None:
        return match_rules(once(events), ruleset, fields, keep)
    timely, late = split_late(events, at, arrived, delay)
    hits = match_rules(once(timely), ruleset, fields, keep).withColumn("late", F.lit(False))
    return hits.unionByName(match_rules(late, ruleset, fields, keep).withColumn("late", F.lit(True)))


def split_late(events: DataFrame, at: str, arrived: str, allowed: str) -> tuple[DataFrame, DataFrame]:
    """(in time, late) by arrival against event time.

    Stateful steps drop rows behind the watermark without a trace; splitting them off first
    keeps them in a table of their own.
    """
    late = F.col(arrived) > F.col(at) + F.expr(f"INTERVAL {allowed}")
    return events.filter(~late), events.filter(late)


def noise_windows(hits: DataFrame, at: str, delay: str, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Hits per rule and window, final once the watermark passes the window's end."""
    span = F.window(at, length, slide) if slide else F.window(at, length)
    counted = hits.withWatermark(at, delay).groupBy("rule", span.alias("w")).agg(F.count(F.lit(1)).alias("hits"))
    return counted.select("rule", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "hits")


def last_seen(events: DataFrame, sources: Sequence[Source], fields: EventFields, host: Column) -> DataFrame:
    """Running last time and count per (source, host); run it in update mode."""
    return (
        observations(events, sources, fields, host)
        .groupBy("source", "host")
        .agg(F.max("us").alias("last_us"), F.count(F.lit(1)).alias("events"))
    )


def beats_from_state(state: DataFrame, inventory: DataFrame | None, as_of_us: Column | None, policy: dict | None) -> DataFrame:
    """Beats from the latest running rows: the counts are already folded."""
    seen = state.select("source", "host", F.col("last_us").alias("us"))
    beats = heartbeat(seen, inventory, as_of_us, policy).drop("events")
    return beats.join(state.select("source", "host", "events"), ["source", "host"], "left").fillna(0, ["events"])


# --------------------------------------------------------------------- sinks


def append_table(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append-mode Parquet sink with exactly-once files."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path)
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def batch_table(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    mode: str = "update",
    transform: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Write each micro-batch under its own batch_id folder, replacing an earlier attempt."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if transform is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
            return
        # A transformation may read the batch several times; the source is read once.
        kept = batch.persist()
        try:
            transform(kept).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_rows(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Newest version of every key from a table written by `batch_table` in update mode."""
    rows = spark.read.parquet(path)
    body = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*body), "batch_id").alias("_r"))
    return newest.select(*keys, "_r.*")


# --------------------------------------------------------------------- cases


def case_progress(
    events: DataFrame,
    cases: DataFrame,
    ruleset: Ruleset,
    fields_of: Callable[[DataFrame], EventFields],
    attribution: str | None,
    path: str,
    checkpoint: str,
    available_now: bool = True,
    identity: str | None = None,
    at: str = "ts",
    delay: str = "1 hour",
) -> StreamingQuery:
    """Fold each micro-batch into the cases it touches: hits, probe events, first match.

    With `identity`, an event delivered again within `delay` of its time `at` counts once. The micro-batch is an ordinary DataFrame, so it is counted with the batch operator and
    only one row per touched case is written.
    """

    def fold(batch: DataFrame) -> DataFrame:
        # Only cases whose window meets the batch's time span are looked at.
        first, last = batch.agg(F.min("us"), F.max("us")).first()
        if first is None:
            return cases.limit(0).select(
                "case_id", *[F.lit(0).cast("long").alias(c) for c in ("detection_hits", "telemetry_hits", "first_us")]
            )
        near = cases.filter((F.col("hi") >= F.lit(first)) & (F.col("lo") <= F.lit(last)))
        keep = ["us"] + ([attribution] if attribution else [])
        marked = measure_rules(batch, ruleset, fields_of(batch), keep)
        seen = observe(near, marked, ruleset, attribution=attribution)
        touched = seen.filter((F.col("detection_hits") > 0) | (F.col("telemetry_hits") > 0))
        return touched.select("case_id", "detection_hits", "telemetry_hits", "first_us")

    if identity is not None:
        events = events.withWatermark(at, delay).dropDuplicatesWithinWatermark([identity])
    return batch_table(events, path, checkpoint, "append", fold, available_now)


def case_verdicts(progress: DataFrame, cases: DataFrame, as_of_us: Column, ingest_lag: float = V.INGEST_LAG) -> DataFrame:
    """Verdicts as of a moment: a hit settles a case at once, silence only after its window.

    Open cases have outcome NULL and `pending` true. The moment is part of the result, so
    that a verdict by silence can be traced to the clock that declared it.
    """
    folded = progress.groupBy("case_id").agg(
        F.sum("detection_hits").alias("detection_hits"),
        F.sum("telemetry_hits").alias("telemetry_hits"),
        F.min("first_us").alias("first_us"),
    )
    full = cases.join(folded, "case_id", "left").fillna(0, ["detection_hits", "telemetry_hits"])
    closed = F.col("hi") + F.lit(int(ingest_lag * 1e6)) <= F.col("as_of_us")
    settled = classify(full.withColumn("as_of_us", as_of_us))
    pending = ~(closed | (F.col("outcome") == "detected"))
    columns = ("outcome", "status", "confidence", "latency")
    return settled.withColumn("pending", pending).withColumns(
        {c: F.when(~F.col("pending"), F.col(c)) for c in columns}
    )
