"""Recording events into a replayable corpus, and replaying one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.functions.fields import EventFields
from proofgrid.functions.scalars import HOST_KEYS, redact
from proofgrid.operators.timeline import TIE_BUCKET, Running, attribute_events, running


def window_span(windows: DataFrame, keys: Sequence[str] = (), start: str = "lo", end: str = "hi") -> DataFrame:
    """The one window that covers all of them."""
    return windows.groupBy(*keys).agg(F.min(start).alias("span_lo"), F.max(end).alias("span_hi"))


def offset_seconds(at_us: Column, anchor_us: Column) -> Column:
    return F.round((at_us - anchor_us) / F.lit(1e6), 3)


def capture(
    events: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    document: str,
    redact_terms: Sequence[str] = (),
    identity: str = "event_id",
) -> DataFrame:
    """Events inside the capture windows as corpus rows, each once.

    `events` has `identity`, `keys`, us, host and `document` (map of texts); `windows` has
    window_id (bigint), test_id, anchor_us, lo, hi and `keys`. Events without a time or
    outside every window are dropped; overlaps go to the window that starts first. An event
    that several sources delivered is written once.
    """
    timed = events.filter(F.col("us").isNotNull()).dropDuplicates([identity])
    owned = attribute_events(timed, windows, keys, ["test_id", "anchor_us"])
    kept = redact(F.map_filter(F.col(document), lambda k, _: k != "_time"), redact_terms)
    # The host is read from the redacted document where it has one, so that a hidden name stays hidden.
    named = [F.nullif(F.try_element_at(kept, F.lit(key)), F.lit("")) for key in HOST_KEYS]
    return owned.select(
        identity,
        F.col("test_id").alias("_test"),
        offset_seconds(F.col("us"), F.col("anchor_us")).alias("_offset"),
        F.coalesce(*named, F.col("host")).alias("_host"),
        kept.alias("document"),
    )


def capture_profile(recorded: DataFrame, risky_fields: Sequence[str] = ()) -> DataFrame:
    """Per test: events, hosts, time range, and how many rows fill each value-risk field."""
    filled = [
        F.count_if(F.coalesce(F.try_element_at("document", F.lit(name)) != "", F.lit(False))).alias(f"with_{name}")
        for name in risky_fields
    ]
    return recorded.groupBy("_test").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_distinct("_host").alias("hosts"),
        F.min("_offset").alias("first_offset"),
        F.max("_offset").alias("last_offset"),
        *filled,
    )


def summary(fields: EventFields, names: Sequence[str], limit: int = 6) -> Column:
    """A compact map of an event: the named fields that have a value, else its first flat fields.

    VARIANT documents keep their keys in sorted order, so "first" is by name.
    """
    named = F.map_filter(
        F.create_map(*[part for n in names for part in (F.lit(n), fields.locate(n).text)])
        if names
        else F.create_map().cast("map<string,string>"),
        lambda _, v: v.isNotNull(),
    )
    if fields.document is None:
        flat = F.create_map(*[part for c in fields.columns for part in (F.lit(c), F.col(f"`{c}`").cast("string"))])
    else:
        nested = F.try_variant_get(fields.document, "$", "map<string,variant>")
        scalars = F.map_filter(nested, lambda _, v: ~F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)<"))
        flat = F.transform_values(scalars, lambda _, v: F.try_variant_get(v, "$", "string"))
    return F.when(F.size(named) > 0, named).otherwise(F.map_from_entries(F.slice(F.map_entries(flat), 1, limit)))


def source_caps(events: DataFrame, cap: int) -> DataFrame:
    """Which sources a search with this cap would have left incomplete."""
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("events")).withColumn("incomplete", F.col("events") > cap)


def rebase(events: DataFrame, anchors: DataFrame, baseline_us: Column | None = None) -> DataFrame:
    """Recorded events on a run's timeline: the anchor of their test plus their offset.

    `events` has test_id and offset_s, `anchors` test_id and anchor_us. Events of tests that
    did not run disappear; baseline events use the baseline anchor.
    """
    placed = events.join(anchors.select("test_id", "anchor_us"), "test_id", "left")
    anchor = F.col("anchor_us")
    if baseline_us is not None:
        anchor = F.when(F.col("test_id") == V.BASELINE_TEST, baseline_us).otherwise(anchor)
    return (
        placed.withColumn("anchor_us", anchor)
        .filter(F.col("anchor_us").isNotNull())
        .withColumn("us", F.col("anchor_us") + F.round(F.col("offset_s") * 1e6).cast("bigint"))
        .drop("anchor_us")
    )


def result_cap(events: DataFrame, keys: Sequence[str], cap: int) -> DataFrame:
    """Kept, total and truncation per search key for a result cap, from counts alone."""
    total = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return total.withColumns(
        {"kept": F.least(F.col("total"), F.lit(cap)), "truncated": F.col("total") > F.lit(cap)}
    )


def capped_events(events: DataFrame, keys: Sequence[str], order: str, cap: int) -> DataFrame:
    """The first `cap` events of each search key by `order`, a bigint unique per key. Events without a key or order
    value belong to no search and are left out.

    Up to a thousand, Spark keeps only `cap` rows per key on each map side. Beyond that the
    events are numbered bucket by bucket, so that no task receives all events of a key.
    """
    if cap <= 1000:
        place = Window.partitionBy(*keys).orderBy(order)
        placed = reduce(and_, [F.col(c).isNotNull() for c in (*keys, order)])
        return events.filter(placed).withColumn("place", F.row_number().over(place)).filter(F.col("place") <= cap)
    numbered = running(events, keys, order, [Running("place", "sum", F.lit(1))], TIE_BUCKET)
    return numbered.filter(F.col("place") <= cap)
