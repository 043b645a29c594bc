"""Questions about events on a timeline, answered without pairing rows.

Counting the events inside each of many windows, finding the first event after a moment and
giving an event to one of several overlapping windows are all interval joins. A join would
emit every (event, window) pair of a key, which is quadratic when one key is hot. Here both
sides are merged into one ordered timeline per key and answered with running aggregates:

* equal moments of a key are combined first, so a burst costs one row per microsecond;
* the timeline of a key is cut into buckets of fixed length. Inside a bucket a window
  function runs; across buckets it runs over one summary row per bucket. A group therefore
  holds at most one row per microsecond of a bucket, or one row per bucket, whatever share
  of the data one key has;
* what a bucket must know of the others is one summary row, which enters its group as a row
  of its own, so that nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

BUCKET_SECONDS = 60
TIE_BUCKET = 1_000_000
SPREAD = 16
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Running:
    """One running value over a timeline.

    kind: ``sum`` (up to and including the row), ``max`` (of earlier rows only), ``last``
    (latest non-null up to the row) or ``next`` (earliest non-null from the row on).
    """

    name: str
    kind: str
    value: Column


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[Running],
    width: int = BUCKET_SECONDS * 1_000_000,
) -> DataFrame:
    """Add running values over `order` (a bigint, unique per key) for every key.

    Rows without a key or order value have no place on a timeline and are dropped. (Saying
    so here also keeps the branches below identical up to their shared shuffle, which Spark
    then runs once.)
    """
    named = {v.name: f"_in_{v.name}" for v in values}
    placed = reduce(and_, [F.col(c).isNotNull() for c in (*keys, order)])
    bucket = F.col(order) - F.pmod(F.col(order), F.lit(width).cast("bigint"))
    base = (
        df.filter(placed)
        .select("*", bucket.alias(_BUCKET), *[v.value.alias(named[v.name]) for v in values])
        .filter(F.col(_BUCKET).isNotNull())
    )
    # The bucket leads: it tells most rows apart, so sorts rarely look at the other keys.
    part = [_BUCKET, *keys]
    up = Window.partitionBy(*part).orderBy(F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(F.col(order)).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*part).orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    within = {
        "sum": lambda c: F.sum(c).over(up),
        "max": lambda c: F.max(c).over(before),
        "last": lambda c: F.last(c, ignorenulls=True).over(up),
        "next": lambda c: F.last(c, ignorenulls=True).over(down),
    }
    inside = base.select(
        *df.columns, _BUCKET, *[within[v.kind](F.col(named[v.name])).alias(named[v.name]) for v in values]
    )

    filled = lambda c: F.when(c.isNotNull(), F.col(order))
    summary = {
        "sum": F.sum,
        "max": F.max,
        "last": lambda c: F.max_by(c, filled(c)),
        "next": lambda c: F.min_by(c, filled(c)),
    }
    buckets = base.groupBy(*part).agg(
        *[summary[v.kind](F.col(named[v.name])).alias(named[v.name]) for v in values]
    )
    earlier = Window.partitionBy(*keys).orderBy(F.col(_BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(_BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    across = {
        "sum": lambda c: F.sum(c).over(earlier),
        "max": lambda c: F.max(c).over(earlier),
        "last": lambda c: F.last(c, ignorenulls=True).over(earlier),
        "next": lambda c: F.last(c, ignorenulls=True).over(later),
    }
    carried = buckets.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(part)],
        *[across[v.kind](F.col(named[v.name])).alias(f"_out_{v.name}") for v in values],
    )
    combine = {
        "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
        "max": lambda a, b: F.greatest(a, b),
        "last": lambda a, b: F.coalesce(a, b),
        "next": lambda a, b: F.coalesce(a, b),
    }
    same = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(part)]
    return inside.join(carried, same).select(
        *df.columns,
        *[combine[v.kind](F.col(named[v.name]), F.col(f"_out_{v.name}")).alias(v.name) for v in values],
    )


def within_span(events: DataFrame, windows: DataFrame, at: str = "us", start: str = "lo", end: str = "hi") -> DataFrame:
    """Only the events between the first start and the last end of all windows.

    The two bounds are scalar subqueries: Spark runs them first and filters in the scan.
    Worth it when the windows cover a small part of the data.
    """
    low = windows.agg(F.min(start)).scalar()
    high = windows.agg(F.max(end)).scalar()
    return events.filter(F.col(at).between(low, high))


def on_days(events: DataFrame, windows: DataFrame, day: str = "day", start: str = "lo", end: str = "hi") -> DataFrame:
    """Only the events of the days that some window touches.

    `day` is the date column an event table is clustered by (see `sources.clustered`); starts
    and ends are microseconds. Spark hands the days to the scan, which then opens no other
    folder. The broadcast side has one row per day of the calendar that is touched.
    """
    date = lambda c: F.to_date(F.timestamp_micros(c))
    spans = windows.filter(F.col(start) <= F.col(end)).select(date(start).alias("_from"), date(end).alias("_to")).distinct()
    days = spans.select(F.explode(F.sequence("_from", "_to")).alias(day)).distinct()
    return events.join(F.broadcast(days), day, "left_semi")


def moments(events: DataFrame, keys: Sequence[str], at: str, points: DataFrame | None = None) -> DataFrame:
    """One row per (key, moment) with the number of events there; `points` add empty moments."""
    marked = events.select(*keys, F.col(at).alias("at"), F.lit(1).cast("bigint").alias("n"))
    if points is not None:
        marked = marked.unionByName(
            points.select(*keys, F.col("at"), F.lit(0).cast("bigint").alias("n"))
        )
    return marked.groupBy(*keys, "at").agg(F.sum("n").alias("n"))


def _bucket_of(at: Column, width: int) -> Column:
    return at - F.pmod(at, F.lit(width).cast("bigint"))


def count_in_windows(
    events: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    ids: Sequence[str],
    at: str = "us",
    start: str = "lo",
    end: str = "hi",
    bucket_seconds: int = BUCKET_SECONDS,
    label: str | None = None,
    labels: Sequence[str] = (),
    spread: int = 1,
) -> DataFrame:
    """For every window, the number of its key's events in [start, end] and the first one.

    `ids` names the columns that identify a window. Result columns: `ids`, ``hits`` and
    ``first_us`` (NULL without hits).

    Several windows of one id can be asked together: `label` is the column that tells them
    apart and `labels` its values; the result then has ``hits_<label>`` and
    ``first_us_<label>`` (NULL for a window that was not asked).

    A sweep: moments, both ends of the windows and what each bucket carries over from the
    others lie in one order per (key, bucket), where one sort serves both the running count
    and the next event. Its rows go to all partitions of the session: they compress so well
    that tasks put together by their bytes would hold millions of them. Where very many
    windows begin or end in one bucket of one key, `spread` deals them to so many groups, each
    with its own copy of the bucket's moments.
    """
    width = bucket_seconds * 1_000_000
    named = [*ids, *([label] if label else [])]
    # A window without a key, start or end holds nothing, but is answered.
    placed = reduce(and_, [F.col(c).isNotNull() for c in (*keys, start, end)])
    # At one moment windows open before its events and close after them.
    sides = F.inline(F.array(*[
        F.struct(F.col(c).alias("at"), F.lit(rank).alias("rank")) for rank, c in ((0, start), (2, end))
    ]))
    shape = [*named, *[k for k in keys if k not in named]]
    none = F.lit(None).cast("bigint")
    ends = windows.filter(placed).select(*shape, sides).withColumns(
        {_BUCKET: _bucket_of(F.col("at"), width), "n": F.lit(0).cast("bigint"), "next_at": none}
    )
    nowhere = windows.filter(~placed).select(*named, sides).select(
        *named, "rank", F.lit(0).cast("bigint").alias("upto"), none.alias("next_at")
    )

    here = reduce(and_, [F.col(c).isNotNull() for c in (*keys, "at")])
    counted = moments(events, keys, at).filter(here).withColumns(
        {_BUCKET: _bucket_of(F.col("at"), width), "rank": F.lit(1), "next_at": F.col("at")}
    )
    group = [_BUCKET, *keys]
    # Ends add empty buckets, so that what is carried reaches them; buckets without ends ask for nothing.
    totals = (
        counted.select(*group, "n", "next_at", F.lit(False).alias("_asked"))
        .unionByName(ends.select(*group, "n", "next_at", F.lit(True).alias("_asked")))
        .groupBy(*group)
        .agg(F.sum("n").alias("n"), F.min("next_at").alias("next_at"), F.max("_asked").alias("_asked"))
    )
    # The first value after a row, in the order that the running sums have.
    following = F.expr("lead(next_at) IGNORE NULLS")
    by_bucket = Window.partitionBy(*keys).orderBy(_BUCKET)
    earlier = by_bucket.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        totals.select(
            *group, "_asked", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), following.over(by_bucket).alias("_next")
        )
        .filter("_asked")
        .select(*group, F.col(_BUCKET).alias("at"), F.lit(-1).alias("rank"), "n", none.alias("next_at"), "_next")
    )
    line = counted.unionByName(carried, allowMissingColumns=True)
    if spread > 1:
        line = line.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
        ends = ends.withColumn("_slot", F.pmod(F.xxhash64(*named), F.lit(spread)).cast("int"))
        group = [*group, "_slot"]
    tasks = int(line.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = line.unionByName(ends, allowMissingColumns=True).repartition(tasks, *group)
    by_moment = Window.partitionBy(*group).orderBy("at", "rank")
    up = by_moment.rowsBetween(Window.unboundedPreceding, 0)
    answers = line.select(
        *named, "rank", F.sum("n").over(up).alias("upto"),
        F.coalesce(following.over(by_moment), F.max("_next").over(up)).alias("next_at"),
    ).filter(F.col("rank").isin(0, 2))
    answers = answers.unionByName(nowhere)

    opens = F.col("rank") == 0
    picks, results = [], []
    for name in labels if label else [""]:
        tail = f"_{name}" if name else ""
        asked = F.col(label) == name if label else F.lit(True)
        picks += [
            F.max(F.when(asked & ~opens, F.col("upto"))).alias(f"_upto{tail}"),
            F.max(F.when(asked & opens, F.col("upto"))).alias(f"_below{tail}"),
            F.max(F.when(asked & opens, F.col("next_at"))).alias(f"_next{tail}"),
        ]
        hits = F.col(f"_upto{tail}") - F.col(f"_below{tail}")
        results += [
            hits.alias(f"hits{tail}"),
            F.when(hits > 0, F.col(f"_next{tail}")).alias(f"first_us{tail}"),
        ]
    return answers.groupBy(*ids).agg(*picks).select(*ids, *results)


def first_in_windows(
    events: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    limit: int,
    tie: str,
    at: str = "us",
    start: str = "lo",
    end: str = "hi",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """The first `limit` events of each window, by moment and then by `tie`.

    Events of a key are numbered along the timeline; a window's events are the numbers after
    the count below its start, so each window asks for `limit` numbers and nothing else.
    Only the first `limit` events of one moment can ever be among them.
    """
    at_moment = Window.partitionBy(*keys, at).orderBy(F.col(tie))
    placed = reduce(and_, [F.col(c).isNotNull() for c in (*keys, at)])
    kept = (
        events.filter(placed)
        .withColumn("_place", F.row_number().over(at_moment))
        .filter(F.col("_place") <= limit)
    )
    starts = windows.select(*keys, F.col(start).alias("at"))
    below = running(
        moments(kept, keys, at, starts),
        keys,
        "at",
        [Running("upto", "sum", F.col("n"))],
        bucket_seconds * 1_000_000,
    ).select(*keys, "at", (F.col("upto") - F.col("n")).alias("_below"))
    numbered = (
        kept.join(below.withColumnRenamed("at", at), [*keys, at])
        .withColumn("_number", F.col("_below") + F.col("_place"))
        .drop("_below", "_place")
    )
    wanted = (
        windows.join(below.withColumnRenamed("at", start), [*keys, start])
        .select(
            *windows.columns,
            F.posexplode(F.sequence(F.col("_below") + 1, F.col("_below") + limit)).alias("place", "_number"),
        )
    )
    extra = [c for c in numbered.columns if c not in keys and c != "_number"]
    return (
        wanted.join(numbered, [*keys, "_number"])
        .filter(F.col(at) <= F.col(end))
        .select(*windows.columns, (F.col("place") + 1).alias("place"), *extra)
    )


def attribute_events(
    events: DataFrame,
    windows: DataFrame,
    keys: Sequence[str],
    payload: Sequence[str],
    at: str = "us",
    start: str = "lo",
    end: str = "hi",
    tie: str = "window_id",
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Give each event to one window of its key, the earliest start; drop events in none.

    `payload` names the window columns added to the event. Windows that start together are
    taken in the order of `tie`.

    Of the windows that end at or after an event, the one that starts earliest owns it if it
    starts in time; if it doesn't, no window covers the event. So one pass from late to early
    with a running minimum over the windows, placed at their ends, answers all events. Events
    only read that minimum: those of one bucket of one key are dealt to SPREAD groups, each
    with its own copy of the bucket's windows.
    """
    width = bucket_seconds * 1_000_000
    group = [_BUCKET, *keys]
    known = reduce(and_, [F.col(c).isNotNull() for c in (*keys, start, end)])
    value = F.struct(F.col(start).alias("_lo"), F.col(tie).alias("_tie"), *[F.col(c).alias(f"_p{i}") for i, c in enumerate(payload)])
    # Of windows that end together only the first can own anything.
    ends = (
        windows.filter(known)
        .groupBy(*keys, F.col(end).alias("_at"))
        .agg(F.min(value).alias("_window"))
        .withColumn(_BUCKET, _bucket_of(F.col("_at"), width))
    )
    here = reduce(and_, [F.col(c).isNotNull() for c in (*keys, at)])
    placed = events.filter(here).withColumns({_BUCKET: _bucket_of(F.col(at), width), "_at": F.col(at)})
    found = (
        placed.select(*group)
        .unionByName(ends.select(*group, "_window"), allowMissingColumns=True)
        .groupBy(*group)
        .agg(F.min("_window").alias("_window"))
    )
    later = Window.partitionBy(*keys).orderBy(F.col(_BUCKET).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = found.select(
        *group, (F.col(_BUCKET) + (width - 1)).alias("_at"), F.min("_window").over(later).alias("_window")
    ).filter(F.col("_window").isNotNull())
    slots = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    plain = [f.name for f in events.schema.fields if isinstance(f.dataType, AtomicType) and f.dataType.typeName() != "variant"]
    rows = ends.withColumn("_rank", F.lit(1)).unionByName(carried.withColumn("_rank", F.lit(2))).withColumn("_slot", slots)
    line = placed.withColumns({"_rank": F.lit(0), "_slot": F.pmod(F.xxhash64(*plain), F.lit(SPREAD)).cast("int")}).unionByName(
        rows, allowMissingColumns=True
    )
    down = Window.partitionBy(*group, "_slot").orderBy(F.desc("_at"), F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    owned = line.withColumn("_window", F.min("_window").over(down)).filter((F.col("_rank") == 0) & (F.col("_window._lo") <= F.col("_at")))
    return owned.select(*events.columns, *[F.col(f"_window._p{i}").alias(c) for i, c in enumerate(payload)])
