"""The sweep that counts events in windows: one sort a step, tasks that grow with the session's partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.operators.timeline import count_in_windows


def _asked(spark):
    ev = spark.createDataFrame([("a", 5), ("a", 5), ("a", 130_000_000), ("b", 7), (None, 1), ("a", None)], "key string, us bigint")
    wi = spark.createDataFrame(
        [(1, "a", 0, 10), (2, "a", 6, 130_000_000), (3, "a", 6, 129_999_999), (4, "b", 8, 9), (5, None, 0, 9), (6, "c", 0, 9), (7, "a", 5, 5)],
        "window_id int, key string, lo bigint, hi bigint",
    )
    return count_in_windows(ev, wi, ["key"], ["window_id"])


def test_counts_and_first_events(spark):
    got = sorted(map(tuple, _asked(spark).collect()))
    assert got == [(1, 2, 5), (2, 1, 130_000_000), (3, 0, None), (4, 0, None), (5, 0, None), (6, 0, None), (7, 2, 5)]


def test_one_sort_serves_both_directions(spark):
    plan = _asked(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count(" Sort [") == 2, plan


def test_sweep_is_not_put_together_by_bytes(spark):
    plan = _asked(spark)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan, plan


def test_only_buckets_with_ends_are_carried(spark):
    """A thousand buckets of events and one window: the sweep takes the moments, two ends and what two buckets carry."""
    ev = spark.range(1000).select(F.lit("a").alias("key"), (F.col("id") * 60_000_000).alias("us"))
    wi = spark.createDataFrame([(1, "a", 30_000_000, 600_000_000)], "window_id int, key string, lo bigint, hi bigint")
    asked = count_in_windows(ev, wi, ["key"], ["window_id"])
    assert [tuple(r) for r in asked.collect()] == [(1, 10, 60_000_000)]
    assert "filter" in asked._jdf.queryExecution().optimizedPlan().toString().lower() and "_asked" in asked._jdf.queryExecution().optimizedPlan().toString()
