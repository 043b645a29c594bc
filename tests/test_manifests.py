"""Manifests joined to the events of their corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofgrid.sources.corpus import read_corpus, read_manifests, write_corpus


def test_events_of_one_scenario_do_not_meet_in_one_task(spark, tmp_path):
    rows = spark.range(50).select(
        F.lit("t").alias("_test"), F.col("id").cast("double").alias("_offset"), F.lit("h").alias("_host"),
        F.create_map(F.lit("EventID"), F.col("id").cast("string")).alias("document"),
    )
    write_corpus(rows, str(tmp_path), "one", {"tests": ["t"], "recorded_at": "2024-02-01T00:00:00Z"})
    named = read_manifests(spark, str(tmp_path)).select(F.col("folder").alias("scenario"), "recorded_at", "tests")
    joined = read_corpus(spark, str(tmp_path)).join(named, "scenario")
    # As if the events were too many to be broadcast themselves.
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(r["offset_s"] for r in joined.where("tests[0] = 't' and recorded_at is not null").collect()) == [float(i) for i in range(50)]
