"""Queries: the streaming jobs run over the events table to its end (available-now)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.operators.noise import quiet_hours
from proofgrid.plans.telemetry import (
    RULES,
    SOURCES,
    Query,
    planned,
    telemetry,
    telemetry_fields,
    with_events,
    with_results,
)
from proofgrid.session import cut_lineage, shared_folder
from proofgrid.streaming import jobs


def work_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/proofgrid/{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ts = F.col("ts").cast("timestamp")
    return raw.select(
        "event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), "user_id", "event_type", "value",
        F.try_parse_json("props").alias("doc"),
    )


def finish(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def stream_rule_hits(spark, sf_dir):
    events, folder = event_stream(spark, sf_dir), work_folder(spark)
    hits = jobs.rule_hits(events, RULES, telemetry_fields(events), ["event_id", "user_id"], "event_id", "ts", "1 hour")
    finish(jobs.append_table(hits, f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "rule")


def stream_heartbeat(spark, sf_dir):
    events, folder = event_stream(spark, sf_dir), work_folder(spark)
    seen = jobs.last_seen(events, list(SOURCES.values()), telemetry_fields(events), F.col("user_id").cast("string"))
    finish(jobs.batch_table(seen, f"{folder}/out", f"{folder}/checkpoint", "update"))
    return jobs.latest_rows(spark, f"{folder}/out", ["source", "host"])


def stream_noise(spark, sf_dir):
    """Hits per rule and six-hour window; only windows the watermark closed are final."""
    events, folder = event_stream(spark, sf_dir), work_folder(spark)
    hits = jobs.match_rules(events, RULES, telemetry_fields(events), ["ts"])
    finish(jobs.append_table(jobs.noise_windows(hits, "ts", "1 hour", "6 hours"), f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out").select(
        "rule", F.unix_micros("window_start").alias("start_us"), "hits"
    )


STREAM_NOISE_SQL = with_events(
    """
SELECT rule, us - us % 21600000000 AS start_us, count(*) AS hits FROM hits GROUP BY 1, 2
HAVING us - us % 21600000000 + 21600000000 <= (SELECT max(us) - 3600000000 FROM hits)"""
)


def stream_late(spark, sf_dir):
    """Events that arrive up to fifty minutes after their time, split at twenty minutes."""
    events, folder = event_stream(spark, sf_dir), work_folder(spark)
    delay = F.expr("make_dt_interval(0, 0, CAST(floor(value) % 50 AS INT), 0)")
    arriving = events.withColumn("arrived", F.col("ts") + delay)
    _, late = jobs.split_late(arriving, "ts", "arrived", "20 MINUTES")
    finish(jobs.append_table(late.select("event_id", "event_type"), f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.parquet(f"{folder}/out")


def stream_cases(spark, sf_dir):
    """Verdicts from streamed progress, as of 2024-01-20: later cases without a hit are open."""
    folder = work_folder(spark)
    cases = cut_lineage(planned(telemetry(spark, sf_dir)))
    finish(
        jobs.case_progress(
            event_stream(spark, sf_dir), cases, RULES, telemetry_fields, "user_id", f"{folder}/out", f"{folder}/checkpoint"
        )
    )
    progress = spark.read.parquet(f"{folder}/out")
    as_of = F.unix_micros(F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return jobs.case_verdicts(progress, cases, as_of).select("case_id", "pending", "outcome", "status", "latency")


STREAM_CASES_SQL = with_results(
    """
SELECT case_id, pending, CASE WHEN NOT pending THEN outcome END AS outcome, CASE WHEN NOT pending THEN status END AS status,
  CASE WHEN NOT pending THEN latency END AS latency
FROM (SELECT *, NOT (hi + 60000000 <= epoch_us(TIMESTAMP '2024-01-20 00:00:00') OR outcome = 'detected') AS pending FROM res)"""
)


def noise_by_hour(spark, sf_dir):
    """Batch counterpart with tumbling and sliding windows."""
    events = telemetry(spark, sf_dir)
    found = jobs.match_rules(events, RULES, telemetry_fields(events), ["ts"])
    hourly = quiet_hours(found, "1 hour").withColumn("kind", F.lit("tumbling"))
    sliding = quiet_hours(found, "2 hours", "1 hour").withColumn("kind", F.lit("sliding"))
    return hourly.unionByName(sliding).select("kind", "rule", F.unix_micros("window_start").alias("start_us"), "hits")


NOISE_HOUR_SQL = with_events(
    """
SELECT 'tumbling' AS kind, rule, us - us % 3600000000 AS start_us, count(*) AS hits FROM hits GROUP BY ALL
UNION ALL SELECT 'sliding', rule, us - us % 3600000000 - o AS start_us, count(*) FROM hits, (VALUES (0), (3600000000)) v(o) GROUP BY ALL"""
)

QUERIES = {
    "stream_rule_hits": Query(stream_rule_hits, with_events("SELECT event_id, user_id, rule FROM hits")),
    "stream_heartbeat": Query(
        stream_heartbeat,
        """SELECT event_type AS source, CAST(user_id AS VARCHAR) AS host, epoch_us(max(ts)) AS last_us, count(*) AS events
        FROM events GROUP BY 1, 2""",
    ),
    "stream_noise": Query(stream_noise, STREAM_NOISE_SQL),
    "stream_late": Query(stream_late, "SELECT event_id, event_type FROM events WHERE floor(value)::BIGINT % 50 > 20"),
    "stream_cases": Query(stream_cases, STREAM_CASES_SQL),
    "noise_by_hour": Query(noise_by_hour, NOISE_HOUR_SQL),
}
