"""Queries: heartbeat of hosts (users) on log sources (event types), against an inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.operators import heartbeat as B
from proofgrid.plans.telemetry import SOURCES, Query, table, telemetry, telemetry_fields

POLICY = B.source_policy(list(SOURCES.values()))
INVENTORY_SOURCES = ("error", "purchase")


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = telemetry(spark, sf_dir)
    return B.observations(
        events, list(SOURCES.values()), telemetry_fields(events), F.col("user_id").cast("string")
    )


def beats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is expected to send errors and purchases."""
    expected = table(spark, sf_dir, "customer").select(
        F.explode(F.array(*map(F.lit, INVENTORY_SOURCES))).alias("source"), F.col("c_custkey").cast("string").alias("host")
    )
    return B.heartbeat(seen(spark, sf_dir), expected, policy=POLICY)


BEATS = """
pol(source, i, g) AS (VALUES """ + ", ".join(
    f"('{s}', {POLICY.get(s, (900.0, 3.0))[0]}::DOUBLE, {POLICY.get(s, (900.0, 3.0))[1]}::DOUBLE)" for s in SOURCES
) + """),
s AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS host, max(epoch_us(ts)) AS last_us, count(*) AS events FROM events GROUP BY 1, 2),
inv AS (SELECT source, CAST(c_custkey AS VARCHAR) AS host FROM customer, (VALUES ('error'), ('purchase')) v(source)),
f AS (SELECT coalesce(s.source, inv.source) AS source, coalesce(s.host, inv.host) AS host, last_us, coalesce(events, 0) AS events
  FROM s FULL JOIN inv ON s.source = inv.source AND s.host = inv.host),
a AS (SELECT source, max(last_us) AS as_of_us FROM s GROUP BY 1),
beats AS (SELECT f.*, i AS interval_s, g AS grace, as_of_us, (as_of_us - last_us) / 1000000::DOUBLE AS age_s,
  CASE WHEN last_us IS NULL THEN 'silent' WHEN (as_of_us - last_us) / 1000000::DOUBLE <= i THEN 'alive'
       WHEN (as_of_us - last_us) / 1000000::DOUBLE <= i * g THEN 'late' ELSE 'silent' END AS state
  FROM f JOIN a USING (source) JOIN pol USING (source))"""


def hosts_seen(spark, sf_dir):
    return B.hosts_seen(telemetry(spark, sf_dir), F.col("user_id").cast("string"))


def corpus_heartbeat(spark, sf_dir):
    """Recordings (one per event type, started at its first event) put back on absolute time.

    The recording of views carries no start, so its events cannot be placed.
    """
    events = telemetry(spark, sf_dir)
    starts = events.groupBy(F.col("event_type").alias("scenario")).agg(F.min("ts").alias("first"))
    corpora = starts.select("scenario", F.when(F.col("scenario") != "view", F.col("first")).alias("recorded_at"))
    recorded = events.join(starts, F.col("event_type") == F.col("scenario")).select(
        "scenario", F.col("user_id").cast("string").alias("host"),
        ((F.col("us") - F.unix_micros("first")) / F.lit(1e6)).alias("offset_s"),
    )
    placed = B.corpus_observations(recorded, corpora).withColumn("source", F.col("scenario"))
    return B.heartbeat(placed.select("source", "host", "us"), interval=3600.0, grace=24.0).select(
        "source", "host", "last_us", "events", "state"
    )


CORPUS_SQL = """
WITH s AS (SELECT event_type AS source, CAST(user_id AS VARCHAR) AS host, max(epoch_us(ts)) AS last_us, count(*) AS events
  FROM events WHERE event_type <> 'view' GROUP BY 1, 2),
a AS (SELECT *, max(last_us) OVER (PARTITION BY source) - last_us AS age FROM s)
SELECT source, host, last_us, events,
  CASE WHEN age <= 3600000000 THEN 'alive' WHEN age <= 86400000000 THEN 'late' ELSE 'silent' END AS state FROM a
"""

COLUMNS = "source, host, last_us, events, age_s, interval_s, grace, as_of_us, state"

QUERIES = {
    "heartbeat": Query(beats, f"WITH {BEATS} SELECT {COLUMNS} FROM beats"),
    "heartbeat_counts": Query(
        lambda s, d: B.heartbeat_counts(beats(s, d)),
        f"""WITH {BEATS} SELECT source, count(*) FILTER (state = 'silent') AS silent, count(*) FILTER (state = 'late') AS late,
        count(*) FILTER (state = 'alive') AS alive, count(*) FILTER (state = 'silent') = 0 AS healthy, max(as_of_us) AS as_of_us
        FROM beats GROUP BY source""",
    ),
    "hosts_seen": Query(hosts_seen, "SELECT DISTINCT CAST(user_id AS VARCHAR) AS host FROM events"),
    "corpus_heartbeat": Query(corpus_heartbeat, CORPUS_SQL),
}
