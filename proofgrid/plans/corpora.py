"""Queries: a recorded corpus written and read back, and its unreadable lines."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid.functions.predicates import selection
from proofgrid.plans.telemetry import Query, telemetry
from proofgrid.session import shared_folder
from proofgrid.sources.corpus import corpus_fields, read_corpus, read_manifests, rejected_lines, write_corpus


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/proofgrid/{uuid.uuid4().hex}"


def corpus_round_trip(spark, sf_dir):
    """All events written as a corpus with a manifest and read back, each with its test, offset, host and scenario."""
    root = _folder(spark)
    day_us = 86_400_000_000
    recorded = telemetry(spark, sf_dir).select(
        F.col("event_type").alias("_test"),
        ((F.col("us") % day_us - F.col("us") % 1000) / F.lit(1e6)).alias("_offset"),
        F.col("user_id").cast("string").alias("_host"),
        F.create_map(F.lit("EventID"), F.col("event_id").cast("string"), F.lit("Note"), F.concat(F.lit('a "b" \\ '), "event_type")).alias("document"),
    )
    write_corpus(recorded, root, "recorded", {"tests": ["signup"], "recorded_at": "2024-02-01T00:00:00Z"})
    events = read_corpus(spark, root)
    fields = corpus_fields(events, [("EventID",), ("Note",)])
    named = read_manifests(spark, root).select(F.col("folder").alias("scenario"), F.unix_micros("recorded_at").alias("recorded_us"))
    return events.select(
        fields.locate("eventid").text.cast("bigint").alias("event_id"), "scenario", "test_id", "offset_s", "host",
        fields.locate("note").text.alias("note"),
    ).join(named, "scenario")


ROUND_TRIP_SQL = """
SELECT event_id, 'recorded' AS scenario, event_type AS test_id,
  (epoch_us(ts) % 86400000000 - epoch_us(ts) % 1000) / 1000000.0::DOUBLE AS offset_s,
  CAST(user_id AS VARCHAR) AS host, 'a "b" \\ ' || event_type AS note, epoch_us(TIMESTAMP '2024-02-01') AS recorded_us
FROM events
"""


def _with_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a corpus: some cut short, some lists or texts, some comments or empty."""
    kind, k = F.col("event_type"), F.try_variant_get("doc", "$.k", "int")
    whole = F.concat(F.lit('{"id": '), F.col("event_id").cast("string"), F.lit("}"))
    line = (
        F.when((kind == "error") & (k < 10), F.substring(whole, 1, 5))
        .when((kind == "purchase") & (k >= 90), F.concat(F.lit("["), whole, F.lit("]")))
        .when((kind == "click") & (k == 0), F.lit("null"))
        .when(kind == "signup", F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("# note")))
        .otherwise(whole)
    )
    return telemetry(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", line.alias("value"))


def corpus_rejects(spark, sf_dir):
    """The lines of a corpus that can't be read, with their number in their file; one scenario a day."""
    root = _folder(spark)
    days = _with_bad_lines(spark, sf_dir).repartition("day").sortWithinPartitions("day", "event_id")
    days.select("day", "value").write.partitionBy("day").text(root)
    return rejected_lines(spark, root, name="part-*").select(
        F.replace("scenario", F.lit("day="), F.lit("")).alias("day"), "line", "reason", "value"
    )


REJECTS_SQL = """
WITH x AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id) AS line, '{"id": ' || event_id || '}' AS whole FROM events)
SELECT day, line, CASE WHEN event_type = 'error' THEN 'not JSON' ELSE 'not an object' END AS reason,
  CASE event_type WHEN 'error' THEN substr(whole, 1, 5) WHEN 'purchase' THEN '[' || whole || ']' ELSE 'null' END AS value
FROM x WHERE (event_type = 'error' AND k < 10) OR (event_type = 'purchase' AND k >= 90) OR (event_type = 'click' AND k = 0)
"""

def field_resolve_discovered(spark, sf_dir):
    """Lookup by names in documents of unknown shape: ten keys deep, lists, and a key of its own in every document."""
    deep = F.concat(F.lit('{"L1":' + "".join(f'{{"l{i}":' for i in range(2, 11))), F.col("user_id").cast("string"), F.lit("}" * 10))
    body = F.concat(
        F.lit('{"own_'), F.col("event_id").cast("string"), F.lit('": {"x": 1}, "kind": {"'), F.col("event_type"), F.lit('": {"Leaf": '),
        F.col("value").cast("string"), F.lit('}}, "list": [{"member": "'), F.col("event_type"), F.lit('"}], "tags": ["a", "'),
        F.col("event_type"), F.lit('"], "deep": '), deep, F.lit("}"),
    )
    events = telemetry(spark, sf_dir).select("event_id", F.parse_json(body).alias("doc"))
    names = ["leaf", "member", "tags", "deep.l1.l2.l3.l4.l5.l6.l7.l8.l9.l10", "kind.error.leaf", "nowhere"]
    fields = corpus_fields(events, names=names)
    return events.select(
        "event_id",
        F.lit(len(fields.paths)).alias("paths"),
        fields.locate("leaf").item.number.alias("leaf"),
        fields.locate("member").text.alias("member"),
        fields.locate(names[3]).text.cast("bigint").alias("deep"),
        fields.locate("kind.error.leaf").present.alias("dotted"),
        fields.locate("nowhere").present.alias("nowhere"),
        selection(fields, {"tags": "error"}).alias("tagged"),
    )


# Nodes on the way to: five leaves under kind (11), list's member (3), tags (2), eleven keys under deep.
DISCOVERED_SQL = """
SELECT event_id, 1 + 2 * (SELECT count(DISTINCT event_type) FROM events) + 3 + 2 + 11 AS paths, value AS leaf, event_type AS member,
  user_id AS deep, event_type = 'error' AS dotted, false AS nowhere, event_type = 'error' AS tagged
FROM events
"""

QUERIES = {
    "field_resolve_discovered": Query(field_resolve_discovered, DISCOVERED_SQL),
    "corpus_round_trip": Query(corpus_round_trip, ROUND_TRIP_SQL),
    "corpus_rejects": Query(corpus_rejects, REJECTS_SQL),
}
