"""Queries: capture, redaction, replay, audits, field population, volume, retention."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofgrid import vocabulary as V
from proofgrid.functions.scalars import base_technique, case_id, host_of, redact
from proofgrid.functions.fields import EventFields
from proofgrid.operators import audit, capture, noise
from proofgrid.operators.rules import Source, match_rules
from proofgrid.plans.telemetry import (
    RULES,
    SOURCES,
    Query,
    table,
    telemetry,
    telemetry_fields,
    with_events,
)
from proofgrid.session import shared_folder
from proofgrid.sources import exports
from proofgrid.sources.store import RunStore, keep_since

TERMS = ("secret", "TOKEN")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as documents of texts, with fields whose names call for redaction."""
    events = telemetry(spark, sf_dir)
    k = F.try_variant_get("doc", "$.k", "string")
    return events.select(
        "event_id", "user_id", "us", "event_type", F.col("user_id").cast("string").alias("host"),
        F.create_map(
            F.lit("_time"), F.col("us").cast("string"), F.lit("type"), F.col("event_type"), F.lit("k"), k,
            F.lit("Api_Secret_Key"), k, F.lit("token"), F.col("user_id").cast("string"),
        ).alias("document"),
    )


def windows(events: DataFrame) -> DataFrame:
    """Capture windows: from an hour before each signup to two days after it."""
    return events.filter(F.col("event_type") == "signup").select(
        F.col("event_id").alias("window_id"), "user_id", F.concat(F.lit("signup-"), "event_id").alias("test_id"),
        F.col("us").alias("anchor_us"), (F.col("us") - 3_600_000_000).alias("lo"), (F.col("us") + 172_800_000_000).alias("hi"),
    )


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = documents(spark, sf_dir)
    return capture.capture(events, windows(events), ["user_id"], "document", TERMS)


CAPTURE = """
e AS (SELECT event_id, user_id, epoch_us(ts) AS us, event_type, json_extract_string(props, '$.k') AS k FROM events),
w AS (SELECT event_id AS window_id, user_id, us AS anchor_us, us - 3600000000 AS lo, us + 172800000000 AS hi FROM e WHERE event_type = 'signup'),
j AS (SELECT e.*, w.window_id, e.us - w.anchor_us AS d,
        row_number() OVER (PARTITION BY e.event_id ORDER BY w.lo, w.window_id) AS n
      FROM e JOIN w ON w.user_id = e.user_id AND e.us BETWEEN w.lo AND w.hi),
rec AS (SELECT event_id, 'signup-' || window_id AS _test, CAST(user_id AS VARCHAR) AS _host, event_type, k,
  (CASE WHEN d >= 0 THEN (d + 500) // 1000 ELSE -((500 - d) // 1000) END) / 1000.0::DOUBLE AS _offset FROM j WHERE n = 1)"""


def capture_events(spark, sf_dir):
    entries = F.transform(F.array_sort(F.map_entries("document")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return recorded(spark, sf_dir).select("event_id", "_test", "_offset", "_host", F.array_join(entries, ";").alias("document"))


def capture_profile(spark, sf_dir):
    return capture.capture_profile(recorded(spark, sf_dir), ["k", "CommandLine"])


def redact_fields(spark, sf_dir):
    """Hidden and kept values per key over all events."""
    events = documents(spark, sf_dir).select(F.explode(redact(F.col("document"), TERMS)).alias("key", "value"))
    return events.groupBy("key").agg(
        F.count_if(F.col("value") == "[redacted]").alias("hidden"), F.count_if(F.col("value") != "[redacted]").alias("kept")
    )


def window_span(spark, sf_dir):
    return capture.window_span(windows(documents(spark, sf_dir)), ["user_id"])


def replay_rebase(spark, sf_dir):
    """Recorded events moved to new anchors: errors and purchases ran, views are the baseline."""
    events = telemetry(spark, sf_dir)
    test = F.when(F.col("event_type") == "view", F.lit(V.BASELINE_TEST)).otherwise(F.col("event_type"))
    stored = events.select("event_id", test.alias("test_id"), (F.col("value") * 10).alias("offset_s"))
    anchors = (
        events.filter(F.col("event_type").isin("error", "purchase"))
        .groupBy(F.col("event_type").alias("test_id"))
        .agg(F.max("us").alias("anchor_us"))
    )
    return capture.rebase(stored, anchors, F.lit(1_700_000_000_000_000)).select("event_id", "test_id", "us")


REBASE_SQL = """
WITH a AS (SELECT event_type AS test_id, max(epoch_us(ts)) AS anchor FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1),
s AS (SELECT event_id, CASE WHEN event_type = 'view' THEN '__baseline__' ELSE event_type END AS test_id, value FROM events)
SELECT event_id, s.test_id, coalesce(anchor, 1700000000000000) + CAST(round(value * 100) AS BIGINT) * 100000 AS us
FROM s LEFT JOIN a ON a.test_id = s.test_id WHERE anchor IS NOT NULL OR s.test_id = '__baseline__'
"""


def source_caps(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    return capture.source_caps(events.select(F.col("event_type").alias("source")), 2000)


def host_lookup(spark, sf_dir):
    """Host named by the first filled key of a document: half the customers have no Computer."""
    df = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") < 12, F.col("c_name")).otherwise(F.lit("")).alias("Computer"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("host"),
    )
    return df.select("c_custkey", F.coalesce(host_of(EventFields.of(df)), F.lit("-")).alias("found"))


HOST_SQL = """
SELECT c_custkey, CASE WHEN c_nationkey < 12 THEN c_name WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE '-' END AS found FROM customer
"""


def corpus_audit(spark, sf_dir):
    """Recorded tests are hosts with events; the catalogue is customers in credit; rules refer to one segment."""
    customers = table(spark, sf_dir, "customer")
    test = F.col("c_custkey").cast("string").alias("test_id")
    seen = telemetry(spark, sf_dir).select(F.col("user_id").cast("string").alias("test_id"))
    return audit.corpus_audit(
        seen, customers.filter("c_acctbal > 0").select(test), customers.filter("c_mktsegment = 'BUILDING'").select(test)
    )


AUDIT_SQL = """
WITH s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS test_id FROM events)
SELECT test_id, 'not in catalogue' AS finding FROM s WHERE test_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'no recorded events' FROM customer
WHERE c_mktsegment = 'BUILDING' AND CAST(c_custkey AS VARCHAR) NOT IN (SELECT test_id FROM s)
"""


def orphan_tests(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    declared = customers.select(F.col("c_custkey").cast("string").alias("test_id"))
    test = F.when(F.col("event_type") == "view", F.lit(V.BASELINE_TEST)).otherwise(F.col("user_id").cast("string"))
    return audit.known_tests(declared, telemetry(spark, sf_dir).select(test.alias("test_id")))


ORPHAN_SQL = """
SELECT CAST(c_custkey AS VARCHAR) AS test_id FROM customer
UNION SELECT CAST(user_id AS VARCHAR) FROM events WHERE event_type <> 'view'
"""


def field_population(spark, sf_dir):
    """Fields of each log source, and a field its rules read that no event carries."""
    events = telemetry(spark, sf_dir)
    wanted = {s: [*names, "CommandLine"] for s, names in audit.rule_fields_by_source(RULES).items()}
    fields = telemetry_fields(events)
    return audit.field_population(events, list(SOURCES.values()), fields, wanted)


POPULATION_SQL = """
WITH f(source, field) AS (SELECT s, f FROM (VALUES ('error'), ('purchase'), ('view'), ('click'), ('signup')) v(s),
    (VALUES ('value'), ('k'), ('event_type'), ('CommandLine')) w(f) WHERE s <> 'signup' OR f IN ('value', 'k'))
SELECT f.source, f.field, count(*) AS events,
  count(*) FILTER (CASE f.field WHEN 'value' THEN e.value IS NOT NULL WHEN 'k' THEN json_extract_string(props, '$.k') <> ''
    WHEN 'event_type' THEN true ELSE false END) AS filled,
  count(*) FILTER (CASE f.field WHEN 'value' THEN e.value IS NOT NULL WHEN 'k' THEN json_extract_string(props, '$.k') <> ''
    WHEN 'event_type' THEN true ELSE false END) / count(*)::DOUBLE AS share,
  f.field = 'CommandLine' AS absent
FROM f JOIN events e ON e.event_type = f.source GROUP BY 1, 2
"""


def label_population(spark, sf_dir):
    """Documents as events of their language: which carry a label, and which are judged."""
    labels = table(spark, sf_dir, "labels")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    languages = [r[0] for r in docs.select("lang").distinct().dropna().orderBy("lang").collect()]  # a handful
    sources = [Source(lang, {"lang|cased": lang}, ("quality", "toxic", "source", "region")) for lang in languages]
    return audit.field_population(docs, sources, EventFields.of(docs), {})


LABEL_SQL = """
WITH d AS (SELECT lang, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(quality) AS q, count(toxic) AS t FROM d WHERE lang IS NOT NULL GROUP BY 1)
SELECT lang AS source, field, n AS events, f AS filled, f / n::DOUBLE AS share, f = 0 AS absent FROM (
  SELECT lang, n, unnest(['quality', 'toxic', 'source', 'region']) AS field, unnest([q, t, n, 0]) AS f FROM c)
"""


def needed_sources(spark, sf_dir):
    """Log sources seen in the events that the active rules read, with their volume."""
    chosen = RULES.select(min_severity="high")
    catalogue = telemetry(spark, sf_dir).groupBy(F.col("event_type").alias("source")).agg(F.count(F.lit(1)).alias("events"))
    return audit.needed_sources(chosen.table(spark), catalogue)


def daily_volume(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    found = match_rules(events, RULES, telemetry_fields(events), ["ts"])
    return noise.daily_volume(found, RULES.table(spark))


def overdue_reviews(spark, sf_dir):
    """Orders as accepted-noise entries reviewed by their date, judged at the newest date."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("profile"), F.col("o_orderstatus").alias("rule"), F.col("o_orderdate").alias("review_by")
    )
    late = noise.overdue_reviews(orders, F.lit("2001-01-01").cast("date"))
    return late.groupBy("profile", "rule").agg(F.count(F.lit(1)).alias("overdue"), F.date_format(F.max("review_by"), "yyyy-MM-dd").alias("last"))


OVERDUE_SQL = """
SELECT o_orderpriority AS profile, o_orderstatus AS rule, count(*) AS overdue, strftime(max(o_orderdate), '%Y-%m-%d') AS last
FROM orders WHERE o_orderdate < TIMESTAMP '2001-01-01' GROUP BY 1, 2
"""


def retention_prune(spark, sf_dir):
    """Orders as runs, line items as their children: what a cutoff of 2000 keeps."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_returnflag")
    cutoff = F.lit("2000-01-01").cast("timestamp_ntz")
    return keep_since(children, runs, cutoff).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("kept"), F.count_distinct("run_id").alias("runs")
    )


PRUNE_SQL = """
SELECT l_returnflag, count(*) AS kept, count(DISTINCT l_orderkey) AS runs FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') GROUP BY 1
"""


def saved_orders(spark: SparkSession, sf_dir: str) -> RunStore:
    """A store of three runs, one per order status: orders are cases, line items their evidence and techniques.

    The run of status P is saved twice, first with fewer cases.
    """
    store = RunStore(spark, f"{shared_folder(spark).rstrip('/')}/proofgrid/{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    key = F.col("o_orderkey").cast("string").alias("case_id")

    def save(status: str, day: int, kept: Column) -> None:
        rows = orders.filter((F.col("o_orderstatus") == status) & kept)
        of = lines.join(rows, F.col("l_orderkey") == F.col("o_orderkey"))
        started = F.lit(f"2026-01-{day:02} 10:00:00").cast("timestamp")
        store.save(status, f"2026-01-{day:02}", {
            "runs": spark.range(1).select(F.lit(status).alias("profile"), started.alias("started_at")),
            "cases": rows.select(key, F.col("o_orderpriority").alias("test_id"), F.col("o_totalprice").alias("price")),
            "case_attack": of.select(key, F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("technique"), F.col("l_returnflag").alias("tactic")),
            "evidence": of.filter("l_linenumber <= 2").select(key, (F.col("l_linenumber") - 1).alias("ordinal"), F.col("l_quantity").cast("string").alias("document")),
            "emulations": rows.groupBy(F.col("o_orderpriority").alias("test_id")).agg(F.max("o_orderkey").alias("last")),
        })

    save("P", 9, F.col("o_orderkey") % 2 == 0)
    for day, status in enumerate("FOP", 1):
        save(status, day, F.lit(True))
    return store


def store_load_cases(spark, sf_dir):
    """The cases of one stored run with techniques, evidence and emulation."""
    loaded = saved_orders(spark, sf_dir).load_cases("P")
    return loaded.select(
        "case_id",
        "price",
        F.array_join(F.transform("attack", lambda a: F.concat_ws("/", a["technique"], a["tactic"])), ",").alias("attack"),
        F.array_join(F.transform("evidence", lambda e: F.concat_ws("=", e["ordinal"].cast("string"), e["document"].cast("double").cast("int").cast("string"))), ",").alias("evidence"),
        F.col("emulation.last").alias("last"),
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"),
    )


LOAD_SQL = """
SELECT CAST(o_orderkey AS VARCHAR) AS case_id, o_totalprice AS price,
  (SELECT string_agg('T' || l_linenumber || '/' || l_returnflag, ',' ORDER BY 'T' || l_linenumber, l_returnflag) FROM lineitem WHERE l_orderkey = o_orderkey) AS attack,
  (SELECT string_agg((l_linenumber - 1) || '=' || CAST(l_quantity AS INT), ',' ORDER BY l_linenumber, CAST(CAST(l_quantity AS INT) AS VARCHAR)) FROM lineitem
   WHERE l_orderkey = o_orderkey AND l_linenumber <= 2) AS evidence,
  max(o_orderkey) OVER (PARTITION BY o_orderpriority) AS last, '2026-01-03' AS run_date
FROM orders WHERE o_orderstatus = 'P'
"""


def store_prune(spark, sf_dir):
    """What is left, table by table and run by run, when the first run is pruned."""
    store = saved_orders(spark, sf_dir)
    store.prune(F.lit("2026-01-02").cast("timestamp"))
    parts = [store.read(t).groupBy("run_id").agg(F.count("*").alias("rows")).select(F.lit(t).alias("part"), "*") for t in ("runs", "cases", "case_attack", "evidence")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_STORED = """WITH c AS (SELECT o_orderstatus AS run_id, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O', 'P')),
l AS (SELECT run_id, l_linenumber FROM c JOIN lineitem ON l_orderkey = o_orderkey),
t AS (SELECT 'runs' AS part, x AS run_id, 1 AS rows FROM (VALUES ('F'), ('O'), ('P')) v(x)
  UNION ALL SELECT 'cases', run_id, count(*) FROM c GROUP BY 2 UNION ALL SELECT 'case_attack', run_id, count(*) FROM l GROUP BY 2
  UNION ALL SELECT 'evidence', run_id, count(*) FROM l WHERE l_linenumber <= 2 GROUP BY 2)
"""
STORE_PRUNE_SQL = _STORED + "SELECT part, run_id, CAST(rows AS BIGINT) AS rows FROM t WHERE run_id <> 'F'"


def store_stats(spark, sf_dir):
    """Rows, oldest and newest run of every stored table but the emulations."""
    found = saved_orders(spark, sf_dir).stats().filter("table <> 'emulations'")
    return found.select("table", "rows", *[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("oldest", "newest")])


STATS_SQL = _STORED + """
SELECT part AS "table", CAST(sum(rows) AS BIGINT) AS rows, min('2026-01-0' || position(run_id IN 'FOP')) AS oldest,
  max('2026-01-0' || position(run_id IN 'FOP')) AS newest FROM t GROUP BY 1"""


def store_round_trip(spark, sf_dir):
    """Every order priority saved as a run of its own; one run saved again with fewer rows under another date, and read back."""
    store = RunStore(spark, f"{shared_folder(spark).rstrip('/')}/proofgrid/{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", "o_orderstatus")
    names = [r[0] for r in orders.select("o_orderpriority").distinct().orderBy(F.desc("o_orderpriority")).collect()]  # a handful

    def save(name: str, day: int, kept: Column) -> None:
        rows = orders.where((F.col("o_orderpriority") == name) & kept)
        cases = rows.select(F.col("o_orderkey").cast("string").alias("case_id"), "o_totalprice")
        findings = rows.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("gate").alias("kind"))
        runs = spark.range(1).select(F.lit(name).alias("profile"), F.lit(f"2026-01-{day:02}").cast("timestamp").alias("started_at"))
        store.save(name, f"2026-01-{day:02}", {"runs": runs, "cases": cases, "findings": findings})

    for day, name in enumerate(names, 1):
        save(name, day, F.lit(True))
    save(names[-1], 30, F.col("o_orderstatus") == "O")
    cases = store.read("cases").groupBy("run_id", "run_date").agg(F.count("*").alias("cases"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    findings = store.read("findings").groupBy("run_id").agg(F.count("*").alias("findings"))
    return cases.join(findings, "run_id", "left").select(
        "run_id", F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "cases", "total", F.coalesce("findings", F.lit(0).cast("long")).alias("findings")
    )


ROUND_TRIP_SQL = """
WITH p AS (SELECT o_orderpriority AS run_id, row_number() OVER (ORDER BY o_orderpriority DESC) AS day,
  o_orderpriority = (SELECT min(o_orderpriority) FROM orders) AS again FROM (SELECT DISTINCT o_orderpriority FROM orders))
SELECT run_id, CASE WHEN again THEN '2026-01-30' ELSE '2026-01-0' || day END AS run_date, count(*) AS cases,
  round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderstatus = 'F') AS findings
FROM p JOIN orders ON o_orderpriority = run_id WHERE NOT again OR o_orderstatus = 'O' GROUP BY 1, 2
"""


def exported(spark: SparkSession, sf_dir: str, body: str) -> str:
    """Events written as an export in the shared folder, one line each; every tenth is broken, every eleventh empty of events."""
    folder = f"{shared_folder(spark).rstrip('/')}/proofgrid/{uuid.uuid4().hex}"
    line = F.expr(f"CASE WHEN event_id % 10 = 0 THEN '{{\"broken' WHEN event_id % 11 = 0 THEN '{{}}' ELSE {body} END")
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    return folder


def with_rejects(spark: SparkSession, found: DataFrame, folder: str, kind: str) -> DataFrame:
    key = F.try_variant_get("doc", "$.id", "bigint")
    k = F.try_variant_get("doc", "$.k", "string")
    events = found.select(key.alias("event_id"), F.unix_micros("ts").alias("us"), k.alias("k"), F.lit(None).cast("string").alias("reason"), F.lit(1).cast("bigint").alias("n"))
    lost = exports.rejected_responses(spark, folder, kind).groupBy("reason").agg(F.count("*").alias("n"))
    return events.unionByName(lost, allowMissingColumns=True)


STAMP = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\")"


def export_ndjson(spark, sf_dir):
    """Envelopes whose raw text holds the rest of the event, read back with what was rejected."""
    body = f"to_json(named_struct('result', named_struct('_time', {STAMP}, 'id', event_id, '_raw', props)))"
    folder = exported(spark, sf_dir, body)
    return with_rejects(spark, exports.read_ndjson_export(spark, folder), folder, "ndjson")


def export_hits(spark, sf_dir):
    """Search responses of one hit each."""
    source = f"named_struct('@timestamp', {STAMP}, 'id', event_id, 'k', get_json_object(props, '$.k'))"
    folder = exported(spark, sf_dir, f"to_json(named_struct('hits', named_struct('hits', array(named_struct('_id', 'x', '_source', {source})))))")
    return with_rejects(spark, exports.read_search_hits(spark, folder), folder, "hits")


def export_tables(spark, sf_dir):
    """Column/row responses of one row each; a repeated column name, of which the last wins."""
    columns = ", ".join(f"named_struct('name', '{c}')" for c in ("TimeGenerated", "id", "k", "k"))
    cells = f"array({STAMP}, cast(event_id as string), 'first', get_json_object(props, '$.k'))"
    folder = exported(spark, sf_dir, f"to_json(named_struct('tables', array(named_struct('columns', array({columns}), 'rows', array({cells})))))")
    return with_rejects(spark, exports.read_tables(spark, folder), folder, "tables")


EXPORT_SQL = """
SELECT event_id, epoch_us(ts) AS us, json_extract_string(props, '$.k') AS k, NULL::VARCHAR AS reason, 1::BIGINT AS n FROM events
WHERE event_id % 10 <> 0 AND event_id % 11 <> 0
UNION ALL SELECT NULL, NULL, NULL, CASE WHEN event_id % 10 = 0 THEN 'not JSON or too large' ELSE 'no events in it' END, count(*) FROM events
WHERE event_id % 10 = 0 OR event_id % 11 = 0 GROUP BY 4
"""


def scalar_keys(spark, sf_dir):
    """Case ids, base techniques and severities worked out for every line item."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("run"), F.col("l_linenumber").cast("string").alias("test"),
        F.format_string("T%04d.%03d", (F.col("l_suppkey") % 9000 + 1000).cast("int"), F.col("l_linenumber")).alias("technique"),
        F.element_at(F.array(*map(F.lit, ["INFO", " crit", "High", "unknown"])), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("level"),
    )
    severity = V.normalise_severity(F.col("level"))
    return items.groupBy(severity.alias("severity"), base_technique(F.col("technique")).alias("base")).agg(
        F.count(F.lit(1)).alias("items"),
        F.min(V.severity_rank(severity)).cast("int").alias("rank"),
        F.max(case_id(F.col("run"), F.lit("rule"), F.col("test"))).alias("last_id"),
    )


SCALAR_SQL = """
SELECT ['informational', 'critical', 'high', 'medium'][l_linenumber % 4 + 1] AS severity, printf('T%04d', l_suppkey % 9000 + 1000) AS base,
  count(*) AS items, min([0, 4, 3, 2][l_linenumber % 4 + 1])::INTEGER AS rank,
  max(sha256(l_orderkey || '|rule|' || l_linenumber)) AS last_id
FROM lineitem GROUP BY 1, 2
"""

VOLUME_SQL = with_events(
    """SELECT rule, CAST(ts AS DATE) AS day, count(*) AS hits, 25::BIGINT AS expected, count(*) > 25 AS "over" FROM hits GROUP BY 1, 2"""
)

QUERIES = {
    "export_ndjson": Query(export_ndjson, EXPORT_SQL),
    "export_hits": Query(export_hits, EXPORT_SQL),
    "export_tables": Query(export_tables, EXPORT_SQL),
    "store_round_trip": Query(store_round_trip, ROUND_TRIP_SQL),
    "capture_events": Query(
        capture_events,
        f"""WITH {CAPTURE} SELECT event_id, _test, _offset, _host,
        'Api_Secret_Key=[redacted];k=' || k || ';token=[redacted];type=' || event_type AS document FROM rec""",
    ),
    "capture_profile": Query(
        capture_profile,
        f"""WITH {CAPTURE} SELECT _test, count(*) AS events, count(DISTINCT _host) AS hosts, min(_offset) AS first_offset,
        max(_offset) AS last_offset, count(*) FILTER (k <> '') AS "with_k", 0::BIGINT AS "with_CommandLine" FROM rec GROUP BY _test""",
    ),
    "redact_fields": Query(
        redact_fields,
        """SELECT key, CASE WHEN key IN ('Api_Secret_Key', 'token') THEN n ELSE 0 END AS hidden,
        CASE WHEN key IN ('Api_Secret_Key', 'token') THEN 0 ELSE n END AS kept
        FROM (SELECT count(*) AS n FROM events), (VALUES ('_time'), ('type'), ('k'), ('Api_Secret_Key'), ('token')) v(key)""",
    ),
    "window_span": Query(
        window_span,
        """SELECT user_id, epoch_us(min(ts)) - 3600000000 AS span_lo, epoch_us(max(ts)) + 172800000000 AS span_hi
        FROM events WHERE event_type = 'signup' GROUP BY 1""",
    ),
    "replay_rebase": Query(replay_rebase, REBASE_SQL),
    "source_caps": Query(
        source_caps,
        "SELECT event_type AS source, count(*) AS events, count(*) > 2000 AS incomplete FROM events GROUP BY 1",
    ),
    "host_lookup": Query(host_lookup, HOST_SQL),
    "corpus_audit": Query(corpus_audit, AUDIT_SQL),
    "orphan_tests": Query(orphan_tests, ORPHAN_SQL),
    "field_population": Query(field_population, POPULATION_SQL),
    "label_population": Query(label_population, LABEL_SQL),
    "needed_sources": Query(
        needed_sources,
        "SELECT event_type AS source, count(*) AS events FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1",
    ),
    "daily_volume": Query(daily_volume, VOLUME_SQL),
    "overdue_reviews": Query(overdue_reviews, OVERDUE_SQL),
    "retention_prune": Query(retention_prune, PRUNE_SQL),
    "store_load_cases": Query(store_load_cases, LOAD_SQL),
    "store_prune": Query(store_prune, STORE_PRUNE_SQL),
    "store_stats": Query(store_stats, STATS_SQL),
    "scalar_keys": Query(scalar_keys, SCALAR_SQL),
}
