from __future__ import annotations

import time

from pyspark.sql import functions as F

from proofgrid.functions.fields import EventFields
from proofgrid.operators.rules import Rule, Ruleset, Source
from proofgrid.streaming import jobs, timers

LIB = Ruleset(
    (Rule.from_document({"title": "Err", "telemetry": ["log"], "detection": {"s": {"kind": "error"}, "condition": "s"}}),),
    {"log": Source("log", {"kind": ["error", "info"]})},
)
EVENTS = "event_id int, ts timestamp, us bigint, host string, kind string"


def put(spark, path, rows):
    """Rows of (id, minute, host, kind) as one new file of the stream's folder."""
    frame = spark.createDataFrame(rows, "event_id int, minute int, host string, kind string")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("minute") * 60)
    frame.select("event_id", ts.alias("ts"), F.unix_micros(ts).alias("us"), "host", "kind").coalesce(1).write.mode("append").parquet(path)


def fields(df):
    return EventFields.of(df, columns=["kind", "host"])


def stream(spark, path):
    return spark.readStream.schema(EVENTS).parquet(path)


def test_hits_are_deduplicated_across_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for rows in ([(1, 0, "a", "error"), (2, 1, "a", "info")], [(1, 0, "a", "error"), (3, 2, "b", "error")]):
        put(spark, src, rows)
        events = stream(spark, src)
        hits = jobs.rule_hits(events, LIB, fields(events), ["event_id"], "event_id", "ts", "1 hour")
        jobs.append_table(hits, out, ck).awaitTermination()
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == [1, 3]


def test_heartbeat_state_over_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    for rows in ([(1, 0, "a", "error"), (2, 5, "b", "info")], [(3, 30, "a", "info"), (4, 1, "b", "other")]):
        put(spark, src, rows)
        events = stream(spark, src)
        seen = jobs.last_seen(events, list(LIB.sources.values()), fields(events), F.col("host"))
        jobs.batch_table(seen, out, ck).awaitTermination()
    state = jobs.latest_rows(spark, out, ["source", "host"])
    base = 1_700_000_000_000_000
    assert {(r["host"], r["last_us"] - base, r["events"]) for r in state.collect()} == {("a", 1_800_000_000, 2), ("b", 300_000_000, 1)}
    inventory = spark.createDataFrame([("log", "never")], "source string, host string")
    beats = jobs.beats_from_state(state, inventory, F.lit(base + 1_800_000_000), {"log": (600.0, 2.0)})
    assert {r["host"]: (r["state"], r["events"]) for r in beats.collect()} == {"a": ("alive", 2), "b": ("silent", 1), "never": ("silent", 0)}


def test_noise_windows_and_late_rows(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [(1, 0, "a", "error"), (2, 1, "a", "error"), (3, 200, "a", "error")])
    events = stream(spark, src)
    hits = jobs.match_rules(events, LIB, fields(events), ["ts"])
    jobs.append_table(jobs.noise_windows(hits, "ts", "10 minutes"), out, ck).awaitTermination()
    assert [r["hits"] for r in spark.read.parquet(out).collect()] == [2]
    rows = spark.read.parquet(src).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000 + 30 * 60)))
    on_time, late = jobs.split_late(rows, "ts", "arrived", "29 MINUTES")
    assert sorted(r["event_id"] for r in late.collect()) == [1] and on_time.count() == 2


def test_case_progress_and_verdicts(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    base = 1_700_000_000_000_000
    minute = 60_000_000
    cases = spark.createDataFrame(
        [("c1", "err", "a", base, base, base + 10 * minute), ("c2", "err", "b", base, base, base + 10 * minute),
         ("c3", "err", "c", base, base, base + 10 * minute), ("c4", "err", "c", base, base, base + 90 * minute)],
        "case_id string, rule string, host string, started_us bigint, lo bigint, hi bigint",
    ).withColumns({"expected": F.lit("detected"), "max_latency": F.lit(120.0)})
    for rows in ([(1, 1, "a", "info"), (2, 2, "b", "info")], [(3, 3, "a", "error"), (4, 2, "a", "error"), (5, 50, "b", "error")]):
        put(spark, src, rows)
        jobs.case_progress(stream(spark, src), cases, LIB, fields, "host", out, ck).awaitTermination()
    verdicts = jobs.case_verdicts(spark.read.parquet(out), cases, F.lit(base + 12 * minute))
    got = {r["case_id"]: (r["outcome"], r["pending"], r["latency"]) for r in verdicts.collect()}
    assert got == {"c1": ("detected", False, 120.0), "c2": ("visible", False, None), "c3": ("blind", False, None), "c4": (None, True, None)}


def run_until(query, check, limit=60):
    deadline = time.time() + limit
    try:
        while time.time() < deadline and not check():
            if query.exception() is not None:
                raise query.exception()
            time.sleep(0.5)
    finally:
        query.stop()


def read(spark, path):
    try:
        return spark.read.parquet(path).collect()
    except Exception:  # noqa: BLE001 - nothing written yet
        return []


def test_timers_settle_silent_cases(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    now = int(time.time() * 1000)
    layout = "case_id string, hits bigint, probe_hits bigint, first_us bigint, deadline_ms bigint"
    rows = [("hit", 0, 0, None, now + 10**7), ("hit", 2, 3, 55, None), ("seen", 0, 0, None, now + 100), ("seen", 0, 4, None, None),
            ("dark", 0, 0, None, now + 100), ("open", 0, 0, None, now + 10**7)]
    spark.createDataFrame(rows, layout).coalesce(1).write.parquet(src)
    verdicts = timers.settle_cases(spark.readStream.schema(layout).parquet(src))
    query = jobs.append_table(verdicts, out, ck, available_now=False)
    run_until(query, lambda: len(read(spark, out)) >= 3)
    got = {r["case_id"]: (r["outcome"], r["hits"], r["probe_hits"], r["first_us"]) for r in read(spark, out)}
    assert got == {"hit": ("detected", 2, 3, 55), "seen": ("visible", 0, 4, None), "dark": ("blind", 0, 0, None)}


def test_timers_report_silence_and_return(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    layout = "source string, host string, last_ms bigint, limit_ms bigint"
    add = lambda last, limit: spark.createDataFrame([("s", "h", last, limit)], layout).coalesce(1).write.mode("append").parquet(src)
    add(int(time.time() * 1000), 500)
    query = jobs.append_table(timers.silence_alerts(spark.readStream.schema(layout).parquet(src)), out, ck, available_now=False)
    returned = []

    def check():
        states = [r["state"] for r in read(spark, out)]
        if states and not returned:
            returned.append(add(int(time.time() * 1000), 10**8))
        return len(states) >= 2

    run_until(query, check)
    assert sorted(r["state"] for r in read(spark, out)) == ["alive", "silent"]


def test_progress_counts_a_repeated_event_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    base = 1_700_000_000_000_000
    cases = spark.createDataFrame([("c", "err", "a", base, base + 600_000_000)], "case_id string, rule string, host string, lo long, hi long")
    for rows in ([(1, 0, "a", "error"), (1, 0, "a", "error")], [(1, 0, "a", "error")], [(2, 1, "a", "info")]):
        put(spark, src, rows)
        jobs.case_progress(stream(spark, src), cases, LIB, fields, "host", out, ck, identity="event_id").awaitTermination()
    progress = spark.read.parquet(out).groupBy("case_id").agg(F.sum("detection_hits"), F.sum("telemetry_hits"))
    assert [tuple(r) for r in progress.collect()] == [("c", 1, 2)]


def test_hits_of_late_rows_are_kept_and_marked(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    put(spark, src, [(1, 0, "a", "error"), (2, 100, "a", "error"), (2, 100, "a", "error")])
    put(spark, src, [(3, 5, "a", "error")])
    events = stream(spark, src).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000 + 101 * 60)))
    hits = jobs.rule_hits(events, LIB, fields(events), ["event_id"], "event_id", "ts", "30 minutes", arrived="arrived")
    jobs.append_table(hits, out, ck).awaitTermination()
    assert sorted((r["event_id"], r["late"]) for r in spark.read.parquet(out).collect()) == [(1, True), (2, False), (3, True)]
