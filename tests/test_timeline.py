from __future__ import annotations

import random
import re

import pytest

from proofgrid.operators.timeline import (
    attribute_events,
    count_in_windows,
    first_in_windows,
    within_span,
)


def make(seed):
    """Random events and windows with one hot key, bursts and shared moments."""
    rng = random.Random(seed)
    span = 400_000_000
    events, windows = [], []
    for i in range(400):
        key = "hot" if rng.random() < 0.5 else rng.choice("abc")
        us = 77 if rng.random() < 0.1 else rng.randrange(span) // 1000 * 1000
        events.append((i, key, us))
    for w in range(60):
        lo = rng.randrange(-5_000_000, span) // 1000 * 1000
        windows.append((w, rng.choice(["hot", "a", "none"]), lo, lo + rng.choice([0, 1000, 30_000_000, 200_000_000])))
    windows += [(60, "hot", 77, 77), (61, "hot", 78, 90), (62, "hot", 77, 90_000_000)]
    return events, windows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    events, windows = make(seed)
    ev = spark.createDataFrame(events, "event_id int, key string, us bigint")
    wi = spark.createDataFrame(windows, "window_id int, key string, lo bigint, hi bigint")

    inside = {
        w: sorted((us, e) for e, k, us in events if k == key and lo <= us <= hi)
        for w, key, lo, hi in windows
    }
    got = {r["window_id"]: (r["hits"], r["first_us"]) for r in count_in_windows(ev, wi, ["key"], ["window_id"]).collect()}
    assert got == {w: (len(v), v[0][0] if v else None) for w, v in inside.items()}

    spread = count_in_windows(ev, wi, ["key"], ["window_id"], bucket_seconds=7, spread=3).collect()
    assert {r["window_id"]: (r["hits"], r["first_us"]) for r in spread} == got

    first = {}
    for r in first_in_windows(ev, wi, ["key"], 3, "event_id").collect():
        first.setdefault(r["window_id"], {})[r["place"]] = (r["us"], r["event_id"])
    assert first == {w: dict(enumerate(v[:3], 1)) for w, v in inside.items() if v}

    expected = {}
    for e, k, us in events:
        cover = [(lo, w) for w, key, lo, hi in windows if key == k and lo <= us <= hi]
        if cover:
            expected[e] = min(cover)[1]
    out = attribute_events(ev, wi, ["key"], ["window_id"]).collect()
    assert {r["event_id"]: r["window_id"] for r in out} == expected
    assert len(out) == len(expected)
    wide = attribute_events(ev, wi, ["key"], ["window_id"], bucket_seconds=3600).collect()
    assert {r["event_id"]: r["window_id"] for r in wide} == expected


def test_timestamps_before_epoch_and_small_buckets(spark):
    ev = spark.createDataFrame([(1, "a", -3_000_000), (2, "a", 0), (3, "a", 5_000_000)], "event_id int, key string, us bigint")
    wi = spark.createDataFrame([(1, "a", -3_000_000, 0), (2, "a", 1, 9_000_000), (3, "a", 6_000_000, 7_000_000)], "window_id int, key string, lo bigint, hi bigint")
    got = {r["window_id"]: (r["hits"], r["first_us"]) for r in count_in_windows(ev, wi, ["key"], ["window_id"], bucket_seconds=1).collect()}
    assert got == {1: (2, -3_000_000), 2: (1, 5_000_000), 3: (0, None)}


def test_span_keeps_what_windows_can_see(spark):
    ev = spark.createDataFrame([(i, "a", i * 1_000_000) for i in range(20)], "event_id int, key string, us bigint")
    wi = spark.createDataFrame([(1, "a", 4_000_000, 6_000_000), (2, "a", 9_000_000, 9_500_000)], "window_id int, key string, lo bigint, hi bigint")
    kept = within_span(ev, wi)
    assert sorted(r["event_id"] for r in kept.collect()) == [4, 5, 6, 7, 8, 9]
    count = lambda e: {tuple(r) for r in count_in_windows(e, wi, ["key"], ["window_id"]).collect()}
    assert count(kept) == count(ev) == {(1, 3, 4_000_000), (2, 1, 9_000_000)}


def test_one_hot_host_and_one_hot_microsecond(spark):
    """A third of the events on one moment of one host, a third of the windows on one moment too."""
    events = [(i, "hot", 5_000_000) for i in range(3_000)] + [(i, "hot" if i % 2 else "b", i * 97_001) for i in range(3_000, 9_000)]
    windows = [(w, "hot", 5_000_000 - w % 3, 5_000_000 + w % 2) for w in range(500)]
    windows += [(w, "hot" if w % 2 else "b", w * 300_001, w * 300_001 + w * 10_000) for w in range(500, 1_500)]
    windows += [(1_500, None, 0, 9), (1_501, "b", None, 9), (1_502, "b", 9, 3)]
    ev = spark.createDataFrame(events + [(9_000, None, 5), (9_001, "b", None)], "event_id int, key string, us bigint")
    wi = spark.createDataFrame(windows, "window_id int, key string, lo bigint, hi bigint")
    sound = [w for w in windows if None not in w]
    by_key = {k: sorted(us for _, key, us in events if key == k) for k in ("hot", "b")}
    want = {1_500: (0, None), 1_501: (0, None)}
    for w, key, lo, hi in sound:
        inside = [us for us in by_key[key] if lo <= us <= hi]
        want[w] = (len(inside), inside[0] if inside else None)
    got = count_in_windows(ev, wi, ["key"], ["window_id"], spread=4)
    # A window that ends before it starts holds less than nothing; no caller makes one.
    assert {r["window_id"]: (r["hits"], r["first_us"]) for r in got.collect() if r["window_id"] != 1_502} == {w: v for w, v in want.items() if w != 1_502}
    owners = {}
    for e, key, us in events:
        cover = [(lo, w) for w, k, lo, hi in sound if k == key and lo <= us <= hi]
        if cover:
            owners[e] = min(cover)[1]
    out = attribute_events(ev, wi, ["key"], ["window_id"])
    assert {r["event_id"]: r["window_id"] for r in out.collect()} == owners
    # Planned without adaptive execution, which would show what it reads again as planned twice.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df, most in ((count_in_windows(ev, wi, ["key"], ["window_id"]), 5), (attribute_events(ev, wi, ["key"], ["window_id"]), 4)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert len(re.findall("- Exchange hash", plan)) <= most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
