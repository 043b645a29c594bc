"""Cases that once lost rows or answered wrong."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from proofgrid.functions.literals import java_regex
from proofgrid.functions.timestamps import seconds_of
from proofgrid.operators.capture import capped_events
from proofgrid.operators.quantiles import exact_percentiles
from proofgrid.operators.timeline import count_in_windows
from proofgrid.session import shared_folder
from proofgrid.sources.store import RunStore


@pytest.mark.parametrize("cap", [1000, 1001])
def test_capped_events_have_one_rule_for_missing_values(spark, cap):
    events = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("a", None)], "k string, n long")
    got = sorted(map(tuple, capped_events(events, ["k"], "n", cap).select("k", "n", "place").collect()))
    assert got == [("a", 1, 1), ("a", 2, 2)]


def test_windows_without_a_key_are_answered(spark):
    events = spark.createDataFrame([("h", 5), (None, 5)], "h string, us long")
    windows = spark.createDataFrame([(1, "h", 0, 9), (2, None, 0, 9), (3, "h", None, 9)], "id int, h string, lo long, hi long")
    got = sorted(map(tuple, count_in_windows(events, windows, ["h"], ["id"]).collect()))
    assert got == [(1, 1, 5), (2, 0, None), (3, 0, None)]


def test_percentiles_keep_the_group_without_a_key(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0), (None, 4.0)], "k string, v double")
    got = {r["k"]: r["p50"] for r in exact_percentiles(df, ["k"], "v", {"p50": 50}).collect()}
    assert got == {"a": 1.0, None: 3.0}


def test_saving_a_run_again_leaves_nothing_behind(spark, tmp_path):
    store = RunStore(spark, str(tmp_path))
    rows = lambda n: spark.range(n).select(F.col("id").cast("string").alias("case_id"))
    for run in ("a", "a b=c*"):
        store.save(run, "2026-01-01", {"runs": rows(1), "cases": rows(3), "findings": rows(2)})
    store.save("a b=c*", "2026-02-01", {"runs": rows(1), "cases": rows(1)})
    counts = {t: {r["run_id"]: r["count"] for r in store.read(t).groupBy("run_id").count().collect()} for t in ("runs", "cases", "findings")}
    assert counts == {"runs": {"a": 1, "a b=c*": 1}, "cases": {"a": 3, "a b=c*": 1}, "findings": {"a": 2}}


def test_patterns_and_durations():
    assert java_regex(r"\${jndi:(ldap|rmi)") == r"(?iudU)\$\{jndi:(ldap|rmi)"
    assert java_regex("a{,3}b{2}[[]") == r"(?iudU)a{0,3}b{2}[\[]"
    assert seconds_of("500ms") == 0.5 and seconds_of("1m 30s") == 90 and seconds_of("x", 7) == 7
    with pytest.raises(ValueError):
        seconds_of("5 parsecs")


def test_a_cluster_needs_a_shared_folder():
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_folder(Session())
