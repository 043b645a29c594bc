from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from proofgrid.operators.timeline import on_days
from proofgrid.sources import clustered

DAY = 86_400_000_000


def test_only_days_of_windows_are_opened(spark, tmp_path):
    rows = [(i, i * DAY // 10, ("a", "b")[i % 2]) for i in range(300)]
    place = str(tmp_path / "events")
    clustered.write_events(spark.createDataFrame(rows, "event_id int, us bigint, event_type string"), place)
    every = clustered.read_events(spark, place)
    assert sorted((r["event_id"], r["us"], r["event_type"]) for r in every.collect()) == rows
    windows = spark.createDataFrame([(3 * DAY + 5, 4 * DAY - 1), (9 * DAY, 11 * DAY + 7), (50 * DAY, 51 * DAY), (2, 1), (None, 5)], "lo bigint, hi bigint")
    touched = on_days(every, windows.filter(F.col("lo") != 77)).filter(F.col("event_type") == "a")
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan and "BroadcastHashJoin" in plan
    # What isn't needed can't even be read.
    wanted = {f"day=1970-01-{d:02d}" for d in (4, 10, 11, 12)}
    for file in Path(place).rglob("*.parquet"):
        if file.parts[-3] not in wanted or file.parts[-2] != "event_type=a":
            file.write_bytes(b"nothing")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert sorted(r["event_id"] for r in touched.collect()) == [i for i, us, kind in rows if us // DAY in (3, 9, 10, 11) and kind == "a"]
