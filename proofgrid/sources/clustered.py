"""Event tables stored by day and log source, so that a run reads the days and sources it looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files that a day of one source is divided into at most.
FILES = 8


def write_events(events: DataFrame, place: str, at: str = "us", source: str = "event_type", files: int = FILES) -> None:
    """Write `events` under `place` with folders day=.../source=...; `at` is in microseconds.

    A day of one source is dealt to up to `files` tasks, so that a hot one is written by several; inside a file events lie
    in order of time, which lets row groups be skipped. Events without time or source go to the folder of the null value.
    """
    slot = F.pmod(F.xxhash64(at), F.lit(files))
    dated = events.withColumn("day", F.to_date(F.timestamp_micros(F.col(at))))
    dealt = dated.repartition("day", source, slot).sortWithinPartitions("day", source, at)
    dealt.write.partitionBy("day", source).parquet(place)


def read_events(spark: SparkSession, place: str) -> DataFrame:
    """The stored events; tests on `day` and on the source select folders."""
    return spark.read.parquet(place)
