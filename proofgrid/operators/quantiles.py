"""Exact percentiles by rank, without holding a group's values in one place."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.operators.timeline import Running, running


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: Mapping[str, int], decimals: int = 3
) -> DataFrame:
    """Inclusive-interpolation percentiles of a value that carries `decimals` decimal places.

    Equal values are counted first; a running count then gives each value the ranks it
    holds, and a percentile reads the two ranks around its position. `percents` maps result
    columns to whole percents. One row per key (one row in all without keys).
    """
    unit = float(10**decimals)
    # A NULL key is a group like any other: inside a struct it compares equal to itself.
    names = [f"_key{i}" for i in range(max(len(keys), 1))]
    group = [F.struct(F.col(k).alias("k")).alias(n) for n, k in zip(names, keys)] or [F.struct(F.lit(0).alias("k")).alias(names[0])]
    counted = (
        df.filter(F.col(value).isNotNull())
        .select(*group, F.round(F.col(value) * unit).cast("bigint").alias("_v"))
        .groupBy(*names, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = counted.groupBy(*names).agg(F.sum("_n").alias("_total"))
    ranked = running(counted, names, "_v", [Running("_upto", "sum", F.col("_n"))], 100_000)
    joined = ranked.join(totals, names)
    picks, results = [], []
    for name, percent in percents.items():
        steps = (F.col("_total") - 1) * percent
        low = F.floor(steps / 100).cast("bigint")
        for side, rank in (("lo", low), ("hi", F.least(low + 1, F.col("_total") - 1))):
            holds = (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{side}_{name}"))
        picks.append(F.max(steps % 100).alias(f"_step_{name}"))
        low_v, high_v, step = (F.col(f"_{s}_{name}") for s in ("lo", "hi", "step"))
        results.append(
            F.round((low_v * (100 - step) + high_v * step) / F.lit(100.0) / F.lit(unit), decimals).alias(name)
        )
    named = [F.col(f"{n}.k").alias(k) for n, k in zip(names, keys)]
    return joined.groupBy(*names).agg(*picks).select(*named, *results)
