"""Shards of near-equal bytes from sampled splitters.

A size-weighted sample of the sort keys gives quantile boundaries; records are ranged by them, exact sums per range show
overfull ranges, which are subdivided by a denser sample, and running sums inside a range place each record in a shard.
No step sorts all rows in one task, and no shuffle carries more than the given columns.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.session import cut_lineage

RANGES_PER_SHARD = 8
POINTS_PER_RANGE = 24
OVERFULL = 2.0
REFINEMENTS = 3


def _points(rows: DataFrame, step: float, seed: int) -> DataFrame:
    """Keys with sample points: a row of size s gets s / step points on average, decided by its own hash."""
    u = (F.xxhash64(F.lit(seed), "_k1", "_k2") / F.lit(2.0**64)) + 0.5
    return rows.select("_k1", "_k2", F.floor(F.col("_size") / F.lit(float(step)) + u).alias("_w")).where("_w > 0")


def _quantiles(points: DataFrame, per_range: int) -> list[tuple[int, int]]:
    """The key after every `per_range` points; the sample's size is set by parameters, not by the input."""
    order = Window.orderBy("_k1", "_k2")
    run = points.groupBy("_k1", "_k2").agg(F.sum("_w").alias("_w")).withColumn("_after", F.sum("_w").over(order))
    cut = run.where(F.floor(F.col("_after") / per_range) > F.floor((F.col("_after") - F.col("_w")) / per_range))
    return [(r[0], r[1]) for r in cut.select("_k1", "_k2").collect()]


def _range_of(bounds: list[tuple[int, int]]) -> Column:
    """How many boundaries lie at or before a row's key."""
    if not bounds:
        return F.lit(0)
    cuts = F.from_json(F.lit(json.dumps([{"_k1": a, "_k2": b} for a, b in bounds])), "array<struct<_k1: bigint, _k2: bigint>>")
    return F.size(F.filter(cuts, lambda b: b <= F.struct("_k1", "_k2")))


def shard_by_bytes(rows: DataFrame, key: list[str], size: str, shards: int = 24) -> DataFrame:
    """All rows and columns of `rows` with `shard` (0 to shards - 1) and `slot` (gapless from 0 in each shard).

    `key` names one or two long columns. Rows are laid out in key order and cut where the running bytes pass
    a multiple of total / shards, so shards differ by about one record. Equal first keys stand together and are only
    divided where a shard ends. Null keys and sizes read as 0. Rows with equal keys are interchangeable. An empty table
    gives an empty table. `shard` and `slot` replace columns of the same name.
    """
    cols = [c for c in rows.columns if c not in ("shard", "slot")]
    keys = [F.coalesce(F.col(k).cast("long"), F.lit(0)) for k in key] + [F.lit(0).cast("long")]
    rows = cut_lineage(rows.select(*cols, keys[0].alias("_k1"), keys[1].alias("_k2"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size")))
    total = rows.agg(F.sum("_size")).first()[0] or 0
    ranges = shards * RANGES_PER_SHARD
    share = max(total / ranges, 1)
    bounds = _quantiles(_points(rows, share / POINTS_PER_RANGE, 0), POINTS_PER_RANGE)
    for again in range(1, REFINEMENTS + 1):
        ranged = rows.withColumn("_range", _range_of(bounds))
        # Bounded by the number of ranges.
        sizes = ranged.groupBy("_range").agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows")).collect()
        overfull = [r["_range"] for r in sizes if r["bytes"] > OVERFULL * share and r["rows"] > 1]
        more = set()
        if overfull and again < REFINEMENTS:
            dense = _points(ranged.where(F.col("_range").isin(overfull)), share / POINTS_PER_RANGE / 4**again, again)
            more = set(_quantiles(dense, POINTS_PER_RANGE * 4**again // 2)) - set(bounds)
        if not more:
            break
        bounds = sorted({*bounds, *more})
    spark, at_bytes, at_rows, starts = rows.sparkSession, 0, 0, []
    for r in sorted(sizes):
        starts.append((r["_range"], at_bytes, at_rows))
        at_bytes, at_rows = at_bytes + r["bytes"], at_rows + r["rows"]
    before = spark.createDataFrame(starts, "_range int, _bytes long, _rows long")
    order = Window.partitionBy("_range").orderBy("_k1", "_k2")
    so_far = F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_size") + F.col("_bytes")
    # One row per range: a parameter bounds it.
    placed = ranged.join(F.broadcast(before), "_range").select(
        *cols,
        F.least(F.floor(so_far * shards / F.lit(max(total, 1))), F.lit(shards - 1)).cast("int").alias("shard"),
        (F.row_number().over(order) - 1 + F.col("_rows")).alias("_row"),
    )
    placed = cut_lineage(placed)
    first = placed.groupBy("shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(first), "shard").select(*cols, "shard", (F.col("_row") - F.col("_first")).alias("slot"))
