from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from proofgrid.llm import negatives, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, score string, id int"


def brute(rows, positives=5, hard=10):
    """Rows as (id, vector, label); anchors are the ids divisible by 100."""
    sound = {
        (i, label, tuple(min(2**63 - 1, max(1 - 2**63, math.floor(256 * x) if math.isfinite(256 * x) else int(math.copysign(2**63, x)))) for x in v))
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    end = negatives.LARGEST
    out = []
    for i, label, v in sound:
        if i % 100:
            continue
        scored = [(-max(-end, min(end, sum(a * b for a, b in zip(v, w, strict=True)))), j, other) for j, other, w in sound if j != i and len(w) == len(v)]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            some = sorted(x for x in scored if x[2] != label and -30 * s <= -100 * x[0] <= -90 * s)[:hard]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n, _) in enumerate(some, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, negatives.mine(table, F.col("vec_id") % 100 == 0, **how).collect()))


def test_odd_rows_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.1, 0.2) for _ in range(5)], rng.randrange(3)) for i in range(250)]
    rows += [(1000 + i, [0.25, 0.25, 0.25, 0.25, 0.25], i % 3) for i in range(60)]  # ties
    rows += [rows[0], rows[0], rows[3]]  # repeated rows
    rows += [(100, [0.5, 0.4, 0.3, 0.2, 0.1], 2), (5, [0.1, 0.9, 0.3, 0.2, 0.1], 0)]  # shared ids
    rows += [(None, [0.1] * 5, 1), (300, None, 1), (400, [0.1] * 5, None), (500, [0.1, None, 0.1, 0.1, 0.1], 1)]
    rows += [(600, [0.1, math.nan, 0.1, 0.1, 0.1], 1), (700, [0.1, math.inf, 0.1, 0.1, 0.1], 1)]
    rows += [(800, [], 1), (801, [], 1), (802, [], 2), (900, [0.5, 0.5], 1), (901, [0.5, 0.4], 1), (902, [0.3, 0.3], 0)]
    rows += [(1100, [-0.5] * 5, 7), (1101, [0.5] * 5, 7)]  # a negative positive
    want = brute(rows)
    assert mined(spark, rows) == want
    assert len({r[0] for r in want}) >= 6
    assert mined(spark, rows, positives=2, negatives=3) == brute(rows, 2, 3)


@pytest.mark.parametrize("scale", [1e4, 1e9, 1e300])
def test_large_components(spark, scale):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0.2, 0.3) * (scale if i % 5 else 1) for _ in range(4)], i % 2) for i in range(0, 400, 4)]
    assert mined(spark, rows) == brute(rows)


def test_blocks_of_many_packs(spark, monkeypatch):
    """Packs of one label are left out, blocks come one by one."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(negatives, "PACK", 8)
    ids, labels, vectors = np.arange(300), rng.integers(0, 4, 300), rng.integers(-90, 150, (300, 6))
    labels[:120] = 9
    block = negatives.Block(ids, labels, vectors, 150)
    for label in (0, 3, 5, 9, 2**63 - 1):
        for found, same in ((block.alike, True), (block.unlike, False)):
            got = dict(zip(*[x.tolist() for x in found(vectors[7].tolist(), label, 7)], strict=True))
            assert got == {i: int(vectors[i] @ vectors[7]) for i in range(300) if (labels[i] == label) == same and i != 7}


def test_empty_table(spark):
    assert mined(spark, []) == []


def test_query_matches_brute_force_and_its_sql(spark):
    rows = [(r[0], r[1], r[2]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want = brute([(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows])
    got = queries.op11_hard_negatives(spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{FOLDER}/embeddings.parquet')")
    assert sorted(con.sql(queries.SQL["op11_hard_negatives"]).fetchall()) == want
    assert dict(got.dtypes)["rank"] == "int"
    assert want
