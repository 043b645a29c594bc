from __future__ import annotations

import random
import zlib
from collections import defaultdict

from proofgrid.llm import queries, sharding

FOLDER = "/root/testdata/sf0.01"


def check(rows, shards, most):
    sizes, slots = defaultdict(int), defaultdict(list)
    for size, shard, slot in rows:
        assert 0 <= shard < shards
        sizes[shard] += size
        slots[shard].append(slot)
    for x in slots.values():
        assert sorted(x) == list(range(len(x)))
    share = sum(sizes.values()) / shards
    for shard in range(shards):
        assert abs(sizes[shard] - share) <= most, (shard, sizes[shard], share)


def test_query(spark):
    got = queries.op5_shard(spark, FOLDER).collect()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        data = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "bytes", None)
    check([(r["size"], r["shard"], r["slot"]) for r in got], 24, max(r["size"] for r in got))


def test_a_hot_key_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(1, i, rng.randrange(1, 50), "x") for i in range(4000)] + [(rng.randrange(-(2**62), 2**62), i, rng.randrange(1, 50), None) for i in range(6000)]
    rows += [(None, None, None, "n"), (1, 1, 10, "x"), (1, 1, 10, "x"), (5, 5, 9000, "long")]
    frame = spark.createDataFrame(rows, "k1 long, k2 long, bytes long, shard string").repartition(5)
    out = sharding.shard_by_bytes(frame, ["k1", "k2"], "bytes", 10)
    assert out.columns == ["k1", "k2", "bytes", "shard", "slot"]
    got = out.collect()
    assert len(got) == len(rows)
    check([(r["bytes"] or 0, r["shard"], r["slot"]) for r in got], 10, 9000)
    # The same input gives the same shards, however it is dealt out.
    again = {(r["k1"], r["k2"]): r["shard"] for r in sharding.shard_by_bytes(frame.repartition(3), ["k1", "k2"], "bytes", 10).collect()}
    assert all(again[r["k1"], r["k2"]] == r["shard"] for r in got if (r["k1"], r["k2"]) != (1, 1))


def test_equal_keys_stand_together(spark):
    frame = spark.createDataFrame([(i % 7, i, 1) for i in range(7000)], "k long, i long, n long")
    shards = defaultdict(set)
    for r in sharding.shard_by_bytes(frame, ["k", "i"], "n", 14).collect():
        shards[r["k"]].add(r["shard"])
    assert all(len(s) <= 3 for s in shards.values())


def test_small_and_empty_tables(spark):
    assert sharding.shard_by_bytes(spark.createDataFrame([], "k long, n long"), ["k"], "n").collect() == []
    got = sharding.shard_by_bytes(spark.createDataFrame([(3, 8), (3, 8)], "k long, n long"), ["k"], "n", 24).collect()
    assert len(got) == 2 and all(r["slot"] == 0 for r in got)
    zero = sharding.shard_by_bytes(spark.createDataFrame([(3, 0), (4, 0)], "k long, n long"), ["k"], "n", 2).collect()
    assert sorted(r["slot"] for r in zero) == [0, 1]
