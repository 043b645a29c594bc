from __future__ import annotations

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa

from proofgrid.llm import components, jaccard, queries
from proofgrid.session import dealt_out

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(docs)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= 80 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def edited(words, rng, share):
    return [w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in words]


def fixture():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    docs = []
    for size in (6, 12, 60, 200):
        base = [word() for _ in range(size)]
        docs += [edited(base, rng, share) for share in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04) for _ in range(4)]
    line = [word() for _ in range(30)]
    docs += [[word() for _ in range(rng.randrange(5, 60))] + line for _ in range(40)]
    # A chain whose ends aren't similar.
    chain = [word() for _ in range(100)]
    docs += [chain[i : i + 90] for i in range(0, 11)] + [chain + [word() for _ in range(k)] for k in range(0, 60, 4)]
    texts = [" ".join(d) for d in docs] + ["one two", "ONE  two", "one", "", None, None, " \n\t", "é É ñ", "É É ñ", "a " * 30, "a " * 9]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[0], (None, texts[0]), (None, "alone without id"), (7, "an id again")]


def test_matches_brute_force(spark):
    docs = fixture()
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(map(tuple, got.drop("th").collect()), key=str) == brute(docs)


def test_small_batches_and_many_buckets(spark, monkeypatch):
    docs = fixture()
    monkeypatch.setattr(jaccard, "BUCKET_POSTINGS", 200)
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, got.drop("th").collect()), key=str) == brute(docs)


def test_query_matches_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, queries.op8_ngram_join(spark, FOLDER).collect()), key=str)
    assert got == brute(docs)
    assert any(r[0] != r[2] for r in got)


def test_one_of_each_group_stays(spark):
    docs = [(5, "a b c d e f"), (3, "A b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "other words here"), (None, "q r s"), (None, "q r s"), (1, ""), (2, None)]
    rows = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, th int")
    kept = jaccard.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(((r[0], r[1] and r[1].lower()) for r in kept.collect()), key=str) == sorted(
        [(3, "a b c d e f"), (9, "other words here"), (None, "q r s"), (1, ""), (2, None)], key=str
    )


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(1)
    names = rng.sample(range(-1000, 1000), 400)
    edges = [(names[i], names[i + 1]) for i in range(100)] + [(names[150], names[i]) for i in range(151, 250)] + [(names[300], names[301])] * 3
    got = {r[0]: r[1] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for part in (names[:101], names[150:250], names[300:302]):
        want |= {x: min(part) for x in part if x != min(part)}
    assert got == want


def test_packing_is_reversible():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(30)]
    batch = jaccard._packed(list(range(-15, 15)), sets, 7)
    got = sorted((b, int(k), int(r)) for b, d in zip(batch["bucket"].to_pylist(), batch["data"].to_pylist(), strict=True) for k, r in zip(*jaccard._unpacked(d), strict=True))
    want = sorted((int(k >> np.uint64(32)) % 7, int(k) & (2**40 - 1), r) for r, s in zip(range(-15, 15), sets, strict=True) for k in s)
    assert got == want


def test_the_index_keeps_all_bits():
    low = np.uint64(0x12_3456_789A)
    keys = np.sort(np.array([low, low + np.uint64(1 << 43), low + np.uint64(1 << 63)], np.uint64))
    batch = jaccard._packed([5, -6], [keys[:2], keys[1:]], 8)
    found = [tuple(zip(*(x.tolist() for x in jaccard._whole_keys(b.as_py())), strict=True)) for b in batch.column("data")]
    assert sorted(p for part in found for p in part) == sorted([(int(k), 5) for k in keys[:2]] + [(int(k), -6) for k in keys[1:]])


def test_one_template_around_the_threshold(spark, monkeypatch):
    """Many texts of one template, pairwise just under, at or just over the threshold; in stars and pair by pair."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(97)]
    docs = []
    for i in range(700):
        words = base[: rng.randrange(86, 98)]
        for _ in range(rng.choice((1, 1, 1, 2))):
            words[rng.randrange(5, len(words) - 5)] = f"x{i}" if rng.random() < 0.8 else f"y{i % 40}"
        docs.append((i, " ".join(words)))
    want = brute(docs)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(table).drop("th").collect()), key=str) == want
    assert 3 < len({r[2] for r in want}) < 700
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    assert sorted(map(tuple, jaccard.jaccard_components(table).drop("th").collect()), key=str) == want


def test_index_size_follows_postings_not_buckets():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2))
    planes = {}
    for buckets in (16, 2048):
        batch = jaccard._packed([7], [keys], buckets)
        planes[buckets] = sum(len(pa.compress(x.as_py(), "lz4", asbytes=True)) for x in batch.column("data")) - 40 * len(batch)
    assert planes[2048] < 1.04 * planes[16]


def test_labels_come_to_classes_not_to_their_lists(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(edited(base, rng, 0.02))) for i in range(300)]
    monkeypatch.setattr(jaccard, "SMALL_LISTS", 1)
    folder = []
    real = jaccard.cut_lineage
    monkeypatch.setattr(jaccard, "cut_lineage", lambda df: folder.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.jaccard_components(table).drop("th").collect()), key=str) == brute(docs)
    later = [plan for plan in folder if "Join LeftOuter" in plan and "star" in plan]
    # The lists are dealt out above the join with the labels, which then has a row for each class.
    assert later and all(plan.index("Generate inline") < plan.index("Join LeftOuter") for plan in later)


def test_pairs_come_to_the_key_lists(spark, monkeypatch):
    docs = [(i, f"a b c d e f g h {i % 3} i j k l m n o p q r s t u v w x y z {i // 3}") for i in range(30)]
    kept, plans = [], []
    deal, verify = jaccard.dealt_out, jaccard._verified
    monkeypatch.setattr(jaccard, "dealt_out", lambda df, *where: kept.append(deal(df, *where)) or kept[-1])
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, near: plans.append((pairs, near)) or verify(pairs, near))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = spark.createDataFrame(docs, "doc_id long, text string")
        assert sorted(map(tuple, jaccard.jaccard_components(table).drop("th").collect()), key=str) == brute(docs)
        assert len(kept) == 1 and plans and all(near is kept[0] for _, near in plans)
        pairs = spark.range(5).selectExpr("id a", "id + 1 b", "id c", "id + 1 d")
        # Pairs move to the first list and with it to the second; the lists are read where they lie.
        plan = verify(pairs, kept[0])._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_dealt_out_rows_are_whole_and_leave_no_name(spark):
    rows = spark.createDataFrame([(i % 7 or None, f"t{i}") for i in range(200)], "ref long, t string")
    names = len(spark.catalog.listTables())
    out = dealt_out(rows, "ref", 5)
    assert sorted(out.collect(), key=str) == sorted(rows.collect(), key=str)
    assert len(spark.catalog.listTables()) == names


def test_only_texts_that_can_have_partners_stay():
    """Of two texts with ten keys each, the one of which others hold eight."""
    def shared(ref, keys):
        entries = np.zeros(len(keys), jaccard.ENTRY)
        entries["key"], entries["df"] = keys, 2
        return np.array([1], "<u4").tobytes() + np.array([ref], "<i8").tobytes() + np.array([len(keys)], "<u4").tobytes() + entries.tobytes()

    table = pa.table({"slot": pa.array([1, 1, 1], pa.int32()), "data": pa.array([shared(-7, range(5)), shared(9, range(7)), shared(-7, [7, 8, 9])], pa.binary())})
    classes = pa.table({"ref": pa.array([9, -7, 17], pa.int64()), "n": pa.array([10, 10, 3], pa.int64())})
    got = jaccard._near(table, classes)
    assert (got["ref"].to_pylist(), got["n"].to_pylist()) == ([-7], [10])
    assert jaccard._held(got["keys"][0])["key"].tolist() == [0, 1, 2, 3, 4, 7, 8, 9]
    assert len(jaccard._near(table.slice(0, 0), classes)) == 0
