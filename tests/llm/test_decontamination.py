from __future__ import annotations

import hashlib
import re

from proofgrid.llm import decontamination, queries

FOLDER = "/root/testdata/sf0.001"


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(str(item) if item is not None else "")
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, held = words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    held |= found
        digest = hashlib.sha256(",".join(sorted(held)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(held), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def run(spark, tmp_path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return sorted(map(tuple, queries.op3_decontaminate(spark, str(tmp_path)).collect()), key=str)


def test_query_matches_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted(map(tuple, queries.op3_decontaminate(spark, FOLDER).collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


def test_odd_cases(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(20))
    items = [(1, long), (2, "Alpha"), (3, "one-two"), (4, None), (5, "..."), (6, "A b C"), (None, "zeta Éta"), (1, "w1 w2 w3 w4"), (7, "a a a a a a a a a a a a a a a")]
    docs = [
        (1, long.upper()),
        (2, None),
        (3, ""),
        (4, "alpha ALPHA beta"),
        (5, "one two one, two onetwo"),
        (6, "x " * 5000 + " ".join(f"w{i}" for i in range(3, 16))),
        (7, "a b c a b c; zeta éta zeta Éta"),
        (8, "a " * 40),
        (8, "a " * 40),
        (None, "w1 w2 w3 w4"),
        (9, " ".join(f"w{i}" for i in range(12))),
        (9, "another text"),
    ]
    assert run(spark, tmp_path, docs, items) == brute(docs, items)


def test_without_benchmark(spark, tmp_path):
    docs = [(1, "a b c"), (2, None)]
    assert run(spark, tmp_path, docs, []) == brute(docs, [])


def test_without_documents(spark, tmp_path):
    assert run(spark, tmp_path, [], [(1, "a b c")]) == []


def test_dropping_keeps_clean_rows_and_columns(spark):
    long = " ".join(f"w{i}" for i in range(13))
    docs = spark.createDataFrame([(1, long, 1, "x"), (2, "clean", 2, "y"), (2, "clean", 2, "y"), (None, None, 3, "z")], "doc_id long, text string, d int, th string")
    bench = spark.createDataFrame([(1, long)], "item_id long, text string")
    out = decontamination.drop_contaminated(docs, bench)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(2, "clean", 2, "y"), (2, "clean", 2, "y"), (None, None, 3, "z")], key=str)
