from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from proofgrid.llm import quality, queries

FOLDER = "/root/testdata/sf0.01"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    times, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    worded = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(covered)


def failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


def test_counts_match_brute_force_on_random_texts():
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a", "b", "é ", " ", " ", "\n", "\t", "#", "😀", " ", "a b c "]) for _ in range(rng.randrange(120))) for _ in range(2000)]
    got = quality.counts([t.encode() for t in texts])
    assert [tuple(int(got[c][i]) for c in COUNTS) for i in range(len(texts))] == [brute(t) for t in texts]


def test_a_text_scores_alike_alone_and_among_others():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 << quality.BITS), rng.normal(size=1 << quality.BITS), 0.1, 1.0, 0.0)
    texts = [b"", b"a", b"ab", b"one two three", "é漢 x".encode(), b" \n ", b"word " * 50]
    together = model.probability(quality.features(*quality.laid(texts)))
    alone = [float(model.probability(quality.features(*quality.laid([t])))[0]) for t in texts]
    assert together == pytest.approx(alone)


def test_query_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op6_quality(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]])
        assert tuple(r[c] for c in COUNTS) == want
        assert r["base_failed"] == failed(want) and not (r["kept"] and r["base_failed"])


def test_held_out_rows_are_judged_right(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 > 0"))
    rows = quality.judge(docs.join(labels.where("doc_id % 3 = 0"), "doc_id"), model).collect()
    good = [r["kept"] for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 100 and len(bad) > 20
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.05


def test_calibration_follows_the_share_of_good_rows():
    rng = random.Random(2)
    texts, labels = [], []
    for _ in range(2000):
        noisy = rng.random() < 0.5
        texts.append(" ".join(rng.choice(["alpha", "beta"] if noisy else ["gamma", "delta"]) for _ in range(30)).encode())
        labels.append(int(rng.random() < (0.2 if noisy else 0.9)))
    model = quality.fit(texts, np.array(labels))
    p = model.probability(quality.features(*quality.laid([b"alpha beta " * 15, b"gamma delta " * 15])))
    assert p == pytest.approx([0.2, 0.9], abs=0.1)


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x"), (1, "", "y"), (None, "w " * 60, None), (2, "a b " * 20_000, "z")], "doc_id long, text string, kept string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(rows, none)
    out = quality.judge(rows, model)
    assert [c for c in out.columns if c == "kept"] == ["kept"]
    assert sorted((r["n_words"], r["base_failed"], r["kept"]) for r in out.collect()) == [(0, True, False), (0, True, False), (60, True, False), (40_000, True, False)]
    assert quality.judge(rows.limit(0), model).collect() == []
