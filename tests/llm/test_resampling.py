from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from proofgrid.llm import queries, resampling

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def buckets_of(text, buckets=10_000):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return len(words), [zlib.crc32(f.encode()) % buckets for f in words + pairs]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank), sorted."""
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(buckets_of(x)[1])
    for x in target:
        t.update(buckets_of(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (all_s + 10_000)) / ((s[b] + 1) * (all_t + 10_000))))
    rows = []
    for d, x in docs:
        n, found = buckets_of(x)
        weight = sum(map(gain, found)) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((n, d, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    drawn = [(*r[1:], k) for k, r in enumerate(order[: 25 * len(order) // 100], 1)]
    rest = order[25 * len(order) // 100 :] + [r for r in rows if r[0] < 20]
    return sorted(drawn + [(*r[1:], None) for r in rest], key=str)


def drawn(spark, docs, target):
    table = spark.createDataFrame([(d, x, 1, "x") for d, x in docs], "doc_id long, text string, weight int, rank string")
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    gains = resampling.bucket_gains(resampling.bucket_counts(table), resampling.bucket_counts(wanted))
    return sorted(map(tuple, resampling.draw(resampling.weigh(table, gains)).drop("n_words").collect()), key=str)


def test_crcs_compose():
    rng = random.Random(1)
    right = [rng.randbytes(n) for n in (0, 1, 2, 3, 7, 40, 255, 256, 257, 70_001) for _ in range(3)]
    left = [rng.randbytes(rng.randrange(50)) for _ in right]
    crc = lambda x: np.array([zlib.crc32(b) for b in x], np.uint32)
    got = resampling.composed(crc(left), crc(right), np.array(list(map(len, right))))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in zip(left, right, strict=True)]


def odd_rows():
    rng = random.Random(2)
    words = [*"abcdefgh", "É", "é", "ÀB", "naïve", "x" * 60, "99", "中文", "ſ", "K"]
    rows = [(d, " ".join(rng.choice(words) for _ in range(rng.randrange(15, 60)))) for d in range(200)]
    rows += [(300 + d, "a shared text " * 10) for d in range(40)] + [(400, "same row " * 12)] * 50
    rows += [(None, "no id " * 15), (None, "no id at all " * 15), (401, None), (402, ""), (403, " .,;!\n\t"), (404, "one")]
    rows += [(405, "A-b_C.d\x00e\x7ff{g}" * 9), (400, "another text of this id " * 9), (406, "long text, 中 " * 30_000), (407, "z" * 50_000)]
    return rows


@pytest.mark.parametrize("step", [resampling.STEP_BYTES, 64])
def test_steps_and_pieces(monkeypatch, step):
    """Whatever the step, and however full the dictionary, the same features come out."""
    monkeypatch.setattr(resampling, "STEP_BYTES", step)
    monkeypatch.setattr(resampling, "MOST_WORDS", 12)
    texts = [x or "" for _, x in odd_rows() if len(x or "") < 5_000] + ["y" * 300, "b " * 100 + "q" * 200 + " b" * 3, "w" * 63 + " " + "v" * 64 + " u"]
    resampling.dictionary.cache_clear()
    for _ in range(2):
        found = [Counter() for _ in texts]
        for w, of_w, p, of_p in resampling.features([x.encode() for x in texts], 997):
            for b, k in [*zip(w.tolist(), of_w.tolist(), strict=True), *zip(p.tolist(), of_p.tolist(), strict=True)]:
                found[k][b] += 1
        assert found == [Counter(buckets_of(x, 997)[1]) for x in texts]
    assert resampling.dictionary().built == 12
    resampling.dictionary.cache_clear()


def test_odd_rows_match_brute_force(spark):
    rows, target = odd_rows(), ["a b c d", None, "", "中文 naïve É", "a b"]
    want = brute(rows, target)
    assert drawn(spark, rows, target) == want
    assert sum(r[4] is not None for r in want) > 60


def test_empty_tables(spark):
    assert drawn(spark, [], ["a"]) == []
    assert drawn(spark, [(1, "a " * 30)], []) == brute([(1, "a " * 30)], [])


def test_query_matches_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    target = [r[0] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("text").collect()]
    got = queries.op13_resample(spark, FOLDER)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, target)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
