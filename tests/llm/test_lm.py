from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from proofgrid.llm import elias_fano, lm, queries

FOLDER = "/root/testdata/sf0.001"


def toks(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(docs):
    held = {d: zlib.crc32(str(d).encode() if d is not None else b"") % 7 == 2 for d, _ in docs}
    counts, pairs = Counter(), Counter()
    for d, t in docs:
        if not held[d]:
            w = toks(t)
            counts.update(w)
            pairs.update(zip([None, *w], w))
    n, v = sum(counts.values()), len(counts)
    total = Counter()
    for (a, _), c in pairs.items():
        total[a] += c
    out = {}
    for d, t in docs:
        w = toks(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        out[d] = (held[d], len(w), sum(counts[x] > 0 for x in w), n, base)
    return out, counts, pairs, total


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=300), st.integers(0, 10**9))
def test_elias_fano_gets_and_finds(values, more):
    values = np.array(sorted(values), np.uint64)
    universe = int(values.max()) + 1 + more if len(values) else 1 + more
    s = elias_fano.Sequence(elias_fano.build(values, universe))
    assert s.get(np.arange(len(values))).tolist() == values.tolist()
    asked = np.arange(min(universe, 5001))
    at = s.find(asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(values)))
    have = set(values.tolist())
    for q, i in zip(asked.tolist(), at.tolist(), strict=True):
        assert (i >= 0 and values[i] == q) if q in have else i == -1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 1, 2, 3, 70, 200, 5000, 40_000]), min_size=2, max_size=400), st.integers(0, 10**6))
def test_elias_fano_gives_neighbours(values, more):
    values = np.sort(np.cumsum(np.array(values, np.uint64)) // np.uint64(3))
    s = elias_fano.Sequence(elias_fano.build(values, int(values.max()) + 1 + more))
    asked = np.repeat(np.arange(len(values) - 1), 2)
    asked = np.concatenate([asked, asked[::-1]])
    first, last = s.spans(asked)
    assert first.tolist() == values[asked].tolist() and last.tolist() == values[asked + 1].tolist()
    at = s.find(values, np.zeros(len(values), np.int64), np.full(len(values), len(values)))
    assert values[at].tolist() == values.tolist()
    assert [len(x) for x in s.spans(asked[:0])] == [0, 0]


def test_elias_fano_searches_inside_a_range():
    values = np.array([1, 4, 4, 9, 12, 700, 701], np.uint64)
    s = elias_fano.Sequence(elias_fano.build(values, 10_000))
    assert s.find(np.array([4, 9, 9, 700]), np.array([2, 0, 4, 5]), np.array([7, 3, 7, 6])).tolist() == [2, -1, -1, 5]


def test_query_matches_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want, *_ = brute(docs)
    got = queries.op4_lm_score(spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)
        assert r["score"] < 0
    # The pair model knows more than the word model about texts it has seen.
    assert sum(r["score"] for r in got if not r["held_out"]) > sum(r["base_score"] for r in got if not r["held_out"])


def test_probabilities_sum_to_one_and_follow_counts(spark):
    docs = [(i, t) for i, t in enumerate(["a b a c", "a b", "", None, "b a b é", "A B c c c", "a b a b", "d"] * 4)]
    _, counts, pairs, total = brute(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = lm.train(frame.where(~lm.held_out(frame.doc_id)))
    hashes = {w: int(lm.tokens([w.encode()])[0][0]) if w is not None else int(lm.END) for w in counts}
    order = sorted(counts, key=hashes.get)
    ids, _ = model.words.look_up(np.array([hashes[w] for w in order], np.uint64))
    n, v = model.words.n_tokens, model.words.size
    assert (n, v) == (sum(counts.values()), len(counts))
    for context, i in zip(order, ids, strict=True):
        k = int(np.searchsorted(model.words.offsets, i, side="right")) - 1
        p, back = lm.part(model.paths[k]).pair(np.full(len(ids), i - model.words.offsets[k]), ids, v)
        assert [not math.isnan(x) for x in p] == [(context, w) in pairs for w in order]
        plain = np.array([(counts[w] + 1) / (n + v + 1) for w in order])
        mass = np.where(np.isnan(p), 10 ** back[0] * plain, 10 ** np.nan_to_num(p)).sum() + 10 ** back[0] / (n + v + 1)
        assert mass == pytest.approx(1, abs=1e-3)


def test_two_words_of_context_count(spark):
    texts = ["a b c", "x b d"] * 20 + ["a b c e", "", "b"]
    model = lm.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    ends = [model.score([t.encode()])["score"][0] for t in ("a b c", "a b d", "x b d", "x b c")]
    assert ends[0] > ends[1] + 0.5 and ends[2] > ends[3] + 0.5
    known = [*"abcdex", None]
    hashes = np.array(sorted(int(lm.tokens([w.encode()])[0][0]) if w else int(lm.END) for w in known), np.uint64)
    ids, counts = model.words.look_up(hashes)
    left, right = (x.ravel() for x in np.meshgrid(ids, ids, indexing="ij"))
    q, back, place = model.look_up(model.paths, model.words.offsets, left, right)
    total = model.words.n_tokens + model.words.size + 1
    p2 = np.where(np.isnan(q), back + np.log10((counts[np.searchsorted(ids, right)] + 1) / total), q).reshape(7, 7)
    unseen = back.reshape(7, 7)[:, 0] - math.log10(total)
    for at in np.flatnonzero(place >= 0):
        b = int(np.searchsorted(ids, right[at]))
        q3, back3, _ = model.look_up(model.deep, model.pair_offsets, np.full(7, place[at]), ids)
        mass = (10 ** np.where(np.isnan(q3), back3 + p2[b], q3)).sum() + 10 ** (back3[0] + unseen[b])
        assert mass == pytest.approx(1, abs=2e-3)


def test_all_parts_share_one_discount(spark, monkeypatch):
    texts = [f"w{i} v{i % 7} w{i * i % 50} end" for i in range(60)] * 2 + [f"once{i} more{i % 3}" for i in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    few = lm.train(docs)
    monkeypatch.setattr(lm, "LEAST_PART_BITS", 5)
    many = lm.train(docs)
    assert (len(few.paths), len(many.paths)) == (8, 32)
    raw = [t.encode() for t in [*texts, "w1 v2 unseen end", "more1 w3 v5"]]
    assert few.score(raw)["score"] == pytest.approx(many.score(raw)["score"], abs=0.02)


def test_odd_tables(spark):
    frame = spark.createDataFrame([(None, None, 1.0), (1, "", 2.0), (1, "", 2.0), (2, "x " * 5000, None)], "doc_id long, text string, score double")
    model = lm.train(frame)
    out = lm.score(frame, model).collect()
    assert sorted((r["n_tokens"], r["n_known"]) for r in out) == [(1, 1), (1, 1), (1, 1), (5001, 5001)]
    empty = frame.limit(0)
    assert lm.score(empty, model).collect() == []
    none = lm.train(empty)
    assert [r["score"] for r in lm.score(frame.limit(1), none).collect()] == [0.0]
