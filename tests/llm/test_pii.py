from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from proofgrid.llm import pii, queries

FOLDER = "/root/testdata/sf0.001"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(d):
    total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 16 <= len(d) <= 19 and luhn(d or "1"), 8 <= len(d) <= 15][kind]
            if good:
                out.append((kind, *m.span()))
    return out


ODD = [
    "",
    "a@b a@b.c x@@y.z a.b@c.d.e@f.g- é@x.yz @a.b ..@a--.b_",
    "a@b.c@d.e a@b@c.d me+x%@host.example.com. q@1.2.3.4",
    "1.2.3.4.5.6.7.8 256.1.1.1 0255.001.1.1 1.2.3 .1.1.1.1. 999999.1.1.1 1..2.3.4",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110 4111  1111 12345",
    "+49 (170) 123-4567 +1 +12345678 ++49 170 1234567) +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
]


@pytest.mark.parametrize("text", ODD)
def test_rules_match_regular_expressions(text):
    assert pii.rule_spans(text) == brute(text)


def test_rules_match_on_random_texts():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice("a1.@+- ()é%2") for _ in range(rng.randrange(40)))
        assert pii.rule_spans(text) == brute(text), text


def test_rules_are_linear_on_long_texts():
    for text in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+1" * 100_000, "1.1" * 100_000, "+1" + " " * 300_000):
        pii.rule_spans(text)


def test_gradient_is_the_slope_of_the_loss():
    r = np.random.default_rng(0)
    tagger = pii.Tagger.fresh()
    tagger.w = {k: x.astype(np.float64) for k, x in tagger.w.items()}
    codes, states = r.integers(0, pii.VOCABULARY, (3, 9)), r.integers(0, pii.STATES, (3, 9))
    _, g = tagger.gradient(codes, states)
    for name, w in tagger.w.items():
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in w.shape)
            if name == "embed":
                at = (codes[0, 3], at[1])
            old, h = w[at], 1e-3
            w[at] = old + h
            up, _ = tagger.gradient(codes, states)
            w[at] = old - h
            down, _ = tagger.gradient(codes, states)
            w[at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=2e-2, abs=2e-4), name


def test_decoding_matches_all_paths():
    from itertools import product

    r = np.random.default_rng(1)
    tagger = pii.Tagger.fresh(2)
    tagger.w["move"] = r.normal(0, 1, (pii.STATES, pii.STATES)).astype(np.float32)
    codes = r.integers(0, pii.VOCABULARY, (2, 4))
    path, sure = tagger.decode(codes)
    logits = tagger.logits(codes)
    for n in range(2):
        scores = {p: sum(logits[t, n, s] for t, s in enumerate(p)) + sum(tagger.w["move"][a, b] for a, b in zip(p, p[1:], strict=False)) for p in product(range(pii.STATES), repeat=4)}
        assert tuple(path[n]) == max(scores, key=scores.get)
        total = np.logaddexp.reduce(list(scores.values()))
        want = np.exp(np.logaddexp.reduce([x for p, x in scores.items() if p[2] == path[n][2]]) - total)
        assert sure[n, 2] == pytest.approx(want, rel=1e-3)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return docs, pii.train(docs.where("doc_id % 5 <> 0"))


def test_the_tagger_finds_spans_of_unseen_texts(learned):
    docs, tagger = learned
    texts = [r["text"] for r in docs.where("doc_id % 5 = 0").collect()]
    right = found = want = 0
    for t, spans in zip(texts, pii.learned_spans(texts, tagger), strict=True):
        truth = {s[1:] for s in brute(t)}
        mine = {pii.trimmed(t, i, j) for _, i, j in spans}
        right, found, want = right + len(truth & mine), found + len(mine), want + len(truth)
    assert want > 10 and right >= 0.8 * want and right >= 0.8 * found


def test_every_window_is_read(learned):
    _, tagger = learned
    forms = ["jane.doe at example dot com", "peter at mailhost dot org", "ｊａｎｅ．ｄｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "+٤٩ ١٧٠ ١٢٣ ٤٥٦٧", "jane.doe＠example.com"]
    texts = [f"Please write to {x} about the rest of it." for x in forms] + ["nothing to see here, " * 9]
    found = pii.learned_spans(texts, tagger)
    assert sum(any(i < t.index(x) + len(x) and j > t.index(x) for _, i, j in spans) for t, x, spans in zip(texts, forms, found, strict=False)) >= 4
    assert found[5] == []
    for text in ("", "a", "b" * 64, "c" * 65, "d" * 200):
        starts = pii.window_starts(text)
        assert set(range(len(text))) == {i for k in starts for i in range(k, min(k + pii.WINDOW, len(text)))}


def test_idle_windows_are_those_without_a_marked_path():
    r = np.random.default_rng(6)
    tagger = pii.Tagger.fresh(4)
    tagger.w["bias"][0] = 0.3
    tagger.w["move"] = r.normal(0, 0.3, (pii.STATES, pii.STATES)).astype(np.float32) + np.eye(pii.STATES, dtype=np.float32)
    codes = r.integers(0, pii.VOCABULARY, (300, pii.WINDOW)).astype(np.uint8)
    tagger.w["bias"][0] += np.median([tagger.logits(codes)[:, i, 1:].max() for i in range(300)])
    tagger.w["bias"][0] -= 0.35
    idle = tagger.idle(codes)
    assert idle.tolist() == (~tagger.decode(codes)[0].any(1)).tolist()


@pytest.mark.parametrize("n", [1, pii.IDLE_WINDOWS, 3 * pii.IDLE_WINDOWS + 7])
def test_gains_are_differences_of_logits_and_decide_as_decoding_does(n):
    r = np.random.default_rng(n)
    tagger = pii.Tagger.fresh(5)
    tagger.w = {k: x * (r.normal(1, 0.5, x.shape).astype(np.float32) + (k == "out")) for k, x in tagger.w.items()}
    codes = r.integers(0, pii.VOCABULARY, (n, pii.WINDOW)).astype(np.uint8)
    logits = tagger.logits(codes).transpose(0, 2, 1)
    assert np.abs(tagger.gains(codes) - (logits[:, 1:] - logits[:, :1])).max() < 1e-4
    for lean in (-3, -0.5, 0, 0.5, 3):
        tagger.w["bias"] = np.array([-lean, 0, 0, 0, 0], np.float32)
        tagger.w["move"] = r.normal(0, 1, (pii.STATES, pii.STATES)).astype(np.float32)
        assert tagger.idle(codes).tolist() == (~tagger.decode(codes)[0].any(1)).tolist()


def test_training_reads_the_texts_twice(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(pii, "fit", lambda codes, states: (codes, states))
    texts = [None, "", *(f"Please write to user{i}@example.com or wait, {i} of them may answer." for i in range(28))]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    codes, states = pii.train(made.mapInArrow(counted, "doc_id long, text string"))
    assert seen.value == 2 * len(texts)
    # Windows of all texts, and those with an address rewritten too.
    assert len(codes) == len(states) > 28 * (1 + pii.REWRITTEN) and set(states[states > 0]) == {1}


def test_query_and_odd_rows(spark, learned, tmp_path):
    docs, tagger = learned
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(ODD)] + [(None, None, None), (0, "", "x"), (9, ODD[2] * 3000, "y")], "doc_id long, text string, personal string")
    for r in pii.find_personal_data(rows, tagger).collect():
        spans = [tuple(s)[:3] for s in r["personal"]]
        assert [s for s in spans if s[0] < 4] == brute(r["text"] or "")
        assert all(0 <= a < b <= len(r["text"]) for _, a, b in spans)
    assert pii.find_personal_data(rows.limit(0), None).collect() == []
    assert pii.train(rows.limit(0)) is None
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op10_pii(spark, FOLDER).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r["doc_id"]] or "")
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for k, *_ in want) for x in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["spans"].startswith(text)
