from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from proofgrid.llm import quality

FOLDER = "/root/testdata/sf0.001"
SPACES = " \t\n\x0b\f\r"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_quality(docs, labels):
    known = {r[0]: r[1] for r in labels}
    model = quality.fit([t.encode() for _, t in docs["train"]], np.array([known[d] for d, _ in docs["train"]]))
    kept = []
    for d, t in docs["all"]:
        c = {k: int(x[0]) for k, x in quality.counts([t.encode()]).items()}
        p = model.probability(quality.features(*quality.laid([t.encode()])))[0]
        if c["n_words"] >= 50 and 100 * c["n_repeat_words"] <= 50 * c["n_words"] and p >= quality.KEEP_AT:
            kept.append((d, t))
    return kept


def brute_lines(docs):
    holders = {}
    keyed = [(d, [(x, low(x.strip(SPACES))) for x in t.split("\n")]) for d, t in docs]
    for d, parts in keyed:
        for _, k in parts:
            if len(k) >= 10:
                holders.setdefault(k, set()).add(d)
    gone = lambda d, k: k in holders and len(holders[k]) > 1 and d != min(holders[k])
    return [(d, "\n".join(x for x, k in parts if not gone(d, k))) for d, parts in keyed]


def brute_one_of_each(docs):
    from test_jaccard import brute

    component = {d: c for d, _, c in brute(docs)}
    return [(d, t) for d, t in docs if component[d] == d]


def brute_clean(docs, items):
    from test_decontamination import brute

    bad = {r[0] for r in brute(docs, items) if r[5]}
    return [(d, t) for d, t in docs if d not in bad]


@pytest.fixture(scope="module", autouse=True)
def beside(request):
    import sys

    sys.path.insert(0, str(request.path.parent))
    yield
    sys.path.remove(str(request.path.parent))


def test_pipeline_matches_brute_force(spark):
    from pyspark.sql import functions as F

    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs = [(r["doc_id"], r["text"]) for r in frame.collect()]
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    order = [r[0] for r in frame.orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").collect()]
    texts, known = dict(docs), {d for d, _ in labels}
    train = [(d, texts[d]) for d in order if d in known]
    want = brute_quality({"all": docs, "train": train}, labels)
    assert len(want) < len(docs)
    want = brute_clean(brute_one_of_each(brute_lines(want)), items)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, t, tokenizer.encode(t, add_special_tokens=False).ids) for d, t in want)
    got = sorted((r["doc_id"], r["text"], r["token_ids"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == want


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "en", None, 1), (1, words, "en", None, 1), (2, None, None, "s", None), (3, "", "en", "s", 0), (None, words + " x", None, None, 5)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, FOLDER)
            assert out.columns == docs.columns
            assert out.count() <= len(some)
        out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert out.columns == [*docs.columns, "token_ids", "n_tokens"] and out.count() == len(some)
