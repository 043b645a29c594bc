from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from proofgrid.llm import bpe, queries

FOLDER = "/root/testdata/sf0.001"
PARTS = ["a", "B", " ", "  ", "\n", "\t", "'s", "'", "1", "²", "é", "ß", "漢", " ", "　", "\x1c", "\x85", "😀", "<|endoftext|>", "<|", "...", "́", "Ⅷ", "​", "\r\n", "'ll", " ", "٣", "_", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(path(bpe.TOKENIZER))


def test_ids_and_texts_match_the_library(library):
    mine, rng = bpe.load(path(bpe.TOKENIZER)), random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(5000)]
    texts += ["", "a" * 5000, "ab" * 3000 + " " * 700 + "x", "é" * 2000, "<|endoftext|>" * 3]
    for text in texts:
        ids = np.frombuffer(mine.encode(text), np.int32).tolist()
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text[:80]
        assert mine.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_the_tree_merges_the_leftmost_lowest_rank(library):
    mine, rng = bpe.load(path(bpe.TOKENIZER)), random.Random(2)

    def plain(ids):
        while True:
            ranked = [(mine.rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in mine.rank]
            if not ranked:
                return ids
            r, i = min(ranked)
            ids = [*ids[:i], mine.merged[r], *ids[i + 2 :]]

    for _ in range(400):
        ids = [mine.single[b] for b in "".join(rng.choice("theinrats ") for _ in range(rng.randrange(60))).encode()]
        assert mine.merge([*ids]) == plain(ids)


def test_any_ids_decode(library):
    mine, rng = bpe.load(path(bpe.TOKENIZER)), random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(20))]
        assert mine.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_a_full_memo_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    mine = bpe.Bpe(path(bpe.TOKENIZER))
    text = "the cat sat on the mat and the dog sat too"
    assert np.frombuffer(mine.encode(text), np.int32).tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(mine.memo) <= 3


def test_query_matches_the_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = queries.op7_bpe(spark, FOLDER).collect()
    assert len(got) == len(texts)
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in got:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(decoded))


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, 1), (1, "", 2), (2, "x y", 3), (2, "x y", 3)], "doc_id long, text string, token_ids int")
    out = bpe.decode(bpe.encode(rows))
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    assert sorted((len(r["token_ids"]), r["decoded"]) for r in out.collect()) == [(0, ""), (0, ""), (2, "x y"), (2, "x y")]
    assert bpe.encode(rows.limit(0)).collect() == []


def test_lists_are_decoded_in_steps(monkeypatch):
    coder = bpe.load(bpe.tokenizer_path(bpe.TOKENIZER))
    texts = ["", "one two", "ß 漢字 🙂", "a" * 50]
    lists = [list(np.frombuffer(coder.encode(t), np.int32)) for t in texts] + [None, [], coder.single[0xC3:0xC4], list(range(200))]
    monkeypatch.setattr(bpe, "STEP_IDS", 5)
    array = pa.array([[9], *lists], pa.list_(pa.int32())).slice(1)
    # Python numbers for all ids of a step at once, not for each by itself.
    assert coder.decode_all(array).to_pylist() == [coder.decode(x or []) for x in lists]
    assert coder.decode_all(array.slice(0, 0)).to_pylist() == []
