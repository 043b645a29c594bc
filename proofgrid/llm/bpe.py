"""Byte-level BPE encoding and decoding.

Texts are cut by the tokenizer's pattern; in each piece a segment tree holds the rank of every adjacent pair. Its root is
the leftmost pair of the lowest rank; a merge changes three leaves and their paths to the root, until no pair can merge.
The trees of all new pieces of an Arrow batch stand side by side in one array and take their merges in step; long
pieces have a tree of their own. A bounded memo keeps the ids of chunks seen before.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The byte-level pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "byte_bpe_50k.json"
#: Chunks remembered by a worker in each of two generations, and the longest of them.
MEMO = 200_000
LONGEST_MEMO = 64
#: Trees of up to so many leaves are merged side by side, so many at once.
WIDEST = 64
FOREST = 1 << 14
STEP_CHARS = 2_000_000
STEP_IDS = 500_000
HASH, MASK = 0x9E3779B97F4A7C15, 2**64 - 1


def tokenizer_path(name: str) -> str:
    """A path as given, or the place of one of the installed public tokenizers."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary: encodes a text to ids and ids to a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        self.single = [vocab[letters[b]] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[a], vocab[b]), rank)
            self.merged.append(vocab[a + b])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in added.items():
            self.bytes_of[i] = token.encode()
        self.added = added
        self._hash_pairs()
        self.pieces = regex.compile(PIECES)
        self.at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # A space between two characters that are no white space always begins a piece of its own.
        self.at_space = re.compile(r"(?<=\S)(?= \S)")
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """The ids of one piece after all merges, by a segment tree over the ranks of adjacent pairs."""
        n, rank = len(ids), self.rank
        if n < 2:
            return ids
        size = 1 << (n - 1).bit_length()
        none = len(self.merged) * n + n
        # A leaf is rank * n + place, so the least value is the leftmost of the lowest rank.
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank.get((ids[i], ids[i + 1]))
            if r is not None:
                tree[size + i] = r * n + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += size
            tree[i] = value
            i >>= 1
            while i:
                a, b = tree[2 * i], tree[2 * i + 1]
                least = a if a < b else b
                if tree[i] == least:
                    break
                tree[i] = least
                i >>= 1

        def pair(i: int, j: int) -> None:
            r = rank.get((ids[i], ids[j])) if j < n else None
            put(i, none if r is None else r * n + i)

        while tree[1] != none:
            r, i = divmod(tree[1], n)
            gone = after[i]
            ids[i], ids[gone] = self.merged[r], -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            pair(i, after[i])
            if before[i] >= 0:
                pair(before[i], i)
        return [x for x in ids if x >= 0]

    def _hash_pairs(self) -> None:
        """An open-addressing table of pair ranks, for many look-ups at once."""
        self.shift = 64 - max(4, (4 * len(self.rank)).bit_length())
        self.slots = np.full(1 << (64 - self.shift), -1, np.int64)
        self.ranks = np.full(len(self.slots), -1, np.int64)
        self.merged_ids = np.array([*self.merged, 0], np.int64)
        for (a, b), r in self.rank.items():
            at = ((a << 32 | b) * HASH & MASK) >> self.shift
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at], self.ranks[at] = a << 32 | b, r

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of many pairs, -1 where they can't merge."""
        key = a << 32 | b
        at = ((key.astype(np.uint64) * np.uint64(HASH)) >> np.uint64(self.shift)).astype(np.int64)
        out = np.where(self.slots[at] == key, self.ranks[at], -1)
        open_ = np.flatnonzero((self.slots[at] != key) & (self.slots[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            held = self.slots[at[open_]]
            out[open_] = np.where(held == key[open_], self.ranks[at[open_]], -1)
            open_ = open_[(held != key[open_]) & (held >= 0)]
        return out

    def merge_forest(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Packed ids of pieces of at most `width` bytes: `merge` on all of them in step, one tree after the other in one array."""
        n = len(pieces)
        size = np.array([len(p) for p in pieces])
        ids = np.full((n, width + 1), -1, np.int64)
        ids[np.arange(width + 1) < size[:, None]] = np.array(self.single, np.int64)[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        none = (len(self.merged) + 1) * width
        tree = np.full((n, 2 * width), none, np.int64)
        rows, places = np.nonzero(ids[:, 1:] >= 0)
        r = self.ranks_of(ids[rows, places], ids[rows, places + 1])
        tree[rows, width + places] = np.where(r < 0, none, r * width + places)
        level = width >> 1
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level >>= 1
        tree = tree.ravel()
        rows = np.flatnonzero(tree[1 :: 2 * width] < none)
        while len(rows):
            r, i = np.divmod(tree[rows * 2 * width + 1], width)
            gone = after[rows, i]
            right = after[rows, gone]
            ids[rows, i], ids[rows, gone] = self.merged_ids[r], -1
            after[rows, i] = right
            before[rows, np.minimum(right, width)] = i
            left = before[rows, i]
            old = ids[rows, np.minimum(right, width)]
            ahead = self.ranks_of(ids[rows, i], np.maximum(old, 0))
            back = self.ranks_of(np.maximum(ids[rows, left], 0), ids[rows, i])
            base = rows * 2 * width
            has_left = left >= 0
            tree[base + width + gone] = none
            tree[base + width + i] = np.where((old >= 0) & (ahead >= 0), ahead * width + i, none)
            at = (base + width + left)[has_left]
            tree[at] = np.where(back[has_left] >= 0, back[has_left] * width + left[has_left], none)
            node = np.concatenate([width + gone, width + i, (width + left)[has_left]])
            base = np.concatenate([base, base, base[has_left]])
            for _ in range(width.bit_length() - 1):
                node = node >> 1
                tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
            rows = rows[tree[rows * 2 * width + 1] < none]
        alive = ids[:, :width] >= 0
        data = ids[:, :width][alive].astype(np.int32).tobytes()
        ends = np.concatenate([[0], np.cumsum(alive.sum(1) * 4)]).tolist()
        return [data[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def learn(self, chunks: Iterable[str]) -> dict[str, bytes]:
        """Packed ids of chunks of text between safe cuts."""
        cut = {c: [p.encode("utf-8", "surrogatepass") for p in self.pieces.findall(c)] for c in chunks}
        ids: dict[bytes, bytes] = {}
        by_width: dict[int, list[bytes]] = {}
        for piece in {p for found in cut.values() for p in found}:
            if len(piece) > WIDEST:
                ids[piece] = array("i", self.merge([self.single[b] for b in piece])).tobytes()
            else:
                by_width.setdefault(max(4, 1 << (len(piece) - 1).bit_length()), []).append(piece)
        for width, some in by_width.items():
            for i in range(0, len(some), FOREST):
                part = some[i : i + FOREST]
                ids.update(zip(part, self.merge_forest(part, width), strict=True))
        return {c: b"".join(map(ids.__getitem__, found)) for c, found in cut.items()}

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        cut: list[list[str]] = []
        for text in texts:
            parts = self.at_added.split(text) if self.at_added and any(t in text for t in self.added) else [text]
            chunks: list[str] = []
            for part in parts:
                if part in self.added:
                    chunks.append(part)
                elif part:
                    chunks += self.at_space.split(part)
            cut.append(chunks)
        memo = self.memo
        new = {c for chunks in cut for c in chunks if c not in memo}
        # What the older generation knows moves into the younger one, so that common chunks outlive rare ones.
        again = {c: self.older[c] for c in new if c in self.older}
        new.difference_update(again)
        made = {t: array("i", [i]).tobytes() for t, i in self.added.items() if t in new}
        made |= self.learn(new.difference(made))
        made |= again
        out = [b"".join([memo[c] if c in memo else made[c] for c in chunks]) for chunks in cut]
        if len(memo) + len(made) > MEMO:
            self.older, self.memo = memo, {}
            memo = self.memo
        memo.update(islice(((c, x) for c, x in made.items() if len(c) <= LONGEST_MEMO), MEMO))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_all(self, lists: pa.Array) -> pa.Array:
        """Each list's text; the ids of a step become numbers at once, not one by one."""
        out = []
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = np.cumsum(sizes) // STEP_IDS
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(lists)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            tokens = list(map(self.bytes_of.__getitem__, lists.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).tolist()))
            at = 0
            for n in sizes[i:j].tolist():
                out.append(b"".join(tokens[at : at + n]).decode("utf-8", "replace"))
                at += n
        return pa.array(out, pa.string())


@cache
def load(path: str) -> Bpe:
    """One vocabulary per worker process."""
    return Bpe(path)


def _mapped(df: DataFrame, column: str, kind: T.DataType, task) -> DataFrame:
    """`df` with `column` last, made by `task` from each Arrow batch."""
    rest = [c for c in df.columns if c != column]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(column, kind)])

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), task(batch)], names=[*rest, column])

    return df.mapInArrow(batches, schema)


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """All rows and columns with `ids`, the token ids of the whole text; null and empty texts have none.

    Added tokens in a text become their own id. A column named `ids` is replaced.
    """

    def task(batch: pa.RecordBatch) -> pa.Array:
        bpe = load(tokenizer_path(tokenizer))
        texts = [t or "" for t in batch.column(text).to_pylist()]
        step = np.cumsum([len(t) for t in texts]) // STEP_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(texts)]
        packed = [p for i, j in zip(cuts[:-1], cuts[1:], strict=True) for p in bpe.encode_all(texts[i:j])]
        ends = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))

    return _mapped(docs, ids, T.ArrayType(T.IntegerType()), task)


def decode(rows: DataFrame, ids: str = "token_ids", text: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """All rows and columns with `text` decoded from `ids`; a null list reads as empty. A column named `text` is replaced."""

    def task(batch: pa.RecordBatch) -> pa.Array:
        bpe = load(tokenizer_path(tokenizer))
        return bpe.decode_all(batch.column(ids))

    return _mapped(rows, text, T.StringType(), task)
