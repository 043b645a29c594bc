"""Trigram language model in Elias-Fano tries, and the log probability of texts.

Training counts words, then word pairs, then triples, over all training texts: tasks count their own batches, packed counts are
dealt out by the first word's hash, and files per part hold a trie's levels: sorted words with counts and back-off
weights, monotone pointers, each word's successors with quantised, smoothed probabilities, and the same for each pair's
successors. Scoring tasks memory-map the parts and look pairs and triples up by successor search among the context's own range.

Words are 64-bit hashes. A pair's probability is discounted and interpolated with the add-one word probability, a triple's with
the probability of its last two words, so that the probabilities after any context sum to one, but for rounding to 256 levels. A text's first
word has one word of context, its end.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm import elias_fano
from proofgrid.llm.texts import whole
from proofgrid.session import cut_lineage, shared_folder

#: Text bytes per part of the model.
PART_BYTES = 64 << 20
LEAST_PART_BITS = 3
BATCH_TOKENS = 3_000_000
STEP_BYTES = 2 << 20
LEVELS = 256
#: The token after each text, also the context of its first word. No word hashes to it but by chance of 2 ** -64.
END = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id trains."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed by END, and the number of tokens of each."""
    words = [t.lower().split() for t in texts]  # bytes: lowers A-Z and splits at ASCII white space only
    flat = np.empty(sum(map(len, words)), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    out = np.full(int(lengths.sum()), END, np.uint64)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(lengths) - 1] = False
    out[inner] = hashed
    return out, lengths


def steps(texts: list[str | None]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= STEP_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with summed counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps and counts, both as byte planes of the width they need."""
    out = [np.array([len(keys)], "<u4").tobytes()]
    for x in (np.diff(keys, prepend=np.uint64(0)), counts.astype(np.uint64)):
        width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
        out += [bytes([width]), x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()]
    return b"".join(out)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, at, out = int(np.frombuffer(data, "<u4", 1)[0]), 4, []
    for _ in range(2):
        width, at = data[at], at + 1
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
        out.append(x.view("<u8").ravel())
        at += n * width
    return np.cumsum(out[0], dtype=np.uint64), out[1].astype(np.int64)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    parts = [_unpacked(x.as_py()) for x in table.column("data")]
    return _counted(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def save(path: str, sections: dict[str, np.ndarray]) -> None:
    """Arrays in one file, each at a multiple of 64 bytes behind a header that lists them."""
    at, index = 0, {}
    for name, x in sections.items():
        index[name] = [x.dtype.str, at, len(x)]
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 8) % 64)
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place, compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for x in sections.values():
            out.write(x.tobytes() + b"\0" * (-x.nbytes % 64))


@lru_cache(4096)
def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: memory-mapped where the shared folder is mounted, read from other stores."""
    store, place = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        raw = np.asarray(np.memmap(place, np.uint8, "r"))
    else:
        with store.open_input_file(place) as file:
            raw = np.frombuffer(file.read(), np.uint8)
    size = int.from_bytes(raw[:8].tobytes(), "little")
    index = json.loads(raw[8 : 8 + size].tobytes())
    base = 8 + size
    return {n: raw[base + at : base + at + count * np.dtype(kind).itemsize].view(kind) for n, (kind, at, count) in index.items()}


@dataclass(frozen=True)
class Words:
    """All training words: files by part, where their ids begin, and the totals."""

    bits: int
    paths: tuple[str | None, ...]
    offsets: tuple[int, ...]
    n_tokens: int

    @property
    def size(self) -> int:
        return self.offsets[-1]

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (-1: unknown) and counts of sorted hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        ends = np.searchsorted(hashes >> np.uint64(64 - self.bits), np.arange(len(self.paths) + 1))
        for p, path in enumerate(self.paths):
            i, j = ends[p], ends[p + 1]
            if i == j or path is None:
                continue
            level = load(path)
            at = np.minimum(np.searchsorted(level["words"], hashes[i:j]), len(level["words"]) - 1)
            hit = level["words"][at] == hashes[i:j]
            ids[i:j][hit] = at[hit] + self.offsets[p]
            counts[i:j][hit] = level["counts"][at[hit]]
        return ids, counts


def _levels(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and code book: LEVELS numbers with about equally many values each, each the mean of its values."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(LEVELS, np.float32)
    cuts = np.quantile(values, np.arange(1, LEVELS) / LEVELS)
    codes = np.searchsorted(cuts, values, side="right").astype(np.uint8)
    n = np.bincount(codes, minlength=LEVELS)
    return codes, (np.bincount(codes, values, minlength=LEVELS) / np.maximum(n, 1)).astype(np.float32)


def trie_part(words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, times: np.ndarray, of_word, size: int, n_tokens: int, discount: float) -> dict[str, np.ndarray]:
    """The sections of one part. `pairs` are sorted (word's place in the part) * size + successor id; `of_word` gives the counts of ids."""
    level = successors(len(words), pairs, times, lambda _, after: (of_word(after) + 1) / (n_tokens + size + 1), size, discount)
    return {"words": words, "counts": counts} | level


def successors(contexts: int, pairs: np.ndarray, times: np.ndarray, shorter, size: int, discount: float) -> dict[str, np.ndarray]:
    """The sections of one level: `pairs` are sorted context's place * size + successor id, `shorter` gives the probabilities of
    successors after shorter contexts."""
    context, after = (pairs // np.uint64(size)).astype(np.int64), (pairs % np.uint64(size)).astype(np.int64)
    total = np.bincount(context, times, minlength=contexts)
    types = np.bincount(context, minlength=contexts)
    weight = discount * types / np.maximum(total, 1)
    p = (times - discount) / total[context] + weight[context] * shorter(context, after)
    code, book = _levels(np.log10(p))
    back, back_book = _levels(np.log10(np.where(types > 0, weight, 1.0)))
    out = {"back": back, "back_book": back_book, "code": code, "book": book}
    for name, values, universe in (("pointer", np.concatenate([[0], np.cumsum(types)]), len(pairs) + 1), ("successor", pairs, contexts * size)):
        out |= {f"{name}_{k}": x for k, x in elias_fano.build(np.asarray(values), universe).items()}
    return out


class Part:
    """One part of the model, for queries."""

    def __init__(self, path: str):
        s = load(path)
        section = lambda name: elias_fano.Sequence({k: s[f"{name}_{k}"] for k in ("head", "low", "high", "ones", "zeros")})
        self.pointer, self.successor = section("pointer"), section("successor")
        self.back, self.back_book, self.code, self.book = s["back"], s["back_book"], s["code"], s["book"]

    def pair(self, context: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """For contexts by place and successors by id: log10 probability (nan: no such pair) and log10 back-off weight."""
        return self.placed(context, after, size)[:2]

    def placed(self, context: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, and the pairs' places (-1: no such pair)."""
        value = context.astype(np.uint64) * np.uint64(size) + np.maximum(after, 0).astype(np.uint64)
        first, last = (x.astype(np.int64) for x in self.pointer.spans(context))
        at = self.successor.find(value, first, np.where(after < 0, first, last))
        p = np.full(len(at), np.nan)
        p[at >= 0] = self.book[self.code[at[at >= 0]]]
        return p, self.back_book[self.back[context]].astype(np.float64), at


@lru_cache(4096)
def part(path: str) -> Part:
    return Part(path)


@dataclass(frozen=True)
class Model:
    words: Words
    paths: tuple[str | None, ...]
    #: Where the parts' pairs begin, and the files of the level below them.
    pair_offsets: tuple[int, ...] = ()
    deep: tuple[str | None, ...] = ()

    def look_up(self, paths: tuple[str | None, ...], offsets: tuple[int, ...], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`Part.placed` for contexts by their place in the whole level (-1: unknown); weight 0 and place -1 where there is none."""
        p, back, place = np.full(len(left), np.nan), np.zeros(len(left)), np.full(len(left), -1, np.int64)
        order = np.argsort(left, kind="stable")
        ends = np.searchsorted(left[order], offsets)
        for k, path in enumerate(paths):
            some = order[ends[k] : ends[k + 1]]
            if path is not None and len(some):
                p[some], back[some], place[some] = part(path).placed(left[some] - offsets[k], right[some], self.words.size)
                place[some] += np.where(place[some] < 0, 0, self.pair_offsets[k] if paths is self.paths and self.pair_offsets else 0)
        return p, back, place

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of some texts."""
        found, lengths = tokens(texts)
        doc = np.repeat(np.arange(len(texts)), lengths)
        unique, at = np.unique(np.append(found, END), return_inverse=True)
        end, at = at[-1], at[:-1]
        ids, counts = self.words.look_up(unique)
        plain = np.log10((counts + 1) / (self.words.n_tokens + self.words.size + 1))
        before = np.concatenate([[end], at[:-1]])
        before[np.cumsum(lengths)[:-1]] = end
        pairs, which = np.unique(before * len(unique) + at, return_inverse=True)
        left, right = pairs // len(unique), pairs % len(unique)
        q, back, place = self.look_up(self.paths, self.words.offsets, ids[left], ids[right])
        p = np.where(np.isnan(q), back + plain[right], q)
        probability = p[which]
        # All but first words have two words of context.
        inner = np.ones(len(at), bool)
        inner[np.concatenate([[0], np.cumsum(lengths)[:-1]])[: len(lengths)]] = False
        inner = np.flatnonzero(inner)
        if self.deep and len(inner):
            _, again = np.unique(which[inner - 1] * len(unique) + at[inner], return_inverse=True)
            one = np.empty(again.max() + 1, np.int64)
            one[again] = inner  # any place of a triple stands for it; first places would ask for a stable sort
            q, back, _ = self.look_up(self.deep, self.pair_offsets, place[which[one - 1]], ids[at[one]])
            probability[inner] = np.where(np.isnan(q), back + p[which[one]], q)[again]
        n = len(texts)
        return {
            "n_tokens": lengths,
            "n_known": np.bincount(doc[counts[at] > 0], minlength=n),
            "base_score": np.bincount(doc, plain[at], minlength=n),
            "score": np.bincount(doc, probability, minlength=n),
        }


def _by_part(docs: DataFrame, text: str, bits: int, count) -> DataFrame:
    """(part, data): what `count` makes of each batch of tokens, sorted keys with counts per part."""
    rows = docs.select(whole(F.col(text)).alias("t"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            found = [(p, _packed(k, c)) for p, k, c in count(np.concatenate([h for h, _ in held]), np.concatenate([n for _, n in held])) if len(k)]
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())], names=["part", "data"])

        for batch in source:
            for texts in steps(batch.column("t").to_pylist()):
                held.append(tokens(texts))
                size += len(held[-1][0])
                if size >= BATCH_TOKENS:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.mapInArrow(batches, "part int, data binary")


def train(docs: DataFrame, text: str = "text") -> Model:
    """A model of all texts of `docs`; its files lie in the shared folder. Null and empty texts are just their end."""
    folder = f"{shared_folder(docs.sparkSession).rstrip('/')}/proofgrid/lm/{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    bits = max(LEAST_PART_BITS, math.ceil(math.log2(max(1, size / PART_BYTES))))
    parts = 1 << bits

    def count_words(found: np.ndarray, _: np.ndarray):
        keys, counts = np.unique(found, return_counts=True)
        ends = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(parts + 1))
        return ((p, keys[i:j], counts[i:j]) for p, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)))

    def write_words(table: pa.Table) -> pa.Table:
        p = table.column("part")[0].as_py()
        keys, counts = _merged(table)
        path = f"{folder}/words-{p}-{uuid.uuid4().hex}"
        save(path, {"words": keys, "counts": counts})
        return pa.table({"part": pa.array([p], pa.int32()), "path": [path], "words": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(counts.sum())], pa.int64())})

    def written(rows: DataFrame, write, schema: str):
        # One row per part.
        return {r["part"]: r for r in cut_lineage(rows.groupBy("part").applyInArrow(write, schema)).collect()}

    made = written(_by_part(docs, text, bits, count_words), write_words, "part int, path string, words long, tokens long")
    sizes = [made[p]["words"] if p in made else 0 for p in range(parts)]
    words = Words(
        bits, tuple(made[p]["path"] if p in made else None for p in range(parts)), tuple(np.cumsum([0, *sizes]).tolist()), sum(r["tokens"] for r in made.values())
    )
    if not made:
        return Model(words, words.paths)

    def count_pairs(found: np.ndarray, lengths: np.ndarray):
        unique, at = np.unique(np.append(found, END), return_inverse=True)
        ids, _ = words.look_up(unique)
        after, end = ids[at[:-1]], ids[at[-1]]
        before = np.concatenate([[end], after[:-1]])
        before[np.cumsum(lengths)[:-1]] = end
        keys, counts = np.unique(before.astype(np.uint64) * np.uint64(words.size) + after.astype(np.uint64), return_counts=True)
        starts = [np.uint64(o) * np.uint64(words.size) for o in words.offsets]
        ends = np.searchsorted(keys, np.array(starts, np.uint64))
        return ((p, keys[i:j] - starts[p], counts[i:j]) for p, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)))

    def built(name: str, count, build) -> tuple[list[str | None], list[int]]:
        """Paths and sizes of one level's parts. All parts' counts are merged before the first is built: they share one discount."""

        def merge(table: pa.Table) -> pa.Table:
            p = table.column("part")[0].as_py()
            keys, times = _merged(table)
            path = f"{folder}/{name}-counts-{p}-{uuid.uuid4().hex}"
            save(path, {"packed": np.frombuffer(_packed(keys, times), np.uint8)})
            n = [len(keys), int((times == 1).sum()), int((times == 2).sum())]
            return pa.table({"part": pa.array([p], pa.int32()), "path": [path]} | {c: pa.array([x], pa.int64()) for c, x in zip(("n", "once", "twice"), n, strict=True)})

        merged = written(_by_part(docs, text, bits, count), merge, "part int, path string, n long, once long, twice long")
        once, twice = (sum(r[c] for r in merged.values()) for c in ("once", "twice"))
        discount = once / (once + 2 * twice) if once and twice else 0.5

        def write(table: pa.Table) -> pa.Table:
            p = table.column("part")[0].as_py()
            path = f"{folder}/{name}-{p}-{uuid.uuid4().hex}"
            save(path, build(p, *_unpacked(load(table.column("path")[0].as_py())["packed"].tobytes()), discount))
            return pa.table({"part": pa.array([p], pa.int32()), "path": [path]})

        rows = docs.sparkSession.createDataFrame([(p, r["path"]) for p, r in merged.items()], "part int, path string")
        # These rows are tiny, the work behind each isn't: a number of partitions that is asked for is not coalesced.
        rows = rows.repartition(parts, "part")
        made = written(rows, write, "part int, path string")
        return [made[p]["path"] if p in made else None for p in range(parts)], [merged[p]["n"] if p in merged else 0 for p in range(parts)]

    def build_pairs(p: int, keys: np.ndarray, times: np.ndarray, discount: float) -> dict[str, np.ndarray]:
        level = load(words.paths[p])

        def of_word(ids: np.ndarray) -> np.ndarray:
            out = np.zeros(len(ids), np.int64)
            which = np.searchsorted(words.offsets, ids, side="right") - 1
            for q in np.unique(which):
                here = which == q
                out[here] = load(words.paths[q])["counts"][ids[here] - words.offsets[q]]
            return out

        return trie_part(np.array(level["words"]), np.array(level["counts"]), keys, times, of_word, words.size, words.n_tokens, discount)

    paths, n_pairs = built("part", count_pairs, build_pairs)
    offsets = np.cumsum([0, *n_pairs]).tolist()
    pairs = Model(words, tuple(paths), tuple(offsets))

    def count_triples(found: np.ndarray, lengths: np.ndarray):
        unique, at = np.unique(np.append(found, END), return_inverse=True)
        ids, _ = words.look_up(unique)
        after, end = ids[at[:-1]], ids[at[-1]]
        before = np.concatenate([[end], after[:-1]])
        firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        before[firsts] = end
        some, which = np.unique(before.astype(np.uint64) * np.uint64(words.size) + after.astype(np.uint64), return_inverse=True)
        _, _, place = pairs.look_up(pairs.paths, words.offsets, (some // np.uint64(words.size)).astype(np.int64), (some % np.uint64(words.size)).astype(np.int64))
        inner = np.ones(len(after), bool)
        inner[firsts] = False
        inner = np.flatnonzero(inner)
        keys, counts = np.unique(place[which[inner - 1]].astype(np.uint64) * np.uint64(words.size) + after[inner].astype(np.uint64), return_counts=True)
        starts = np.array([o * words.size for o in offsets], np.uint64)
        ends = np.searchsorted(keys, starts)
        return ((p, keys[i:j] - starts[p], counts[i:j]) for p, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)))

    def build_triples(p: int, keys: np.ndarray, times: np.ndarray, discount: float) -> dict[str, np.ndarray]:
        upper = part(pairs.paths[p])

        def shorter(context: np.ndarray, after: np.ndarray) -> np.ndarray:
            out = np.empty(len(context))
            for i in range(0, len(context), BATCH_TOKENS // 4):
                here = slice(i, i + BATCH_TOKENS // 4)
                middle = (upper.successor.get(context[here]) % np.uint64(words.size)).astype(np.int64)
                out[here] = 10 ** pairs.look_up(pairs.paths, words.offsets, middle, after[here])[0]
            return out

        return successors(offsets[p + 1] - offsets[p], keys, times, shorter, words.size, discount)

    deep, _ = built("deep", count_triples, build_triples)
    return Model(words, pairs.paths, pairs.pair_offsets, tuple(deep))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All rows and columns with n_tokens, n_known, train_tokens, base_score and score.

    Columns of the same names are replaced. A null or empty text is its end alone. Without training texts every token is
    unknown and has probability 1.
    """
    made = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    rest = [c for c in docs.columns if c not in (*made, "train_tokens")]
    schema = docs.select(rest).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = [model.score(texts) for texts in steps(batch.column(text).to_pylist())]
            columns = [pa.array(np.concatenate([f[c] for f in found]) if found else [], kind) for c, kind in made.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], names=[*rest, *made])

    return docs.select(rest).mapInArrow(batches, schema).withColumn("train_tokens", F.lit(model.words.n_tokens).cast("long"))
