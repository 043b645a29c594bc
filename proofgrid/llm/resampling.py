"""Importance resampling towards a target distribution, on hashed words and word pairs.

Distinct words, bounded by delimiters, stand in an Aho-Corasick automaton; each carries its length, its CRC and the CRC of
itself with one space. A scan of a text emits these payloads in order, and neighbouring ones compose to the pair's CRC:
CRC is linear, so that of `a b` is the CRC of `a ` moved on by the length of b, xor the CRC of b. No pair's text is made.
Buckets of CRCs are counted over both tables; the ratio of shares is a bucket's gain, and a document's mean gain its weight.

A worker grows its dictionary from the repeated words it meets, up to a bound. It only saves time: a word outside of it gets
the same payload from its bytes. What is passed on are bucket counts, a fixed number of rows per task, and figures per document.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.llm.texts import whole
from proofgrid.session import cut_lineage

BUCKETS = 10_000
#: Words and letters of a worker's dictionary, and the longest of its words.
MOST_WORDS, MOST_LETTERS, LONGEST_WORD = 200_000, 1_500_000, 40
#: Bytes scanned at a time. Longer texts go through in pieces.
STEP_BYTES = 1 << 21
FULL = 0xFFFFFFFF


def _plain(byte: int) -> int:
    """A-Z lower-cased; a space for whatever is neither a letter, a digit nor part of a character beyond ASCII."""
    byte += 32 if 65 <= byte <= 90 else 0
    return byte if 48 <= byte <= 57 or 97 <= byte <= 122 or byte > 127 else 32


PLAIN = bytes(map(_plain, range(256)))


@cache
def _powers(k: int) -> np.ndarray:
    """What 2**k zero bytes make of a CRC, by its four bytes."""
    if k:
        return moved_by(_powers(k - 1), _powers(k - 1))
    return np.array([[zlib.crc32(b"\0", (b << 8 * j) ^ FULL) ^ FULL for b in range(256)] for j in range(4)], np.uint32)


def moved_by(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@cache
def _moves(length: int) -> np.ndarray:
    """What `length` zero bytes make of a CRC."""
    table = np.array([[b << 8 * j for b in range(256)] for j in range(4)], np.uint32)
    for k in range(length.bit_length()):
        if length >> k & 1:
            table = moved_by(table, _powers(k))
    return table


def composed(left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs of texts put together, from the CRCs of both sides and the lengths of the right one."""
    distinct, at = np.unique(lengths, return_inverse=True)
    if not len(distinct):
        return right
    # Long words are rare; their tables aren't kept.
    tables = np.stack([(_moves if n <= 256 else _moves.__wrapped__)(int(n)) for n in distinct])
    out = right.copy()
    for j in range(4):
        out ^= tables[at, j, left >> np.uint32(8 * j) & np.uint32(255)]
    return out


class Dictionary:
    """Payloads of words: an automaton for those it holds, their bytes for others."""

    def __init__(self):
        self.words: list[bytes] = []
        self.letters = self.built = 0
        self.automaton = ahocorasick.Automaton()
        self.known: list[np.ndarray] = [np.zeros(0, np.uint32)] * 2 + [np.zeros(0, np.int64)]

    @staticmethod
    def payload(words: list[bytes]) -> list[np.ndarray]:
        """CRC, CRC with a space behind, and length."""
        n, crc = len(words), zlib.crc32
        return [np.fromiter(map(crc, words), np.uint32, n), np.fromiter((crc(b" ", crc(w)) for w in words), np.uint32, n), np.fromiter(map(len, words), np.int64, n)]

    def scan(self, data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
        """Starts and payloads of all words of `data`, plain bytes with a space at either end."""
        edges = np.diff((np.frombuffer(data, np.uint8) != 32).view(np.int8))
        starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
        which = np.full(len(starts), -1)
        if self.built:
            emitted = np.fromiter(chain.from_iterable(self.automaton.iter(data.decode("latin-1"))), np.int64)
            which[np.searchsorted(ends, emitted[::2])] = emitted[1::2]
        new = np.flatnonzero(which < 0)
        if not len(new):
            return starts, [x[which] for x in self.known]
        found = [data[i:j] for i, j in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
        counts = Counter(found)
        place = dict(zip(counts, range(len(counts)), strict=True))
        which[new] = np.fromiter(map(place.__getitem__, found), np.int64, len(found)) + self.built
        payloads = [np.concatenate([a, b])[which] for a, b in zip(self.known, self.payload(list(counts)), strict=True)]
        self.learn(counts)
        return starts, payloads

    def learn(self, counts: Counter) -> None:
        """Take in repeated words while there's room; the automaton is built anew when they have grown by a quarter."""
        held = set(self.words[self.built :])
        for word, n in counts.most_common():
            if n < 2 or len(self.words) >= MOST_WORDS or self.letters >= MOST_LETTERS:
                break
            if len(word) <= LONGEST_WORD and word not in held:
                self.words.append(word)
                self.letters += len(word)
        if len(self.words) - self.built > self.built // 4:
            self.automaton = ahocorasick.Automaton()
            for k, word in enumerate(self.words):
                self.automaton.add_word(f" {word.decode('latin-1')} ", k)
            self.automaton.make_automaton()
            self.built, self.known = len(self.words), self.payload(self.words)


@cache
def dictionary() -> Dictionary:
    """A worker's own; its tasks share it."""
    return Dictionary()


def pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """A plain text in pieces; each but the first begins with the last word of the one before, and says so."""
    at, carried = 0, b""
    while at < len(text):
        end = len(text) if len(text) - at <= STEP_BYTES else text.rfind(b" ", at, at + STEP_BYTES)
        if end <= at:
            # A word that fills a piece is taken whole.
            end = text.find(b" ", at + STEP_BYTES)
            end = len(text) if end < 0 else end
        part = text[at:end].strip(b" ")
        if part:
            yield (carried + b" " + part if carried else part), bool(carried)
            carried = part[part.rfind(b" ") + 1 :]
        at = end + 1


def features(texts: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buckets of words, their texts' numbers, buckets of pairs and their texts' numbers, step by step."""
    held: list[bytes] = []
    docs: list[int] = []
    carried: list[bool] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, (crc, spaced, lengths) = dictionary().scan(b" " + b" ".join(held) + b" ")
        begins = np.cumsum([1, *[len(x) + 1 for x in held[:-1]]])
        piece = np.searchsorted(begins, starts, "right") - 1
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        single = np.ones(len(starts), bool)
        single[first[np.array(carried)[piece[first]]]] = False
        doc = np.array(docs)[piece]
        pair = np.flatnonzero(piece[1:] == piece[:-1])
        pairs = composed(spaced[pair], crc[pair + 1], lengths[pair + 1])
        return crc[single] % buckets, doc[single], pairs % buckets, doc[pair]

    for k, text in enumerate(texts):
        for piece, again in pieces(text.translate(PLAIN)):
            held.append(piece)
            docs.append(k)
            carried.append(again)
            size += len(piece)
            if size >= STEP_BYTES:
                yield out()
                held, docs, carried, size = [], [], [], 0
    if held:
        yield out()


def bucket_counts(docs: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any. Null texts have none."""

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in source:
            for words, _, pairs, _ in features(batch.column("t").to_pylist(), buckets):
                total += np.bincount(words, minlength=buckets) + np.bincount(pairs, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    rows = docs.select(whole(F.col(text)).cast("binary").alias("t"))
    return rows.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share over the source's) for each bucket."""

    def counted(rows: DataFrame) -> list[int]:
        # One row per bucket: a parameter bounds it.
        held = {r["bucket"]: r["n"] for r in rows.collect()}
        return [held.get(b, 0) for b in range(buckets)]

    s, t = counted(source), counted(target)
    all_s, all_t = sum(s), sum(t)
    return np.array([math.floor(1000 * math.log((float(b + 1) * float(all_s + buckets)) / (float(a + 1) * float(all_t + buckets)))) for a, b in zip(s, t, strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of `docs`.

    Features are all words and all pairs of neighbouring words, repeats counted; weight is the mean of their buckets' gains,
    rounded down, and 0 for a text without words. Null texts have none, ids may be null, repeated rows are repeated.
    """
    buckets = len(gains)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), whole(F.col(text)).cast("binary").alias("t"))

    def judge(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            n = batch.num_rows
            words, pairs, total = np.zeros((3, n), np.int64)
            for w, of_w, p, of_p in features(batch.column("t").to_pylist(), buckets):
                words += np.bincount(of_w, minlength=n)
                pairs += np.bincount(of_p, minlength=n)
                # Sums of whole numbers, exact below 2**53.
                total += (np.bincount(of_w, gains[w], n) + np.bincount(of_p, gains[p], n)).astype(np.int64)
            count = words + pairs
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("d"), *[pa.array(x, pa.int64()) for x in (words, count, weight)]], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(judge, "doc_id long, n_words long, n_features long, weight long")


def draw(weighed: DataFrame, share: tuple[int, int] = (25, 100), least_words: int = 20, seed: int = 7) -> DataFrame:
    """`weighed` with score and rank: a sample without replacement, in proportion to exp(weight / 1000).

    score is the weight plus Gumbel noise, floor(-1000 ln(-ln u)), where u comes from the digest of seed and id. Of the N rows
    with at least `least_words` words, the floor(share[0] * N / share[1]) highest scores are drawn and ranked from 1; ties go
    to the smaller id (null last), then to fewer features. Rows that aren't drawn have a null rank. A null id's noise is that
    of the empty text. Repeated rows count and rank one by one. An empty table gives an empty table.

    Rows are ranked by ranges of the order, each sorted by itself and moved on by the rows of those before. Equal rows travel
    as one with a count, so no range holds more than its share of different rows.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    names = ["doc_id", "n_words", "n_features", "weight"]
    scored = cut_lineage(weighed.select(*names, (F.col("weight") + noise).alias("score")))
    entered = scored.where(F.col("n_words") >= least_words).groupBy(*names, "score").agg(F.count("*").alias("_copies"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("n_words"), F.col("weight")]
    spark = weighed.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(entered.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    before, n = [], 0
    # One row per range.
    for r in sorted(ranged.groupBy("_range").agg(F.sum("_copies").alias("n")).collect()):
        before.append((r["_range"], n))
        n += r["n"]
    most = share[0] * n // share[1]
    so_far = F.sum("_copies").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    ranked = (
        ranged.join(F.broadcast(spark.createDataFrame(before, "_range int, _before long")), "_range")
        .withColumn("_first", F.col("_before") + so_far - F.col("_copies"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
        .withColumn("rank", F.col("_first") + F.col("_copy"))
    )
    ranked = ranked.select(*names, "score", F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    rest = scored.where(F.col("n_words") < least_words)
    return ranked.unionByName(rest.select(*names, "score", F.lit(None).cast("long").alias("rank")))
