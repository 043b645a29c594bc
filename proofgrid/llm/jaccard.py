"""Jaccard join on word shingles by T-occurrence search.

Equal shingle sets become one class. An inverted index, dealt out by shingle hash, tells how many classes hold each
shingle; a class can only be similar to another if enough of its shingles are held elsewhere (the T-occurrence bound), and
the rest of the work is on those classes alone. Each one's shortest inverted lists are merged for candidates, so many of
them that any partner must appear in one; its long lists are never merged but probed by binary search in
the candidate's shingles (DivideSkip), until the overlap decides.

Pairs inside a large group are not all made: members are first checked against one member of their lists, the one whose
shingles the most others hold. What connected components leave apart meets by list and size, inside the length and
positional bounds, and is checked pair by pair.

Shingles are 64-bit hashes; a class goes by the first 64 bits of the digest of its set.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.components import components
from proofgrid.llm.texts import whole
from proofgrid.session import cut_lineage, dealt_out

SHINGLE = 5
#: Similar: PERCENT of the union is shared.
PERCENT = 80
#: Postings per bucket of the inverted index; the number of buckets follows the input.
BUCKET_POSTINGS = 1_500_000
#: Postings that a map task gathers before it hands them out, and texts per step.
BATCH_POSTINGS = 2_000_000
BATCH_TEXTS = 60_000
STEP_BYTES = 1 << 20
KEY_BITS = 40
LOW_BITS, LOW = np.uint64(32), np.uint64(2**32 - 1)
#: Rounds in which list members are checked against one of them, and the mean list length from which pairs are cheaper.
STAR_ROUNDS = 4
SMALL_LISTS = 8
#: Ratio of the sizes that fall into one bin when pairs are made.
BIN_RATIO = 1.02
LAST_ID = 2**63 - 1
ENTRY = np.dtype([("key", "<u8"), ("df", "<u4")])

_factor = np.random.default_rng(5).integers(1, 2**63, SHINGLE, dtype=np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than a shingle are one shingle, no words are none."""
    words = [t.lower().split() for t in texts]  # bytes: lowers A-Z and splits at ASCII white space only
    flat = np.empty(sum(map(len, words)), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    hashed = pd.util.hash_array(flat, categorize=False) if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    for w in words:
        h, at = hashed[at : at + len(w)], at + len(w)
        size = min(len(w), SHINGLE)
        if not size:
            out.append(h)
            continue
        x = np.full(len(h) - size + 1, size, np.uint64)
        for j in range(size):
            x += h[j : len(h) - size + 1 + j] * _factor[j]
        out.append(np.unique(_mixed(x)))
    return out


def _steps(texts: list[str | None]) -> Iterator[list[np.ndarray]]:
    part, size = [], 0
    for t in texts:
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= STEP_BYTES:
            yield shingle_sets(part)
            part, size = [], 0
    if part:
        yield shingle_sets(part)


def _ref(found: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def shingled(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, th, n, ref) of every row; ref is null for a set without shingles."""
    clean = whole(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(clean).alias("th"), clean.alias("t"))

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            sizes, refs = [], []
            for found in chain.from_iterable(_steps(batch.column("t").to_pylist())):
                sizes.append(len(found))
                refs.append(_ref(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(sizes, pa.int64()), pa.array(refs, pa.int64())], names=["doc_id", "th", "n", "ref"]
            )

    return rows.mapInArrow(batches, "doc_id long, th long, n long, ref long")


def _planes(x: np.ndarray, width: int) -> bytes:
    """Numbers as byte planes, which compress well where high bytes are alike."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _numbers(data: memoryview, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def _packed(refs: list[int], sets: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row for each bucket: what the bucket leaves open of the sorted keys, as gaps, their texts, and the texts' references.

    The bucket is the remainder of the key's upper half; its quotient and the lower half in one number have gaps that don't
    grow with the number of buckets.
    """
    key = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint32), [len(s) for s in sets])
    quotient, bucket = np.divmod(key >> LOW_BITS, np.uint64(buckets))
    bucket = bucket.astype(np.int64)
    left = quotient << LOW_BITS | key & LOW
    order = np.lexsort((left, bucket))
    bucket, left, doc = bucket[order], left[order], doc[order]
    names = np.array(refs, np.int64)
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    which, data = [], []
    for b in range(buckets):
        i, j = ends[b], ends[b + 1]
        if i == j:
            continue
        here, local = np.unique(doc[i:j], return_inverse=True)
        gaps = np.diff(left[i:j], prepend=np.uint64(0))
        head = np.array([j - i, len(here), b, buckets], "<u4").tobytes()
        which.append(b)
        data.append(head + _planes(gaps, 8) + _planes(local, 2) + names[here].astype("<i8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])


def _whole_keys(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The keys and their texts' references."""
    n, m, b, buckets = (int(x) for x in np.frombuffer(data, "<u4", 4))
    view = memoryview(data)
    left = np.cumsum(_numbers(view[16:], n, 8), dtype=np.uint64)
    names = np.frombuffer(view, "<i8", m, 16 + 10 * n)
    key = ((left >> LOW_BITS) * np.uint64(buckets) + np.uint64(b)) << LOW_BITS | left & LOW
    return key, names[_numbers(view[16 + 8 * n :], n, 2).astype(np.int64)]


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Like `_whole_keys`, with the low bits of the keys."""
    key, refs = _whole_keys(data)
    return key & np.uint64((1 << KEY_BITS) - 1), refs


def _shared(table: pa.Table, slots: int) -> pa.Table:
    """Of one bucket: for each text, its keys that other texts hold too, with the number of texts. Texts are dealt to slots
    by their reference; a slot's share is one row: the references, how many keys each has, and the keys."""
    parts = [_whole_keys(x.as_buffer().to_pybytes()) for x in table.column("data")]
    key, ref = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(key, kind="stable")
    key, ref = key[order], ref[order]
    same = key[1:] == key[:-1]
    several = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    key, ref = key[several], ref[several]
    order = np.lexsort((ref, key))
    key, ref = key[order], ref[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    once = new_key | np.concatenate([[True], ref[1:] != ref[:-1]])[: len(key)]  # copies in several batches count once
    key, ref = key[once], ref[once]
    _, index, df = np.unique(key, return_inverse=True, return_counts=True)
    df = df[index]
    keep = df > 1
    entries = np.zeros(int(keep.sum()), ENTRY)
    entries["key"] = key[keep]
    entries["df"] = df[keep]
    ref = ref[keep]
    slot = ref % slots
    order = np.lexsort((ref, slot))
    entries, ref, slot = entries[order], ref[order], slot[order]
    which, starts = np.unique(slot, return_index=True)
    data = []
    for i, j in zip(starts, np.append(starts, len(ref))[1:], strict=True):
        names, counts = np.unique(ref[i:j], return_counts=True)
        data.append(np.array([len(names)], "<u4").tobytes() + names.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + entries[i:j].tobytes())
    return pa.table({"slot": pa.array(which, pa.int32()), "data": pa.array(data, pa.binary())})


def _near(table: pa.Table, classes: pa.Table) -> pa.Table:
    """Of one slot: every text with all its keys that others hold, if those are enough for a partner to exist."""
    refs, entries = [np.zeros(0, np.int64)], [np.zeros(0, ENTRY)]
    for row in table.column("data"):
        data = row.as_buffer()
        m = int(np.frombuffer(data, "<u4", 1)[0])
        counts = np.frombuffer(data, "<u4", m, 4 + 8 * m)
        refs.append(np.repeat(np.frombuffer(data, "<i8", m, 4), counts))
        entries.append(np.frombuffer(data, ENTRY, offset=4 + 12 * m))
    ref, entry = np.concatenate(refs), np.concatenate(entries)
    order = np.argsort(ref, kind="stable")
    ref, entry = ref[order], entry[order]
    names, held = np.unique(ref, return_counts=True)
    known, first = np.unique(classes.column("ref").to_numpy(), return_index=True)
    n = classes.column("n").to_numpy()[first][np.searchsorted(known, names)]
    # T-occurrence: without so many shingles held elsewhere no partner can exist.
    enough = 100 * held >= PERCENT * n
    entry = entry[np.repeat(enough, held)]
    ends = np.append(0, np.cumsum(held[enough]))
    buffers = [None, pa.py_buffer((ends * ENTRY.itemsize).astype(np.int32).tobytes()), pa.py_buffer(entry.tobytes())]
    return pa.table({"ref": pa.array(names[enough], pa.int64()), "n": pa.array(n[enough], pa.int64()), "keys": pa.Array.from_buffers(pa.binary(), int(enough.sum()), buffers)})


def _held(keys: pa.Scalar) -> np.ndarray:
    return np.frombuffer(keys.as_buffer(), ENTRY)


def short_lists(n: int, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys whose lists must be merged, and how many of the text's keys are left from each one on.

    Rarest first, as many as leave fewer than the needed overlap; keys that nobody else holds come before all others and
    need no list.
    """
    need = -(-PERCENT * n // 100)
    alone = n - len(held)
    take = max(n - need + 1 - alone, 0)
    order = np.lexsort((held["key"], held["df"]))[:take]
    return held["key"][order], n - alone - np.arange(len(order))


def overlap_reaches(n: int, m: int, mine: np.ndarray, theirs: np.ndarray) -> bool:
    """Whether the shared keys make PERCENT of the union; short lists first, then long ones, by binary search."""
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    keys = np.sort(theirs["key"])
    if len(mine) < need or len(keys) < need:
        return False
    order = np.argsort(mine["df"], kind="stable")
    short = len(mine) - need + 1

    def probe(part: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(keys, part), len(keys) - 1)
        return int((keys[at] == part).sum())

    got = probe(mine["key"][order[:short]])
    if not got:  # the long lists alone are one too few
        return False
    got += probe(mine["key"][order[short:]])
    return 100 * got >= PERCENT * (n + m - got)


def _short_lists(classes: DataFrame) -> DataFrame:
    """(ref, n, mass, lists) of every class: its short lists as (key, rest). `rest` counts its keys from this one on, `mass`
    is the mean number of classes that hold its keys."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                n = part.column("n").to_numpy(zero_copy_only=False)
                held = [_held(p) for p in part.column("keys")]
                found = [short_lists(int(k), h) for k, h in zip(n, held, strict=True)]
                ends = np.cumsum([0, *(len(keys) for keys, _ in found)], dtype=np.int32)
                mass = np.array([float(h["df"].sum()) for h in held]) / n
                lists = pa.StructArray.from_arrays(
                    [
                        pa.array(np.concatenate([keys for keys, _ in found]).astype(np.int64), pa.int64()),
                        pa.array(np.concatenate([rest for _, rest in found]).astype(np.int64), pa.int64()),
                    ],
                    names=["key", "rest"],
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("ref"), part.column("n"), pa.array(mass, pa.float64()), pa.ListArray.from_arrays(pa.array(ends), lists)],
                    names=["ref", "n", "mass", "lists"],
                )

    return classes.select("ref", "n", "keys").mapInArrow(batches, "ref long, n long, mass double, lists array<struct<key long, rest long>>")


def _verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, d) of those of the pairs (a, b, c, d) in which a and b are similar."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            good = [
                overlap_reaches(n, m, _held(p), _held(q))
                for n, m, p, q in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist(), batch.column("p"), batch.column("q"), strict=True)
            ]
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("c").filter(mask), batch.column("d").filter(mask)], names=["c", "d"])

    mine = classes.select(F.col("ref").alias("a"), "n", F.col("keys").alias("p"))
    theirs = classes.select(F.col("ref").alias("b"), F.col("n").alias("m"), F.col("keys").alias("q"))
    return pairs.select("a", "b", "c", "d").join(mine, "a").join(theirs, "b").drop("a", "b").mapInArrow(batches, "c long, d long")


def _joined(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels (ref, c) after links between them (c, d) are known; what has no label is its own."""
    merged = components(found.select(F.col("c").alias("a"), F.col("d").alias("b")))
    if labels is None:
        return merged.select(F.col("a").alias("ref"), F.col("b").alias("c"))
    moved = labels.join(merged.select(F.col("a").alias("c"), F.col("b").alias("to")), "c", "left").select("ref", F.coalesce("to", "c").alias("c"))
    fresh = merged.select(F.col("a").alias("ref"), F.col("b").alias("c")).join(labels.select("ref"), "ref", "left_anti")
    return cut_lineage(moved.union(fresh))


def class_labels(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(ref, c): the least reference of each linked class's component; the least itself and classes without links have no
    row. `rows` is `shingled(docs)`."""
    classes = rows.where("ref is not null").groupBy("ref").agg(F.first("n").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-total // BUCKET_POSTINGS))

    def index(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        size = 0
        for batch in source:
            for found in chain.from_iterable(_steps(batch.column("t").to_pylist())):
                if not len(found) or (ref := _ref(found)) in seen:
                    continue
                seen[ref] = found
                size += len(found)
                if size >= BATCH_POSTINGS or len(seen) >= BATCH_TEXTS:
                    yield _packed([*seen], [*seen.values()], buckets)
                    seen, size = {}, 0
        if seen:
            yield _packed([*seen], [*seen.values()], buckets)

    packed = docs.select(whole(F.col(text)).alias("t")).mapInArrow(index, "bucket int, data binary")
    shared = packed.groupBy("bucket").applyInArrow(lambda table: _shared(table, buckets), "slot int, data binary")
    sized = classes.withColumn("slot", F.pmod("ref", F.lit(buckets)).cast("int"))
    near = shared.groupBy("slot").cogroup(sized.groupBy("slot")).applyInArrow(_near, "ref long, n long, keys binary")
    # Pairs come to these lists, which are long, in every round.
    near = dealt_out(near, "ref", buckets)
    short = _short_lists(near)
    # Length bound, and positional bound: no key before the first common one is common, so from it on both texts must have
    # as many keys as the overlap of a pair of their sizes needs.
    fits = (100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")) & (F.col("c") != F.col("d"))
    fits &= (100 + PERCENT) * F.least("rest", "s") >= PERCENT * (F.col("n") + F.col("m"))
    labels: DataFrame | None = None
    for turn in range(STAR_ROUNDS):
        # Labels come to the classes, one row each, before their lists are dealt out.
        owned = short.withColumn("c", F.col("ref")) if labels is None else short.join(labels, "ref", "left").withColumn("c", F.coalesce("c", "ref"))
        # Dealt by key once: what is found of a list meets its members where they are.
        named = owned.select(*[x for x in owned.columns if x != "lists"], F.inline("lists")).where("key is not null").repartition("key")
        # First the member whose keys the most others hold, as an original among its edited copies; then any.
        most = F.struct("mass", "ref") if not turn else F.xxhash64("ref", F.lit(turn))
        star = F.max_by(F.struct(F.col("ref").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("rest").alias("s")), most)
        # Members of one list that are still apart; without any, the list is done.
        apart = named.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.count("*").alias("size"), star.alias("star"))
        # Lists that are done, or that one class holds, are gone from here on.
        some = cut_lineage(named.join(apart.where("_lo < _hi").select("key", "size", "star"), "key"))
        size, squares = some.agg(F.count("*"), F.sum("size")).first()
        if not size:
            return labels if labels is not None else near.sparkSession.createDataFrame([], "ref long, c long")
        if squares <= SMALL_LISTS * size or turn == STAR_ROUNDS - 1:
            break
        short = some.groupBy("ref", "n").agg(F.collect_list(F.struct("key", "rest")).alias("lists"))
        pairs = some.select(F.col("ref").alias("a"), "n", "rest", "c", "star.*").where(fits)
        pairs = pairs.groupBy("a", "b", "c", "d").agg(F.count("*").alias("lists"))
        pairs = pairs.groupBy("a").agg(F.max_by(F.struct("b", "c", "d"), F.struct("lists", "b")).alias("p")).select("a", "p.*")
        labels = _joined(labels, _verified(pairs, near))
    return _joined(labels, _verified(cut_lineage(_candidates(some, fits)), near))


def _candidates(lists: DataFrame, fits) -> DataFrame:
    """(a, b, c, d): pairs of members of a list that may be similar, the larger one first.

    The length bound and the positional bound give each member an interval of sizes for its smaller partners; members meet
    by list and bin of sizes, so a list isn't joined with itself. Members whose key comes late in their order have little
    or nothing left of the interval.
    """
    size_bin = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(BIN_RATIO))).cast("int")
    least = F.ceil(F.col("n") * PERCENT / 100)
    most = F.least(F.col("n"), F.floor((100 + PERCENT) * F.col("rest") / PERCENT) - F.col("n"))
    larger = lists.where(least <= most).select(
        F.col("key").alias("k"), F.col("ref").alias("a"), "n", "rest", "c", F.explode(F.sequence(size_bin(least), size_bin(most))).alias("bin")
    )
    smaller = lists.select("key", size_bin(F.col("n")).alias("of"), F.col("ref").alias("b"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("rest").alias("s"))
    ordered = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b")))
    met = larger.join(smaller, (F.col("k") == F.col("key")) & (F.col("bin") == F.col("of")) & ordered & fits)
    return met.select("a", "b", "c", "d").distinct()


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, th, n_shingles, component_id) for every row of `docs`; th is a hash of the text.

    component_id is the smallest id that links reach, the row's own id for a text without words (which links with nothing).
    Null ids are never smallest; a component without ids has none. Repeated rows give repeated rows. An empty table gives an
    empty table.
    """
    rows = cut_lineage(shingled(docs, doc_id, text))
    labels = class_labels(docs, rows, text)
    least = rows.where("ref is not null").groupBy("ref").agg(F.min("doc_id").alias("lo"))
    named = cut_lineage(least.join(labels, "ref", "left").select("ref", "lo", F.coalesce("c", "ref").alias("c")))
    # Per class, its component's least id; written, so that a class with very many rows is split in the last join.
    found = named.join(cut_lineage(named.groupBy("c").agg(F.min("lo").alias("component_id"))), "c").select("ref", "component_id")
    out = rows.join(cut_lineage(found), "ref", "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("ref").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, of which each component keeps its smallest id, once; texts without words all stay.

    Among different texts of that id the one whose hash is least stays. In a component without ids the same rule picks one.
    """
    found = jaccard_components(docs, doc_id, text)
    order = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), F.col("th"))
    # Components are known by their id; those without one fall to their own hash.
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("th")).alias("th"))
    best = found.where("n_shingles > 0").groupBy(group.alias("g")).agg(F.min(order).alias("k")).select(F.col("k.id").alias("_d"), F.col("k.th").alias("_th"))
    clean = whole(F.col(text))
    keyed = docs.select("*", F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST_ID)).alias("_d"), F.xxhash64(clean).alias("_th"))
    worded = clean.rlike(r"[^\x20\x09-\x0D]")
    kept = keyed.where(worded).join(cut_lineage(best), ["_d", "_th"], "left_semi").dropDuplicates(["_d", "_th"])
    return kept.unionByName(keyed.where(~worded)).select(*docs.columns)
