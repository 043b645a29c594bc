"""Hard negatives by Kronecker-packed inner products.

The k-th components of some thousand candidates, biased so that none is negative, stand side by side in fields of one wide
integer. One multiplication by an anchor's (equally biased) k-th component multiplies all of them at once; the sum over k
holds every candidate's inner product in its field, because fields are as wide as the largest possible sum. Taking the
biases off leaves the exact scores.

Anchors are a stated query set. They are written to the shared folder; each task holds one block of candidates and streams
the anchors past it, a few at a time, so neither side is shuffled or held whole. Each pair is scored once: those of one
label to find an anchor's positives, the others, when the positives' scores are known, for the negatives.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofgrid.session import cut_lineage, shared_folder

#: Vectors are scored as floor(SCALE * x).
SCALE = 256
#: Candidates in one wide integer, components in one block of candidates, anchors read at a time.
PACK = 1024
BLOCK_VALUES = 1 << 22
ANCHOR_ROWS = 512
#: Products of two components that one task is to form.
TASK_PRODUCTS = 2e10
#: Scores end here on either side, so that a hundred times a score is still a long.
LARGEST = 1 << 56


@dataclass(frozen=True)
class Fields:
    """How vectors of `size` components, none above `bias` in magnitude, are packed."""

    size: int
    bias: int

    @property
    def width(self) -> int:
        """Bytes of a field: the largest sum of products must fit."""
        most = self.size * (2 * self.bias) ** 2
        return 4 if most < 1 << 32 else 8 if most < 1 << 62 else math.ceil(most.bit_length() / 8)

    def pack(self, column: np.ndarray) -> int:
        """One component of many candidates as a wide integer."""
        width = self.width
        if width > 8:
            return int.from_bytes(b"".join((int(x) + self.bias).to_bytes(width, "little") for x in column), "little")
        return int.from_bytes((column + self.bias).astype(f"<u{width}").tobytes(), "little")

    def unpack(self, product: int, count: int) -> np.ndarray:
        """The fields of a sum of products."""
        width = self.width
        data = product.to_bytes(width * count, "little")
        if width > 8:
            return np.array([int.from_bytes(data[i : i + width], "little") for i in range(0, len(data), width)], object)
        return np.frombuffer(data, f"<u{width}").astype(np.int64)


class Block:
    """Candidates in the order of label and id, packed."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, bias: int):
        order = np.lexsort((ids, labels))
        self.ids, self.labels, vectors = ids[order], labels[order], vectors[order]
        self.fields = Fields(vectors.shape[1], bias)
        #: Sums of the biased components: no longer small when the bias isn't.
        kind = np.int64 if self.fields.width <= 8 else object
        self.totals = (vectors.astype(kind) + bias).sum(axis=1) if vectors.size else np.zeros(len(ids), kind)
        self.packs = [[self.fields.pack(column) for column in vectors[i : i + PACK].T] for i in range(0, len(ids), PACK)]

    def scores(self, anchor: list[int], first: int, last: int) -> np.ndarray:
        """Inner products of the candidates of packs `first` to `last` - 1 with an anchor."""
        bias, size = self.fields.bias, self.fields.size
        raised = [x + bias for x in anchor]
        out = []
        for p in range(first, last):
            totals = self.totals[p * PACK : (p + 1) * PACK]
            fields = self.fields.unpack(sum(map(mul, self.packs[p], raised)), len(totals))
            out.append(fields - bias * totals + (size * bias * bias - bias * sum(raised)))
        found = np.concatenate(out) if out else np.zeros(0, np.int64)
        return np.clip(found, -LARGEST, LARGEST).astype(np.int64)

    def held(self, label: int) -> tuple[int, int]:
        """Where a label's candidates stand."""
        return int(np.searchsorted(self.labels, label)), int(np.searchsorted(self.labels, label, "right"))

    def alike(self, anchor: list[int], label: int, anchor_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the other candidates of a label."""
        lo, hi = self.held(label)
        first = lo // PACK
        found = self.scores(anchor, first, -(-hi // PACK) if hi > lo else first)[lo - first * PACK : hi - first * PACK]
        ids = self.ids[lo:hi]
        other = ids != anchor_id
        return ids[other], found[other]

    def unlike(self, anchor: list[int], label: int, anchor_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the candidates of all other labels."""
        lo, hi = self.held(label)
        # Packs that hold nothing but the label are left out.
        before, after = (-(-lo // PACK), hi // PACK) if hi - lo >= PACK else (len(self.packs), len(self.packs))
        after = max(before, after)
        found = np.concatenate([self.scores(anchor, 0, before), self.scores(anchor, after, len(self.packs))])
        at = np.r_[0 : min(before * PACK, len(self.ids)), min(after * PACK, len(self.ids)) : len(self.ids)]
        other = (self.labels[at] != label) & (self.ids[at] != anchor_id)
        return self.ids[at][other], found[other]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest scores as (id, score), ties by smaller id."""
    if len(ids) > 4 * k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(ids[order].tolist(), scores[order].tolist(), strict=True))


def blocks(source: Iterator[pa.RecordBatch], bias: int) -> Iterator[Block]:
    """Blocks of vectors of one size from the rows of a task."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    rows: dict[int, int] = {}

    def block(size: int) -> Block:
        rows.pop(size)
        return Block(*[np.concatenate(x) for x in zip(*held.pop(size), strict=True)], bias)

    for batch in source:
        ids, labels, vectors = (batch.column(c) for c in ("id", "label", "v"))
        ids, labels = ids.to_numpy(), labels.to_numpy()
        ends = vectors.offsets.to_numpy()
        values, sizes = vectors.values.to_numpy(), np.diff(ends)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            step = max(1, BLOCK_VALUES // max(1, size))
            for some in (at[i : i + step] for i in range(0, len(at), step)):
                components = values[ends[some][:, None] + np.arange(size)]
                held.setdefault(size, []).append((ids[some], labels[some], components))
                rows[size] = rows.get(size, 0) + len(some)
                if rows[size] * max(1, size) >= BLOCK_VALUES:
                    yield block(size)
    for size in list(held):
        yield block(size)


def anchors_at(path: str) -> Iterator[dict]:
    """The written anchors, a few at a time."""
    store, place = fs.FileSystem.from_uri(path)
    for batch in ds.dataset(place, filesystem=store, format="parquet").to_batches(batch_size=ANCHOR_ROWS, batch_readahead=1, fragment_readahead=1):
        yield from batch.to_pylist()


def _written(df: DataFrame) -> str:
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/proofgrid/negatives/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def quantised(vector: Column) -> Column:
    """floor(SCALE * x) of every component; beyond 64 bits, the nearest long but the least."""
    return F.transform(vector, lambda x: F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-(2**63) + 1)))


def _sound(vector: Column) -> Column:
    """Neither null nor with a component that is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite)


def _rows(hits: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    columns = zip(*hits, strict=True) if hits else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 10,
    band: tuple[int, int] = (30, 90),
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Every row that satisfies `is_anchor` is an anchor. Its positives are the `positives` other rows of its label with the
    highest scores; for each, the negatives are the `negatives` highest-scored rows of other labels whose score lies between
    band[0] and band[1] percent of the positive's, ends included. Ties go to the smaller id; rank counts from 1. All, where
    there are fewer; an anchor without positives, or a positive without negatives, has no row.

    Rows with a null id, a null label, a null vector or a component that is null or not finite take no part. Rows equal in
    id, label and vector count once; rows that share only the id are rows of their own, but are neither positive nor
    negative of each other. Vectors of different sizes have no score and never meet; empty vectors score 0. Scores beyond
    2**56 read as 2**56, on either side. An empty table gives an empty table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & _sound(F.col("v")))
    rows = cut_lineage(rows.withColumn("v", quantised(F.col("v"))).dropDuplicates())
    magnitude = F.greatest(-F.coalesce(F.array_min("v"), F.lit(0)), F.coalesce(F.array_max("v"), F.lit(0)))
    size = rows.agg(
        F.max(magnitude).alias("bias"), F.count("*").alias("rows"), F.count_if("anchor").alias("anchors"), F.max(F.size("v")).alias("size")
    ).first()
    bias, products = size["bias"] or 0, size["rows"] * size["anchors"] * (size["size"] or 0)
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(products / TASK_PRODUCTS))
    candidates = rows.select("id", "label", "v").repartition(tasks, "id", "label", F.xxhash64("v"))
    anchors = rows.where("anchor").select("id", "label", "v", F.xxhash64("label", "v").alias("row"))
    path = _written(anchors)

    def nearest(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(source, bias):
            hits = []
            for a in anchors_at(path):
                if len(a["v"]) == block.fields.size:
                    found = best(*block.alike(a["v"], a["label"], a["id"]), positives)
                    hits += [(a["id"], a["row"], i, s) for i, s in found]
                if len(hits) >= 10_000:
                    yield _rows(hits, ("anchor_id", "row", "id", "score"))
                    hits = []
            yield _rows(hits, ("anchor_id", "row", "id", "score"))

    order = Window.partitionBy("anchor_id", "row").orderBy(F.desc("score"), "id")
    near = candidates.mapInArrow(nearest, "anchor_id long, row long, id long, score long")
    near = cut_lineage(near.withColumn("p", F.row_number().over(order)).where(F.col("p") <= positives))
    # At most `positives` of an anchor.
    of_anchor = near.groupBy("anchor_id", "row").agg(F.collect_list(F.struct("p", "score")).alias("near"))
    paired = anchors.join(of_anchor.withColumnRenamed("anchor_id", "id"), ["id", "row"])
    with_near = _written(paired.select("id", "row", "label", "v", "near"))

    def hard(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor_id", "row", "p", "negative_id", "negative_score")
        for block in blocks(source, bias):
            hits = []
            for a in anchors_at(with_near):
                if len(a["v"]) != block.fields.size:
                    continue
                ids, scores = block.unlike(a["v"], a["label"], a["id"])
                for near in a["near"]:
                    least, most = -(-band[0] * near["score"] // 100), band[1] * near["score"] // 100
                    some = (scores >= least) & (scores <= most)
                    hits += [(a["id"], a["row"], near["p"], i, s) for i, s in best(ids[some], scores[some], negatives)]
                if len(hits) >= 10_000:
                    yield _rows(hits, names)
                    hits = []
            yield _rows(hits, names)

    order = Window.partitionBy("anchor_id", "row", "p").orderBy(F.desc("negative_score"), "negative_id")
    far = candidates.mapInArrow(hard, "anchor_id long, row long, p long, negative_id long, negative_score long")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = near.select("anchor_id", "row", F.col("p").cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(named, ["anchor_id", "row", "p"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
