"""Quality rules: counts that fail a text outright, and a calibrated classifier for the rest.

Logistic regression over hashed words and character trigrams is trained on a bounded sample of labelled rows
(`TRAIN_ROWS`), calibrated on held-out rows of that sample, and scores every whole text in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAIN_ROWS = 3000
BITS = 16
KEEP_AT = 0.5
LEAST_WORDS = 50
MOST_REPEATED = 50
CHUNK_BYTES = 1 << 20

_byte = np.arange(256)
SPACE = np.isin(_byte, [32, 9, 10, 11, 12, 13])
SYMBOL = np.isin(_byte, [*b"#*$%&|<>"])
LEAD = (_byte & 0xC0) != 0x80
LOWERED = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint32)
_odd = np.random.default_rng(7).integers(1, 2**31, 256, dtype=np.uint32) | 1
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of about CHUNK_BYTES together, at least one text each."""
    out, size = [], 0
    for t in texts:
        if out and size + len(t) > CHUNK_BYTES:
            yield out
            out, size = [], 0
        out.append(t)
        size += len(t)
    if out:
        yield out


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of `values` that end at `ends`."""
    run = np.concatenate([[0], np.cumsum(values)])
    return np.diff(run[np.concatenate([[0], ends])])


@dataclass
class Features:
    """Hashed features of some texts: the words, then the trigrams; `ends` say where each text's part ends."""

    words: np.ndarray
    word_ends: np.ndarray
    grams: np.ndarray
    gram_ends: np.ndarray


def features(data: np.ndarray, ends: np.ndarray) -> Features:
    """Of texts laid end to end, each closed by one line feed."""
    low, space = LOWERED[data], SPACE[data]
    first = ~space & np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(first)
    spelled = np.where(space, np.uint32(0), (low + 1) * _odd[low])
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    spelled *= _odd[place & 255]
    words = np.add.reduceat(spelled, starts, dtype=np.uint32) if len(starts) else np.zeros(0, np.uint32)
    words = (words * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    grams = ((low[:-2] * np.uint32(73244475) + low[1:-1]) * np.uint32(1103515245) + low[2:]) * np.uint32(2654435761) >> np.uint32(32 - BITS)
    # Trigrams that begin in a text's last two bytes (its line feed and the byte before) would reach into the next.
    whole = np.ones(len(grams), bool)
    for back in (1, 2):
        at = ends - back
        whole[at[(at >= 0) & (at < len(whole))]] = False
    return Features(words, np.searchsorted(starts, ends), grams[whole], np.concatenate([[0], np.cumsum(whole)])[np.minimum(ends, len(whole))])


def laid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    return data, np.cumsum([len(t) + 1 for t in texts])


def counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The rule counts of some texts."""
    data, ends = laid(texts)
    space = SPACE[data]
    words = b"\n".join(texts).split()
    n_words = _sums(~space & np.concatenate([[True], space[:-1]]), ends)
    ids, _ = pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), None)
    doc = np.repeat(np.arange(len(texts)), n_words)
    covered = np.zeros(len(words), bool)
    if len(words) > 3:
        k = int(ids.max()) + 1
        pair, _ = pd.factorize(ids[:-2] * k + ids[1:-1])
        triple, _ = pd.factorize(pair * k + ids[2:])
        here = np.flatnonzero(doc[:-2] == doc[2:])
        window, _ = pd.factorize(triple[here] * len(texts) + doc[here])
        twice = here[np.bincount(window)[window] > 1] if len(here) else here
        for step in (0, 1, 2):
            covered[twice + step] = True
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.split(None, 1)] if b"\n" in t else []
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": n_words,
        "word_chars": _sums(~space & LEAD[data], ends),
        "n_symbols": _sums(SYMBOL[data], ends),
        "n_dup_lines": np.array(dup),
        "n_repeat_words": np.bincount(doc[covered], minlength=len(texts)),
    }


@dataclass
class Model:
    """Weights of words and trigrams, bias, and the calibration slope and offset on the raw score."""

    words: np.ndarray
    grams: np.ndarray
    bias: float
    slope: float
    offset: float

    def raw(self, f: Features) -> np.ndarray:
        mean = lambda w, x, e: _sums(w[x], e) / np.maximum(np.diff(np.concatenate([[0], e])), 1)
        return self.bias + mean(self.words, f.words, f.word_ends) + mean(self.grams, f.grams, f.gram_ends)

    def probability(self, f: Features) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(f) + self.offset)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _descend(value_and_slope, w: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Minimise a smooth convex function by limited-memory quasi-Newton steps with backtracking."""
    f, g = value_and_slope(w)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, y, r in reversed(pairs):
            a = r * s.dot(d)
            kept.append(a)
            d -= a * y
        if pairs:
            s, y, _r = pairs[-1]
            d *= s.dot(y) / y.dot(y)
        for (s, y, r), a in zip(pairs, reversed(kept), strict=True):
            d += s * (a - r * y.dot(d))
        step, fall = 1.0, g.dot(d)
        while True:
            f2, g2 = value_and_slope(w - step * d)
            if f2 <= f - 1e-4 * step * fall or step < 1e-8:
                break
            step /= 2
        s, y = -step * d, g2 - g
        if s.dot(y) > 1e-12:
            pairs = [*pairs, (s, y, 1 / s.dot(y))][-memory:]
        done = f - f2 < 1e-7 * abs(f)
        w, f, g = w + s, f2, g2
        if done:
            break
    return w


def fit(texts: list[bytes], labels: np.ndarray, steps: int = 100, scale: float = 30.0, decay: float = 3e-4) -> Model:
    """Quasi-Newton descent on four fifths of the rows, calibration (Platt scaling) on the rest.

    Without rows of both classes there is nothing to learn and every text gets probability 1.
    """
    width = 1 << BITS
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(width), np.zeros(width), 0.0, 0.0, 30.0)
    n = len(texts)
    held = np.arange(n) % 5 == 4
    if len(set(labels[held].tolist())) < 2 or len(set(labels[~held].tolist())) < 2:
        held[:] = False
    index, value, row = [], [], []
    for i, t in enumerate(texts):
        f = features(*laid([t]))
        for shift, x in ((0, f.words), (width, f.grams)):
            u, c = np.unique(x, return_counts=True)
            index.append(u.astype(np.int32) + shift)
            value.append((c * (scale / max(len(x), 1))).astype(np.float32))
            row.append(np.full(len(u), i, np.int32))
    index, value, row = map(np.concatenate, (index, value, row))
    use = ~held
    share = labels[use].mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) * use / use.sum()
    sign = 2.0 * labels - 1

    def raw(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, value * w[index], minlength=n) + w[-1]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = raw(w)
        err = (_sigmoid(z) - labels) * weight
        g = np.append(np.bincount(index, value * err[row], minlength=2 * width), err.sum())
        g[:-1] += decay * w[:-1]
        return float((weight * np.logaddexp(0, -sign * z)).sum() + decay / 2 * w[:-1].dot(w[:-1])), g

    w = _descend(loss, np.zeros(2 * width + 1), steps)
    test = held if held.any() else use
    z, y = raw(w)[test], labels[test]
    up, down = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))

    def platt(x: np.ndarray) -> tuple[float, np.ndarray]:
        q = x[0] * z + x[1]
        d = _sigmoid(q) - goal
        return float((np.logaddexp(0, q) - goal * q).sum()), np.array([d.dot(z), d.sum()])

    slope, offset = _descend(platt, np.array([1.0, 0.0]), 50)
    return Model(w[:width] * scale, w[width:-1] * scale, float(w[-1]), float(slope), float(offset))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = TRAIN_ROWS) -> Model:
    """Fit on at most `most` labelled rows, those whose ids hash lowest; rows without id or label don't count."""
    ids = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label")).dropna().dropDuplicates(["_id"])
    # Bounded by `most`.
    ids = ids.orderBy(F.xxhash64("_id"), "_id").limit(most)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(ids), "_id")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_text").limit(most).select("_text", "_label").collect()
    return fit([(r[0] or "").encode() for r in rows], np.array([int(r[1] > 0) for r in rows]))


def judge(docs: DataFrame, model: Model, text: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """All rows and columns with the five counts, base_failed, p_quality and kept.

    Words are maximal runs of anything but ASCII white space. A null or empty text has no words and fails. Columns of the
    same names are replaced. Rows don't depend on each other.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "p_quality"]
    rest = [c for c in docs.columns if c not in (*made, "base_failed", "kept")]
    schema = docs.select(rest).schema
    for c in made[:-1]:
        schema = schema.add(c, "long")
    schema = schema.add("p_quality", "double")

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found: dict[str, list[np.ndarray]] = {c: [] for c in made}
            for part in chunks([(t or "").encode() for t in batch.column(text).to_pylist()]):
                for c, x in counts(part).items():
                    found[c].append(x)
                found["p_quality"].append(model.probability(features(*laid(part))))
            made_columns = [pa.array(np.concatenate(x) if x else [], pa.float64() if c == "p_quality" else pa.int64()) for c, x in found.items()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *made_columns], names=[*rest, *made])

    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = docs.select(rest).mapInArrow(batches, schema)
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= keep_at))
