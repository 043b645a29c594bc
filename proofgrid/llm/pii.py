"""Personal data: four rules, and a character-level bidirectional LSTM with CRF transitions.

The network learns in numpy from spans that the rules label in a bounded sample of windows, and from the same spans written
in other ways (without a plus, with other separators, with a spelled-out at sign and dots), which the rules miss. It reads all
overlapping windows of every text; spans of all windows are reconciled over the whole text. Full-width characters and digits
of other scripts read as their ASCII counterparts. Only windows whose best path marks anything get posterior probabilities.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.texts import whole
from proofgrid.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LEARNED = tuple(f"learned_{k}" for k in KINDS)
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match that begins inside a run of digits would also begin at the run, so looking behind loses none.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, STRIDE = 64, 32
#: What all windows that the rules can label hold; they are few, and the training sample is to have enough of them.
LABELLED = re.compile(r"[0-9@]")
TRAIN_DOCS = 1500
TRAIN_WINDOWS = 5000
#: The part of both samples that is left to texts and windows of any other kind.
OTHERS = 4
#: Copies of a window with spans in which one of them is rewritten.
REWRITTEN = 6
STEPS, BATCH, RATE = 350, 64, 0.01
EMBED, HIDDEN = 8, 16
#: Least mean posterior probability of a learned span's characters, and least characters.
SURE = 0.9
LEAST_CHARS = 7
STATES = 1 + len(KINDS)
VOCABULARY = 131  # padding, ASCII, other letters, anything else
BATCH_WINDOWS = 512
#: Windows of one product of `gains`, which so small stays on one thread, and products of a step.
IDLE_WINDOWS = 160
IDLE_GROUPS = 3
#: What rounding may take from a path's lead over the path without marks.
ROUNDING = 0.01
#: Windows held at a time, whatever a text's length.
STEP_WINDOWS = 16384


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the rules, by kind, then start. Time grows with the text, whatever it holds."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    digits = lambda x: "".join(c for c in x if "0" <= c <= "9")
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        if 16 <= len(d := digits(m[0])) <= 19 and _luhn(d):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _code(c: int) -> int:
    if 0xFF01 <= c <= 0xFF5E:
        return c - 0xFF01 + 0x22
    digit = unicodedata.decimal(chr(c), None)
    if digit is not None:
        return 0x31 + digit
    return VOCABULARY - 2 if chr(c).isalpha() else VOCABULARY - 1


def coded(text: str) -> np.ndarray:
    """Character codes of a text."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(x) or x.max() < 128:
        return (x + 1).astype(np.uint8)
    out = (x + 1).astype(np.uint8)
    far = np.flatnonzero(x >= 128)
    kinds, which = np.unique(x[far], return_inverse=True)
    out[far] = np.array([_code(int(c)) for c in kinds], np.uint8)[which]
    return out


def window_starts(text: str) -> range:
    """Starts of the windows, on a fixed grid; every place but the first few lies in two of them."""
    # A text's last windows may reach past its end and are padded.
    return range(0, len(text), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Weights by name; both directions lie in one array."""

    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, seed: int = 11) -> Tagger:
        r = np.random.default_rng(seed)
        w = {
            "embed": r.normal(0, 0.3, (VOCABULARY, EMBED)),
            "wx": r.normal(0, EMBED**-0.5, (2, EMBED, 4 * HIDDEN)),
            "wh": r.normal(0, HIDDEN**-0.5, (2, HIDDEN, 4 * HIDDEN)),
            "b": np.zeros((2, 1, 4 * HIDDEN)),
            "out": r.normal(0, 0.2, (2 * HIDDEN, STATES)),
            "bias": np.zeros(STATES),
            "move": np.zeros((STATES, STATES)),
        }
        w["b"][:, :, HIDDEN : 2 * HIDDEN] = 1
        return cls({k: x.astype(np.float32) for k, x in w.items()})

    def logits(self, codes: np.ndarray, tape: list | None = None) -> np.ndarray:
        """(time, batch, state) from (batch, time); `tape` gets what the way back needs."""
        w, (n, steps) = self.w, codes.shape
        x = w["embed"][codes].transpose(1, 0, 2)
        both = np.stack([x, x[::-1]], 1)  # time, direction, batch, embedding
        pre = both @ w["wx"] + w["b"]
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        hs = np.empty((steps, 2, n, HIDDEN), np.float32)
        for t in range(steps):
            z = pre[t] + h @ w["wh"]
            gate = _sigmoid(z[:, :, : 3 * HIDDEN])
            i, f, o = gate[:, :, :HIDDEN], gate[:, :, HIDDEN : 2 * HIDDEN], gate[:, :, 2 * HIDDEN :]
            g = np.tanh(z[:, :, 3 * HIDDEN :])
            before, last = c, h
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            hs[t] = h
            if tape is not None:
                tape.append((i, f, o, g, before, squashed, last))
        joined = np.concatenate([hs[:, 0], hs[::-1, 1]], 2)
        if tape is not None:
            tape += [both, joined]
        return joined @ w["out"] + w["bias"]

    def chains(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums of the CRF, and each sequence's total."""
        move, steps = self.w["move"], len(logits)
        ahead, back = np.empty_like(logits), np.zeros_like(logits)
        ahead[0] = logits[0]

        def summed(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)

        for t in range(1, steps):
            ahead[t] = logits[t] + summed(ahead[t - 1][:, :, None] + move, 1)
        for t in range(steps - 2, -1, -1):
            back[t] = summed(move + (logits[t + 1] + back[t + 1])[:, None, :], 2)
        return ahead, back, summed(ahead[-1], 1)

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best states of each window and their posterior probabilities, both (batch, time)."""
        logits = self.logits(codes)
        steps, n, _ = logits.shape
        move = self.w["move"]
        best, came = logits[0], np.empty((steps, n, STATES), np.int8)
        for t in range(1, steps):
            x = best[:, :, None] + move
            came[t] = x.argmax(1)
            best = logits[t] + x.max(1)
        path = np.empty((steps, n), np.int8)
        path[-1] = best.argmax(1)
        for t in range(steps - 1, 0, -1):
            path[t - 1] = came[t][np.arange(n), path[t]]
        ahead, back, total = self.chains(logits)
        sure = np.exp(np.take_along_axis(ahead + back, path[:, :, None].astype(np.int64), 2)[:, :, 0] - total)
        return path.T, sure.T

    def _folded(self) -> np.ndarray:
        """(direction, 1, row, input) for `idle`: four gates, then what a state gives each mark over no mark.

        Inputs of a step are the embedding, half the state before, one. Signs and factors are those of 1 / (1 + exp(row)), which
        is a sigmoid, and a hyperbolic tangent as half of itself and one half.
        """
        w, both = self.w, []
        sign = np.full((4 * HIDDEN, 1), -1, np.float32)
        sign[3 * HIDDEN :] = -2
        for d in (0, 1):
            out = 2 * w["out"][d * HIDDEN : (d + 1) * HIDDEN].T
            marks = np.zeros((STATES - 1, EMBED + HIDDEN + 1), np.float32)
            marks[:, EMBED : EMBED + HIDDEN] = out[1:] - out[:1]
            both.append(np.concatenate([sign * np.concatenate([w["wx"][d], 2 * w["wh"][d], w["b"][d]]).T, marks]))
        return np.stack(both)[:, None].astype(np.float32)

    def gains(self, codes: np.ndarray) -> np.ndarray:
        """(time, mark, window): the logits of all marks less that of no mark.

        Runs over direction, group, features and windows, so that all steps are on long rows; both directions go at once. The
        product of a step also holds what the state before gives the marks.
        """
        w, (n, steps) = self.w, codes.shape
        groups = -(-n // IDLE_WINDOWS)
        lanes = np.zeros((groups * IDLE_WINDOWS, steps), codes.dtype)
        lanes[:n] = codes
        lanes = np.ascontiguousarray(lanes.reshape(groups, IDLE_WINDOWS, steps).transpose(2, 0, 1))
        x = np.ascontiguousarray(w["embed"].T)[:, lanes].transpose(1, 2, 0, 3)  # time, group, embedding, window
        weights = self._folded()
        into = np.ones((2, groups, EMBED + HIDDEN + 1, IDLE_WINDOWS), np.float32)
        h = into[:, :, EMBED : EMBED + HIDDEN]
        h[:] = 0
        z = np.empty((2, groups, 4 * HIDDEN + STATES - 1, IDLE_WINDOWS), np.float32)
        gates, marks = z[:, :, : 4 * HIDDEN], z[:, :, 4 * HIDDEN :]
        i, f, o, g = (z[:, :, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        c = np.zeros((2, groups, HIDDEN, IDLE_WINDOWS), np.float32)  # half the cell
        kept = np.empty_like(c)
        out = np.empty((steps, groups, STATES - 1, IDLE_WINDOWS), np.float32)
        out[:] = (w["bias"][1:] - w["bias"][0])[:, None]
        with np.errstate(over="ignore"):  # 1 / (1 + inf) is the limit
            for t in range(steps + 1):
                if t < steps:
                    into[0, :, :EMBED] = x[t]
                    into[1, :, :EMBED] = x[steps - 1 - t]
                np.matmul(weights, into, out=z)
                if t:
                    out[t - 1] += marks[0]
                    out[steps - t] += marks[1]
                if t == steps:
                    break
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                g -= 0.5
                c *= f
                np.multiply(i, g, out=kept)
                c += kept
                np.multiply(c, -4, out=kept)
                np.exp(kept, out=kept)
                kept += 1
                np.reciprocal(kept, out=kept)
                kept -= 0.5
                np.multiply(kept, o, out=h)
        return out.transpose(0, 2, 1, 3).reshape(steps, STATES - 1, -1)[:, :, :n]

    def idle(self, codes: np.ndarray) -> np.ndarray:
        """Whether the best path of each window marks nothing.

        A path's lead over the one without marks is at most that of two states, marked or not, with the best mark of each place and
        the best moves; only windows in which that may be positive need all states.
        """
        gains, steps = self.gains(codes), codes.shape[1]
        move = self.w["move"] - self.w["move"][0, 0]
        begin, stay, stop = move[0, 1:].max(), move[1:, 1:].max(), move[1:, 0].max()
        most = gains.max(1)
        here = most[0].copy()
        lead = here.copy()
        for t in range(1, steps):
            np.maximum(here + stay, begin, out=here)
            here += most[t]
            np.maximum(lead, here, out=lead)
        out = np.ones(len(codes), bool)
        some = np.flatnonzero(lead + max(stop, 0) > -ROUNDING)
        if len(some):
            part = np.zeros((steps, STATES, len(some)), np.float32)
            part[:, 1:] = gains[:, :, some]
            best = part[0]
            for t in range(1, steps):
                best = (best[:, None] + move[:, :, None]).max(0) + part[t]
            out[some] = best.max(0) <= 0
        return out

    def gradient(self, codes: np.ndarray, states: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of labelled windows and its slope in every weight."""
        w, tape = self.w, []
        logits = self.logits(codes, tape)
        *cells, both, joined = tape
        steps, n, _ = logits.shape
        ahead, back, total = self.chains(logits)
        y = states.T.astype(np.int64)
        at_t, at_n = np.arange(steps)[:, None], np.arange(n)[None, :]
        gold = logits[at_t, at_n, y].sum(0) + w["move"][y[:-1], y[1:]].sum(0)
        d = np.exp(ahead + back - total[:, None])
        pairs = np.exp(ahead[:-1, :, :, None] + w["move"] + (logits + back)[1:, :, None, :] - total[:, None, None]).sum((0, 1))
        np.subtract.at(pairs, (y[:-1].ravel(), y[1:].ravel()), 1)
        d[at_t, at_n, y] -= 1
        d /= n
        g = {"move": pairs / n, "out": np.tensordot(joined, d, ((0, 1), (0, 1))), "bias": d.sum((0, 1))}
        into = d @ w["out"].T
        into = np.stack([into[:, :, :HIDDEN], into[::-1, :, HIDDEN:]], 1)
        dz = np.empty((steps, 2, n, 4 * HIDDEN), np.float32)
        dh = dc = np.zeros((2, n, HIDDEN), np.float32)
        wh = np.zeros_like(w["wh"])
        for t in range(steps - 1, -1, -1):
            i, f, o, c, before, squashed, last = cells[t]
            dh = dh + into[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz[t, :, :, :HIDDEN] = dc * c * i * (1 - i)
            dz[t, :, :, HIDDEN : 2 * HIDDEN] = dc * before * f * (1 - f)
            dz[t, :, :, 2 * HIDDEN : 3 * HIDDEN] = dh * squashed * o * (1 - o)
            dz[t, :, :, 3 * HIDDEN :] = dc * i * (1 - c**2)
            wh += last.transpose(0, 2, 1) @ dz[t]
            dh, dc = dz[t] @ w["wh"].transpose(0, 2, 1), dc * f
        g["wh"], g["b"] = wh, dz.sum((0, 2))[:, None, :]
        g["wx"] = np.einsum("tdne,tdnh->deh", both, dz, optimize=True)
        dx = dz @ w["wx"].transpose(0, 2, 1)
        dx = (dx[:, 0] + dx[::-1, 1]).transpose(1, 0, 2)
        g["embed"] = np.zeros_like(w["embed"])
        np.add.at(g["embed"], codes, dx)
        return float((total - gold).mean()), g


def fit(codes: np.ndarray, states: np.ndarray, steps: int = STEPS, seed: int = 5) -> Tagger | None:
    """Train by Adam on labelled windows; without any labelled character there is nothing to learn, and no tagger."""
    if not len(codes) or not states.any():
        return None
    r, tagger = np.random.default_rng(seed), Tagger.fresh()
    m = {k: np.zeros_like(x) for k, x in tagger.w.items()}
    v = {k: np.zeros_like(x) for k, x in tagger.w.items()}
    for step in range(1, steps + 1):
        some = r.integers(0, len(codes), BATCH)
        _, g = tagger.gradient(codes[some], states[some])
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, x in g.items():
            x = x * min(1.0, 5 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            tagger.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return tagger


def rewritten(kind: int, span: str, r: np.random.Generator) -> str:
    """The same datum as people also write it."""
    if kind == 0:
        if r.random() < 0.35:
            local, _, domain = span.partition("@")
            return f"{local} at {domain.replace('.', ' dot ')}"
        sign = r.choice(["(at)", "[at]", " (at) ", " [at] "])
        return span.replace("@", sign) if r.random() < 0.7 else span.replace("@", " @ ")
    if kind == 2:
        return re.sub(r"[\x20-]", "", span) if r.random() < 0.5 else re.sub(r"[\x20-]", r.choice([".", "/", "  "]), span)
    if kind == 3:
        bare = span[1:]
        return r.choice(["00", "", "(0) ", "0"]) + re.sub(r"[\x20().-]+", r.choice([" ", "-", ".", "/", ""]), bare)
    return span


def labelled(text: str, lead: int, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """A window's codes and states from `lead` on."""
    codes, states = np.zeros(WINDOW, np.uint8), np.zeros(WINDOW, np.int8)
    part = coded(text[lead : lead + WINDOW])
    codes[: len(part)] = part
    for kind, i, j in spans:
        states[max(i - lead, 0) : max(min(j - lead, WINDOW), 0)] = kind + 1
    return codes, states


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Tagger | None:
    """A tagger from at most TRAIN_WINDOWS windows of at most TRAIN_DOCS texts, those that hash lowest."""
    # Only keys are ordered; all samples are bounded by their parameters.
    known = docs.select(whole(F.col(text)).alias("t"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_k"))
    # Kept, as both orders and both samples would read all texts again.
    keys = cut_lineage(known.select("_k", F.col("t").rlike(LABELLED.pattern).alias("_l")).distinct())
    ids = keys.where("_l").orderBy("_k").limit(TRAIN_DOCS - TRAIN_DOCS // OTHERS).union(keys.where("not _l").orderBy("_k").limit(TRAIN_DOCS // OTHERS))
    rows = cut_lineage(known.join(F.broadcast(ids.select("_k")), "_k").dropDuplicates(["_k"]))

    def windows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            out = []
            for k, t in zip(batch.column("_k").to_pylist(), batch.column("t").to_pylist(), strict=True):
                spans = rule_spans(t)
                for start in window_starts(t):
                    # Twice the window, so that rewritten spans have context on both sides.
                    lead, tail = max(start - STRIDE, 0), start + WINDOW + STRIDE
                    near = [(s[0], s[1] - lead, s[2] - lead) for s in spans if s[1] >= lead and s[2] <= tail]
                    if len(near) == sum(s[1] < tail and s[2] > lead for s in spans):
                        out.append({"k": k, "start": start, "lead": lead, "labelled": bool(LABELLED.search(t, start, start + WINDOW)), "text": t[lead:tail], "spans": [x for s in near for x in s]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("k", pa.int64()), ("start", pa.int64()), ("lead", pa.int64()), ("labelled", pa.bool_()), ("text", pa.string()), ("spans", pa.list_(pa.int64()))]))

    made = rows.select("_k", "t").mapInArrow(windows, "k long, start long, lead long, labelled boolean, text string, spans array<long>")
    found = []
    for some, most in ((F.col("labelled"), TRAIN_WINDOWS - TRAIN_WINDOWS // OTHERS), (~F.col("labelled"), TRAIN_WINDOWS // OTHERS)):
        found += made.where(some).orderBy(F.xxhash64("k", "start"), "k", "start").limit(most).collect()
    r, codes, states = np.random.default_rng(3), [], []
    for row in found:
        spans = [tuple(row["spans"][i : i + 3]) for i in range(0, len(row["spans"]), 3)]
        for x in range(1 + REWRITTEN if spans else 1):
            t, marks = row["text"], spans
            if x:
                kind, i, j = spans[r.integers(len(spans))]
                new = rewritten(kind, t[i:j], r)
                t = t[:i] + new + t[j:]
                grown = len(new) - (j - i)
                marks = [(k, a + grown * (a >= j), b + grown * (b > i)) for k, a, b in spans if a >= j or b <= i or (a, b) == (i, j)]
            c, s = labelled(t, row["start"] - row["lead"], marks)
            codes.append(c)
            states.append(s)
    return fit(np.array(codes), np.array(states)) if codes else None


def learned_spans(texts: list[str], tagger: Tagger | None) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of each text from all its windows.

    A span that a window's edge cuts counts only together with what the next window sees of it: overlapping spans of one kind
    become one; where kinds disagree, the surer and then the longer one stays.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if tagger is None:
        return out
    found: dict[int, list[tuple[int, int, int, float]]] = {}
    held: list[tuple[int, int, np.ndarray]] = []  # text, first start, codes
    size = 0

    def read() -> None:
        codes = np.concatenate([c for _, _, c in held])
        doc = np.repeat([d for d, _, _ in held], [len(c) for _, _, c in held])
        start = np.concatenate([s + STRIDE * np.arange(len(c)) for _, s, c in held])
        _, first, which = np.unique(codes.view(f"V{WINDOW}").ravel(), return_index=True, return_inverse=True)
        unique, per = codes[first], IDLE_GROUPS * IDLE_WINDOWS
        busy = np.flatnonzero(~np.concatenate([tagger.idle(unique[i : i + per]) for i in range(0, len(unique), per)]))
        place = np.full(len(unique), -1)
        place[busy] = np.arange(len(busy))
        paths = [tagger.decode(unique[busy[i : i + BATCH_WINDOWS]]) for i in range(0, len(busy), BATCH_WINDOWS)]
        if not paths:
            return
        path, sure = (np.concatenate(x) for x in zip(*paths, strict=True))
        for job in np.flatnonzero(place[which] >= 0):
            d, s, u = int(doc[job]), int(start[job]), place[which[job]]
            p = path[u]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], p, [0]])))
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if p[i]:
                    found.setdefault(d, []).append((s + int(i), min(s + int(j), len(texts[d])), int(p[i]) - 1, float(sure[u, i:j].mean())))

    for d, t in enumerate(texts):
        for lead in range(0, len(t), STEP_WINDOWS * STRIDE):
            part = coded(t[lead : lead + STEP_WINDOWS * STRIDE + WINDOW - STRIDE])
            n = min(STEP_WINDOWS, -(-(len(t) - lead) // STRIDE))
            padded = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
            padded[: len(part)] = part[: len(padded)]
            held.append((d, lead, np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE])))
            size += n
            if size >= STEP_WINDOWS:
                read()
                held, size = [], 0
    if held:
        read()
    for d, spans in found.items():
        merged: list[list] = []
        for i, j, kind, score in sorted(spans):
            last = next((m for m in reversed(merged) if m[2] == kind and m[1] > i), None)
            if last:
                last[1], last[3] = max(last[1], j), max(last[3], score)
            else:
                merged.append([i, j, kind, score])
        taken: list[tuple[int, int, int]] = []
        for i, j, kind, _ in sorted((m for m in merged if m[3] >= SURE and m[1] - m[0] >= LEAST_CHARS), key=lambda m: (-m[3], m[0] - m[1], m[0])):
            if all(j <= a or i >= b for _, a, b in taken):
                taken.append((kind, i, j))
        out[d] = sorted(taken)
    return out


def trimmed(text: str, i: int, j: int) -> tuple[int, int]:
    """Without blanks and closing punctuation at the ends."""
    while j > i and (text[j - 1].isspace() or text[j - 1] in ".,;:"):
        j -= 1
    while i < j and text[i].isspace():
        i += 1
    return i, j


def find_personal_data(docs: DataFrame, tagger: Tagger | None, text: str = "text", out: str = "personal") -> DataFrame:
    """All rows and columns with `out`, an array of (rank, start, end, kind) by kind, then start.

    Rules come first (email, ip, card, phone); learned spans overlap none of them. Offsets count code points, ends are
    exclusive. Null and empty texts have no spans. Rows don't depend on each other. A column named `out` is replaced.
    """
    rest = [c for c in docs.columns if c != out]
    kind = "array<struct<rank: int, start: int, end: int, kind: string>>"
    schema = docs.select(rest).selectExpr("*", f"cast(null as {kind}) as `{out}`").schema
    arrow = pa.list_(pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
    names = KINDS + LEARNED

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [t or "" for t in batch.column(text).to_pylist()]
            made = []
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                for t, learned in zip(part, learned_spans(part, tagger), strict=True):
                    spans = rule_spans(t)
                    for k, a, b in learned:
                        a, b = trimmed(t, a, b)
                        if b - a >= LEAST_CHARS and all(b <= x or a >= y for _, x, y in spans if _ < len(KINDS)):
                            spans.append((k + len(KINDS), a, b))
                    made.append([{"rank": k, "start": a, "end": b, "kind": names[k]} for k, a, b in sorted(spans)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(made, arrow)], names=[*rest, out])

    return docs.select(rest).mapInArrow(batches, schema)
