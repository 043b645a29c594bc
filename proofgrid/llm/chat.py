r"""Conversations formatted by a compiled template, and read back.

The template's control strings can't come out of a text: each one's first character, and each escape character, is followed
by an escape character inside texts and roles. So no control string is left, and an escape character always keeps what
stands behind it; reading from the left and taking it off gives the text again.

Rows are dealt by conversation and sorted by turn; a conversation streams through the template turn by turn, so memory holds
one part of its text. What is formatted is read back by the same streaming.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.templates import CLOSE, OPEN, Template, TemplateError
from proofgrid.llm.texts import whole

BEGIN, END, ASK, ASKED = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (BEGIN, END, ASK, ASKED)
ESCAPE = "\\"
#: Formatted texts of more code points are divided, between the pieces of a template.
PART_CHARS = 4_000_000
#: Code points held before rows are handed on.
BATCH_CHARS = 8_000_000

TEMPLATE = """
{{- begin }}
{%- for message in messages %}
    {%- if message.role == 'assistant' %}
        {%- generation %}{{ message.text | escape }}{% endgeneration %}{{ end }}
    {%- else %}{{ ask }}{{ message.role | escape_line }}{{ '\\n' }}{{ message.text | escape }}{{ asked }}
    {%- endif %}
{%- endfor %}"""

#: An escape character and what it keeps, and a role up to its line's end.
KEPT = re.compile(r"\\(.)", re.DOTALL)
ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


class Escaping:
    """Breaks control strings inside texts, and mends them."""

    def __init__(self, controls: Iterable[str] = CONTROLS):
        controls = tuple(controls)
        starts, inside = {c[:1] for c in controls} | {ESCAPE}, "".join(c[1:] for c in controls)
        # Else one could begin in a text and end in what stands beside it, or be made by an escape.
        if any(len(c) < 2 or c[0] == ESCAPE for c in controls) or starts & set(inside) or {c[-1] for c in controls} & set("".join(c[:-1] for c in controls)):
            raise TemplateError("first and last characters of control strings stand nowhere else in them, nor does the escape character")
        parts = [re.escape(ESCAPE), *[f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in controls]]
        self.broken = re.compile("|".join(parts))

    def escape(self, text) -> str:
        return self.broken.sub(lambda m: m[0] + ESCAPE, text or "")

    def escape_line(self, text) -> str:
        """Line ends too, so that a header stays one line."""
        return self.escape(text).replace("\n", ESCAPE + "\n")


def unescape(text: str) -> str:
    return KEPT.sub(r"\1", text) if ESCAPE in text else text


def compiled(source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> Template:
    """A template that knows the control strings and has filters to keep them out of texts."""
    escaping = Escaping(controls)
    names = dict(zip(("begin", "end", "ask", "asked"), controls, strict=False))
    return Template(source, names, {"escape": escaping.escape, "escape_line": escaping.escape_line})


def parts(pieces: Iterator, longest: int) -> Iterator[tuple[str | None, list[tuple[int, int]], str | None]]:
    """Text, generated spans and error of each part of a rendered conversation."""
    held: list[str] = []
    size, spans, start = 0, [], None
    try:
        for piece in pieces:
            if piece is OPEN:
                start = size
            elif piece is CLOSE:
                spans.append((start, size))
                start = None
            elif piece:
                if size and size + len(piece) > longest:
                    yield "".join(held), [s for s in [*spans, *([(start, size)] if start is not None else [])] if s[0] < s[1]], None
                    held, size, spans, start = [], 0, [], None if start is None else 0
                held.append(piece)
                size += len(piece)
    except TemplateError as problem:
        yield None, [], str(problem)
        return
    yield "".join(held), [s for s in spans if s[0] < s[1]], None


def read(texts: Iterable[tuple[str, list[tuple[int, int]]]]) -> Iterator[tuple[str, str | None, str]]:
    """What stands in a conversation's parts, in order: ("turn", role, text) and ("loss", None, text), each unescaped."""
    rest, begun = "", False
    for text, spans in texts:
        for start, end in spans:
            yield "loss", None, unescape(text[start:end])
        rest, at = rest + text, 0
        if not begun and len(rest) >= len(BEGIN):
            if not rest.startswith(BEGIN):
                raise ValueError(f"a formatted conversation begins with {BEGIN}")
            begun, at = True, len(BEGIN)
        while begun:
            asked = rest.startswith(ASK, at)
            end = rest.find(ASKED if asked else END, at)
            if end < 0:
                break
            if asked:
                role = ROLE.match(rest, at + len(ASK))
                yield "turn", unescape(role[1]), unescape(rest[role.end() : end])
                at = end + len(ASKED)
            else:
                yield "turn", "assistant", unescape(rest[at:end])
                at = end + len(END)
        rest = rest[at:]
    if rest:
        raise ValueError("a formatted conversation ends inside a turn")


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: int = 0) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; the text stands in column `chars`."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[chars] or "") if chars else 100
        if size >= BATCH_CHARS or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _rows(source: Iterator[pa.RecordBatch], kept: dict, *names: str) -> Iterator[tuple]:
    """Rows as tuples; notes the type of the first column."""
    for batch in source:
        kept["type"] = batch.column(names[0]).type
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _of_conversation(rows: Iterator[tuple], kept: dict, schema: list[tuple[str, pa.DataType]], made) -> Iterator[pa.RecordBatch]:
    """What `made` yields for each conversation, its id in front."""
    first = next(rows, None)
    if first is None:
        return

    def again() -> Iterator[tuple]:
        yield first
        yield from rows

    found = ((conv, *row) for conv, group in groupby(again(), key=lambda r: r[0]) for row in made(group))
    chars = next((i for i, (n, _) in enumerate(schema, 1) if n == "text"), 0)
    yield from _batches(found, pa.schema([("conv_id", kept["type"]), *schema]), chars)


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
FORMATTED = [("part", pa.int32()), ("text", pa.string()), ("spans", SPANS), ("error", pa.string())]
TURNS = [("turn_no", pa.int64()), ("role", pa.string()), ("text", pa.string())]
DIGESTS = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def format_conversations(
    rows: DataFrame,
    source: str = TEMPLATE,
    controls: tuple[str, ...] = CONTROLS,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    longest: int = PART_CHARS,
) -> DataFrame:
    """conv_id, part, text, spans, error: every conversation rendered, and where its generated text stands.

    A conversation is one row (part 0) unless it has more than `longest` code points; then it is divided between pieces of
    the template, parts count from 0, and offsets count from the part's own beginning. Messages come by turn; equal turns
    by role and text; a null turn comes first. Null roles and texts are empty, rows with a null conversation id are one
    conversation, repeated rows are repeated turns. An empty table gives an empty table. Other columns are ignored.

    A template that can't be compiled raises here. One that fails on a conversation's values gives that conversation a last
    part with null text and the error. A template that reads `messages` in more than one loop holds a conversation whole.
    """
    compiled(source, controls)
    kind = rows.schema[conv_id].dataType.simpleString()
    sides = rows.select(F.col(conv_id).alias("c"), F.col(turn).alias("n"), whole(F.col(role)).alias("r"), whole(F.col(text)).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = compiled(source, controls)

        def made(group: Iterator[tuple]) -> Iterator[tuple]:
            messages = ({"role": r, "text": t} for _, r, t in group)
            for k, (piece, spans, error) in enumerate(parts(template.render(messages), longest)):
                yield k, piece, [{"start": a, "end": b} for a, b in spans], error
            # A failed template has not read all messages.
            for _ in messages:
                pass

        kept: dict = {}
        yield from _of_conversation(_rows(batches, kept, "c", "r", "t"), kept, FORMATTED, made)

    sides = sides.repartition("c").sortWithinPartitions("c", "n", "r", "t").select("c", "r", "t")
    return sides.mapInArrow(run, f"conv_id {kind}, part int, text string, spans array<struct<start: int, end: int>>, error string")


def _read_back(formatted: DataFrame, in_order: bool, schema: list[tuple[str, pa.DataType]], columns: str, made) -> DataFrame:
    rows = formatted.select("conv_id", "part", "text", "spans")
    if not in_order:
        rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of_group(group: Iterator[tuple]) -> Iterator[tuple]:
            return made((t, [(s["start"], s["end"]) for s in spans]) for _, t, spans in group if t is not None)

        kept: dict = {}
        yield from _of_conversation(_rows(batches, kept, "conv_id", "text", "spans"), kept, schema, of_group)

    return rows.mapInArrow(run, f"conv_id {kind}, {columns}")


def read_turns(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """conv_id, turn_no (from 0), role, text of every turn, as they were before they were formatted by TEMPLATE.

    `in_order` says that a conversation's parts stand together and in order, as `format_conversations` returns them, so
    that no shuffle is needed. Text that TEMPLATE can't have made raises. Parts with null text are left out.
    """

    def made(texts: Iterator[tuple]) -> Iterator[tuple]:
        return ((k, r, t) for k, (_, r, t) in enumerate(found for found in read(texts) if found[0] == "turn"))

    return _read_back(formatted, in_order, TURNS, "turn_no long, role string, text string", made)


def digests(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read from the output.

    turns_sha256 is the digest of role, line end, text, line end of each turn; the loss columns are about the text under
    the spans, unescaped, pieces joined with nothing between. The digests are fed turn by turn.
    """

    def made(texts: Iterator[tuple]) -> Iterator[tuple]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = n_loss = n_chars = 0

        def counted() -> Iterator[tuple]:
            nonlocal n_chars
            for text, spans in texts:
                n_chars += len(text)
                yield text, spans

        for kind, role, text in read(counted()):
            if kind == "turn":
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode())
            else:
                n_loss += len(text)
                loss.update(text.encode())
        yield n_turns, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars

    columns = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _read_back(formatted, in_order, DIGESTS, columns, made)
