"""Secret scan: three rules, and the Shannon entropy of sliding windows over candidate strings.

Everything is a column expression on the row's own text, so a scan needs no shuffle. The entropy of a window follows
from the one before by taking one character's count down and another's up; a candidate of a character class counts when its
best window reaches the class's bits. The allow-list covers whole candidates (words, paths, UUIDs, dates) or stretches of them;
a covered stretch counts as one repeated character, so it hides nothing beside it. What the rules find is blanked before candidates
are looked for, so a rule's span hides nothing beside it either.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofgrid.llm.texts import joined, whole

NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
VALUE_CHARS = 8
KINDS = ("assign", "access", "hex", "entropy")

#: Windows of this many characters; candidates are at least as long.
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{WINDOW},}}+={{0,2}}"
#: Character classes from narrow to wide: what all characters match, least bits of the best window. Nothing else decides.
CLASSES = (
    (r"[0-9+/_~-]+", 2.5),
    (r"[0-9a-f+/_~-]+|[0-9A-F+/_~-]+", 2.9),
    (r"[0-9a-z+/_~-]+|[0-9A-Z+/_~-]+", 3.5),
    (r".*", 3.7),
)
#: What words, paths of words and short numbers don't have: six consonants in a row, digits but short ones behind a word or alone,
#: letter case that changes otherwise than at the beginning of a word.
NO_WORDS = r"(?i:[bcdfghjklmnpqrstvwxz]{6})|[0-9][A-Za-z]|[A-Za-z][0-9]{3}|[0-9]{5}|[A-Z][a-z](?![a-z])|[a-z][A-Z]+(?![A-Za-z])|[A-Z]{6}[a-z]"
DATE = r"[12]\d{3}-?[01]\d-?[0-3]\d(?:[T_-]?[0-2]\d-?[0-5]\d(?:-?[0-5]\d(?:-?\d{1,9})?)?Z?)?"
#: Whole candidates that look random but are none, or are published examples.
ALLOWED = (
    r"(?i)^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$",  # UUID
    rf"^{DATE}(?:[/_-]+{DATE})?$",
    r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
)
#: Stretches of a candidate that carry no secret; a window is judged by its other characters.
PLAIN = (
    r"(?i:example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret))"
    r"|(?i:0123456789|abcdefghij|qwertyuiop)"
    r"|(.)\1{7,}"
)
#: Stands for each character of such a stretch; no candidate holds it.
MASK = "~"

#: Letters and digits of rule spans are replaced by their shadows, private-use characters that no candidate holds but that
#: the next rule still reads as what they were.
PLAIN_CHARS = string.ascii_letters + string.digits
SHADOWS = "".join(chr(0xE000 + ord(c)) for c in PLAIN_CHARS)
UPPER_SHADOWS, LOWER_SHADOWS, DIGIT_SHADOWS = (f"{chr(0xE000 + ord(a))}-{chr(0xE000 + ord(b))}" for a, b in ("AZ", "az", "09"))

#: Running values are computed in blocks of this many, and again over the blocks, LEVELS deep.
BLOCK, LEVELS = 64, 3


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value) in code points; linear regular-expression passes."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    steps = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("value")))
    return steps


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed one time, however often the body reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sums(numbers: Column, levels: int = LEVELS) -> Column:
    """Sums of all numbers up to each one. An array can't grow in place, so only blocks grow, and their sums are summed likewise."""
    grown = lambda part: F.aggregate(part, F.array(F.lit(0)), lambda run, n: F.array_append(run, F.element_at(run, -1) + n))
    whole_run = lambda part: F.slice(grown(part), 2, F.size(part))
    if levels == 0:
        return whole_run(numbers)

    def blocks(all_numbers: Column) -> Column:
        count = F.ceil(F.size(all_numbers) / BLOCK).cast("int")
        firsts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda b: grown(F.slice(all_numbers, b * BLOCK + 1, BLOCK)))

    def together(parts: Column) -> Column:
        totals = running_sums(F.transform(parts, lambda part: F.element_at(part, -1)), levels - 1)
        # A block starts at the total of the one before.
        shifted = F.zip_with(
            parts, F.concat(F.array(F.lit(0)), totals), lambda part, lead: F.transform(F.slice(part, 2, BLOCK), lambda n: n + lead)
        )
        return F.flatten(F.filter(shifted, lambda part: part.isNotNull()))

    # One block needs no other level.
    return once(numbers, lambda held: F.when(F.size(held) <= BLOCK, whole_run(held)).otherwise(once(blocks(held), together)))


def placed(steps: Column) -> Column:
    """Gaps and lengths to starts and ends."""
    ends = running_sums(F.transform(steps, lambda s: s["gap"] + s["n"]))
    return F.zip_with(steps, ends, lambda s, end: F.struct((end - s["n"]).alias("start"), end.alias("end"), s["value"].alias("value")))


def shaded(text: Column) -> Column:
    """The text with shadows for the letters and digits of rule spans: same length, and nothing of them is left to a candidate.

    A later rule must meet what an earlier one has shaded as if it were untouched, since spans of two kinds may overlap. Only
    an assignment shades other characters than letters and digits, so it comes last.
    """

    def replaced(value: Column, pattern: str, keep: Callable[[Column], Column] | None = None, rest: bool = False) -> Column:
        shade = lambda m: F.translate(m, PLAIN_CHARS + ("+/_.=-" if rest else ""), SHADOWS + (SHADOWS[0] * 6 if rest else ""))
        new = shade if keep is None else lambda m: F.when(keep(m), shade(m)).otherwise(m)
        pieces = lambda v: F.zip_with(
            F.split(v, pattern, -1), F.regexp_extract_all(v, F.lit(pattern), F.lit(0)), lambda gap, m: F.concat(gap, F.coalesce(new(m), F.lit("")))
        )
        return once(value, lambda v: F.array_join(pieces(v), ""))

    def either(chars: str) -> str:
        return "".join(f"[{''.join(x + chr(0xE000 + ord(x)) for x in (c.lower(), c.upper()))}]" if c.isalpha() else c for c in chars)

    access = "".join(f"[{c}{chr(0xE000 + ord(c))}]" for c in "AKIA") + f"[A-Z0-9{UPPER_SHADOWS}{DIGIT_SHADOWS}]{{12,}}"
    value = f"[A-Za-z0-9{UPPER_SHADOWS}{LOWER_SHADOWS}{DIGIT_SHADOWS}+/_.=-]+"
    assign = rf"""(?:{"|".join(map(either, NAMES))})["']?\x20*[:=]\x20*["']?({value})"""
    # A text that holds shadows of its own loses them: they are no part of any candidate.
    clean = F.translate(text, SHADOWS, " " * len(SHADOWS))
    long_enough = lambda m: F.length(F.regexp_extract(m, assign, 1)) >= VALUE_CHARS
    return replaced(replaced(replaced(clean, HEX), access), assign, long_enough, rest=True)


def entropy(value: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits, of any `window` consecutive ASCII characters of a text that has as many."""
    codes = F.transform(F.split(value, ""), lambda c: F.ascii(c))
    leaving = F.concat(F.array_repeat(F.lit(-1), window), codes)
    steps = F.zip_with(codes, F.slice(leaving, 1, F.size(codes)), lambda a, b: F.struct(a.alias("come"), b.alias("go")))

    def part(n: Column) -> Column:  # n log2 n
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    def slide(state: Column, step: Column) -> Column:
        same = step["come"] == step["go"]
        up = F.element_at(state["count"], step["come"] + 1)
        down = F.element_at(state["count"], F.greatest(step["go"], F.lit(0)) + 1)
        weight = (
            state["weight"]
            + F.when(same, F.lit(0.0)).otherwise(part(up + 1) - part(up))
            + F.when(same | (step["go"] < 0), F.lit(0.0)).otherwise(part(down - 1) - part(down))
        )
        count = F.when(same, state["count"]).otherwise(
            F.transform(state["count"], lambda n, i: n + (i == step["come"]).cast("int") - (i == step["go"]).cast("int"))
        )
        seen = state["seen"] + 1
        bits = F.lit(math.log2(window)) - weight / F.lit(float(window))
        return F.struct(
            count.alias("count"),
            weight.alias("weight"),
            seen.alias("seen"),
            F.when(seen >= window, F.greatest(state["best"], bits)).otherwise(state["best"]).alias("best"),
        )

    start = F.struct(
        F.array_repeat(F.lit(0), 128).alias("count"), F.lit(0.0).alias("weight"), F.lit(0).alias("seen"), F.lit(0.0).alias("best")
    )
    return F.aggregate(steps, start, slide, lambda state: state["best"])


def masked(value: Column) -> Column:
    """The text with every character of its plain stretches replaced by one and the same."""
    found = F.regexp_extract_all(value, F.lit(PLAIN), F.lit(0))
    masks = lambda m: F.repeat(F.lit(MASK), F.coalesce(F.length(m), F.lit(0)))
    pieces = F.zip_with(F.split(value, PLAIN, -1), found, lambda gap, m: F.concat(gap, masks(m)))
    return F.when(value.rlike(PLAIN), F.array_join(pieces, "")).otherwise(value)


def suspicious(value: Column) -> Column:
    """Whether a candidate's best window, without plain stretches, has its class's bits, and nothing allows the whole."""
    # One element, so that what is masked is computed once.
    judged = F.transform(F.array(masked(F.rtrim(value, F.lit("=")))), lambda rest: entropy(rest) >= least_bits(rest))
    allowed = ~value.rlike(NO_WORDS)
    for pattern in ALLOWED:
        allowed = allowed | value.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(F.element_at(judged, 1))


def least_bits(value: Column) -> Column:
    """The bits that the class of a candidate's characters asks for."""
    least = F.lit(math.inf)
    for chars, bits in reversed(CLASSES):
        least = F.when(value.rlike(f"^(?:{chars})$"), F.lit(bits)).otherwise(least)
    return least


def find_secrets(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """All rows and columns with `out`, an array of (start, rank, end, kind) ordered by start, then kind.

    Offsets count code points, ends are exclusive. Rules (assign, access, hex) are leftmost and non-overlapping per kind;
    entropy adds candidates of what the rules leave: a candidate that a rule's span cuts is judged piece by piece. Null and
    empty texts have no spans. Rows don't depend on each other, and the work is linear in a text and its matches. A column
    named `out` is replaced.
    """
    docs = docs.drop(out)
    clean = whole(F.col(text))
    steps = {"assign": matches(clean, ASSIGN), "access": matches(clean, ACCESS), "hex": matches(clean, HEX)}
    rows = docs.select("*", clean.alias("_text"), *[s.alias(f"_{k}") for k, s in steps.items()])

    def spans(kind: str, found: Column, keep: Callable[[Column], Column]) -> Column:
        rank = KINDS.index(kind)
        kept = F.filter(placed(found), keep)
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))

    rows = rows.select(
        *docs.columns,
        "_text",
        F.concat(
            spans("assign", F.col("_assign"), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= VALUE_CHARS),
            spans("access", F.col("_access"), lambda m: F.lit(True)),
            spans("hex", F.col("_hex"), lambda m: F.lit(True)),
        ).alias("_base"),
    )
    left = F.when(F.size("_base") > 0, shaded(F.col("_text"))).otherwise(F.col("_text"))
    candidates = once(left, lambda rest: matches(rest, CANDIDATE))
    added = once(candidates, lambda found: spans("entropy", found, lambda m: suspicious(m["value"])))
    return rows.select(*docs.columns, F.array_sort(F.concat("_base", added)).alias(out))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return joined(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
