"""Rule-side literals, expanded once when a rule is built (never per row)."""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext

# The dash spellings that command lines accept for one another
# (hyphen, slash, en dash, em dash, horizontal bar).
DASHES = "-/\u2013\u2014\u2015"

_DASH_START = re.compile(rf"(\s*)[{DASHES}](.*)", re.DOTALL)
_PIECE = re.compile(r"\\(?P<escaped>[*?\\])|(?P<wild>[*?])|(?P<plain>.)", re.DOTALL)
_JAVA_META = re.compile(r"([\\^$.|?*+()\[\]{}\-&#~])")


def dash_spellings(text: str) -> list[str]:
    found = _DASH_START.fullmatch(text)
    return [found[1] + dash + found[2] for dash in DASHES] if found else [text]


def base64_text(text: str) -> str:
    return base64.b64encode(text.encode()).decode()


def base64_alignments(text: str) -> list[str]:
    """The characters that are certain to appear wherever `text` sits inside base64 data.

    With `shift` unknown bytes in front, the first ceil(8*shift/6) characters and every
    character holding bits past the end depend on the surroundings and are cut off.
    """
    data = text.encode()
    parts = []
    for shift in range(3):
        encoded = base64.b64encode(bytes(shift) + data).decode()
        parts.append(encoded[-(-8 * shift // 6) : 8 * (shift + len(data)) // 6])
    return parts


TRANSFORMS = {
    "windash": dash_spellings,
    "base64": lambda text: [base64_text(text)],
    "base64offset": base64_alignments,
}


def expand(value: Any, transforms: tuple[str, ...] = ()) -> list[Any]:
    """Candidate list for one selection key, in author order, without repeats."""
    items = list(value) if isinstance(value, (list, tuple)) else [value]
    for name in transforms:
        items = [
            out
            for item in items
            for out in ([None] if item is None else TRANSFORMS[name](str(item)))
        ]
    return list({(type(item), str(item)): item for item in items}.values())


def java_quote(text: str) -> str:
    return _JAVA_META.sub(r"\\\1", text)


@dataclass(frozen=True)
class TextPattern:
    """A literal, or a wildcard text as a sequence of literals and `*` / `?` marks."""

    pieces: tuple[tuple[str, bool], ...]

    @classmethod
    def of(cls, text: str) -> TextPattern:
        found: list[tuple[str, bool]] = []
        for match in _PIECE.finditer(text):
            wild = match["wild"] is not None
            char = match["wild"] or match["escaped"] or match["plain"]
            if found and not wild and not found[-1][1]:
                found[-1] = (found[-1][0] + char, False)
            else:
                found.append((char, wild))
        return cls(tuple(found))

    @property
    def has_wildcard(self) -> bool:
        return any(wild for _, wild in self.pieces)

    @property
    def literal(self) -> str:
        return "".join(text for text, _ in self.pieces)

    def open_ended(self, head: bool, tail: bool) -> TextPattern:
        """Without the outer stars that an unanchored end makes redundant."""
        pieces = list(self.pieces)
        while head and pieces and pieces[0] == ("*", True):
            pieces.pop(0)
        while tail and pieces and pieces[-1] == ("*", True):
            pieces.pop()
        return TextPattern(tuple(pieces))

    def regex(self) -> str:
        marks = {"*": ".*", "?": "."}
        return "".join(marks[text] if wild else java_quote(text) for text, wild in self.pieces)


def warn_escaped_star(text: str) -> bool:
    r"""True for texts such as ``C:\Users\*`` whose star is escaped and so matches literally."""
    return bool(re.search(r"\w\\[*?]", text)) and not TextPattern.of(text).has_wildcard


# ------------------------------------------------------- regular expressions

# One step of a pattern: an escaped character, a character class, a named group, a brace, or any other character.
_STEP = re.compile(
    r"(?P<escaped>\\.)|\[(?P<negated>\^?)(?P<members>\]?(?:\\.|[^\]\\])*)\]|\(\?P<(?P<named>[^>]+)>|\(\?P=(?P<again>[^)]+)\)"
    r"|\{(?P<low>\d*)(?P<comma>,?)(?P<high>\d*)\}|(?P<other>.)",
    re.DOTALL,
)
_ONLY_PYTHON = re.compile(r"\(\?\(|\\N\{")


def _java_members(members: str) -> str:
    """The inside of a character class; Java gives meaning to `[`, `&&` and a first `]`, Python takes them as they are."""
    return re.sub(r"(\\.)|([\[\]&])", lambda m: m[1] or "\\" + m[2], members, flags=re.DOTALL)


def java_regex(pattern: str) -> str | None:
    """The pattern for `rlike`, or None when only Python can evaluate it.

    Both engines read most patterns alike. Named groups are respelled; a brace that is no quantifier and special characters
    in classes are escaped; the flags make `.` stop at newline only and give letters, digits and spaces their Unicode
    meaning. What Java still can't compile is left to Python. Raises ValueError for a pattern that is not valid at all.
    """
    try:
        re.compile(pattern)
    except re.error as problem:
        raise ValueError(f"invalid regular expression {pattern!r}: {problem}") from problem
    if _ONLY_PYTHON.search(pattern):
        return None
    names: dict[str, str] = {}

    def respell(step: re.Match[str]) -> str:
        if step["escaped"]:
            return r"\z" if step["escaped"] == r"\Z" else step["escaped"]
        if step["members"] is not None:
            return f"[{step['negated']}{_java_members(step['members'])}]"
        if step["named"]:
            names[step["named"]] = f"g{len(names)}"
            return f"(?<{names[step['named']]}>"
        if step["again"]:
            return rf"\k<{names[step['again']]}>"
        if step["low"] is not None:
            if step["low"] or step["comma"]:
                return f"{{{step['low'] or 0}{step['comma']}{step['high']}}}"
            return r"\{\}"
        return "\\" + step["other"] if step["other"] in "{}" else step["other"]

    java = "(?iudU)" + _STEP.sub(respell, pattern)
    return java if _compiles_in_java(java) else None


#: Letters that some character beyond ASCII equals when case doesn't count.
_SHARED_CASE = set("iksIKS")


def required_texts(pattern: str, least: int = 1) -> tuple[str, ...]:
    """Lower-case texts of which every match of the pattern holds at least one; empty where nothing is known.

    Read from the pattern's parse: letters that follow each other and must be there, or, where the pattern has
    alternatives, one text for each. Runs end at letters whose case reaches beyond ASCII, so that looking for the texts in
    a lower-cased value is exact. Of several answers the one whose shortest text is longest is given, if that has `least` characters.
    """
    try:
        found = _required(re._parser.parse(pattern, re.IGNORECASE))
    except (re.error, RecursionError):
        return ()
    return found if found and min(map(len, found)) >= least else ()


def _required(steps) -> tuple[str, ...]:
    answers: list[tuple[str, ...]] = []
    run = ""

    def end() -> None:
        nonlocal run
        if run:
            answers.append((run.lower(),))
        run = ""

    def walk(steps) -> None:
        nonlocal run
        for kind, value in steps:
            name = str(kind)
            if name == "LITERAL" and value < 128 and chr(value) not in _SHARED_CASE:
                run += chr(value)
            elif name == "SUBPATTERN" and not value[1] and not value[2]:
                walk(value[3])
            elif name != "AT":
                end()
                if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] >= 1:
                    answers.append(_required(value[2]))
                elif name == "BRANCH":
                    each = [_required(branch) for branch in value[1]]
                    answers.append(tuple(dict.fromkeys(t for texts in each for t in texts)) if all(each) else ())

    walk(steps)
    end()
    return max(filter(None, answers), key=lambda texts: (min(map(len, texts)), -len(texts)), default=())


def _compiles_in_java(java: str) -> bool:
    """True outside a Spark session, where there is no JVM to ask."""
    context = SparkContext._active_spark_context
    if context is None:
        return True
    try:
        context._jvm.java.util.regex.Pattern.compile(java)
    except Py4JJavaError:
        return False
    return True
