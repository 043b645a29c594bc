"""Boolean combination of named selections.

The condition text is respelled as a Python boolean expression over placeholders (the
precedence NOT > AND > OR is the same) and read with the standard `ast` module.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Mapping, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column

from proofgrid.functions.predicates import all_of, any_of

_NAME = r"[A-Za-z0-9_][\w*?.\-]*"
_QUANTIFIED = re.compile(rf"\b(all|\d+)\s+of\s+({_NAME})", re.IGNORECASE)
_WORD = re.compile(_NAME)


class ConditionError(ValueError):
    """A condition that cannot be resolved against the defined selections."""


def _matching(pattern: str, names: Sequence[str]) -> list[str]:
    found = [n for n in names if n == pattern or fnmatchcase(n, pattern)]
    if not found:
        raise ConditionError(f"{pattern!r} matches no selection of {', '.join(names) or 'none'}")
    return found


def resolve(text: str, names: Sequence[str]) -> ast.expr:
    """The condition as an expression tree whose names are ``s0``, ``s1``... by position."""
    if not isinstance(text, str) or not text.strip():
        raise ConditionError("the condition is empty")
    if "|" in text:
        raise ConditionError("aggregation after '|' is not supported")
    place = {name: f"s{i}" for i, name in enumerate(names)}
    groups: list[str] = []

    def joined(found: Sequence[str], word: str) -> str:
        groups.append("(" + f" {word} ".join(place[n] for n in found) + ")")
        return f" \x00{len(groups) - 1}\x00 "

    def quantified(match: re.Match[str]) -> str:
        quantity, pattern = match[1].lower(), match[2]
        if quantity not in ("1", "all"):
            raise ConditionError(f"'{match[0]}': only '1 of' and 'all of' are supported")
        found = list(names) if pattern.lower() == "them" else _matching(pattern, names)
        return joined(found, "or" if quantity == "1" else "and")

    def plain(match: re.Match[str]) -> str:
        word = match[0]
        if word in place:
            return place[word]
        if word.lower() in ("and", "or", "not"):
            return word.lower()
        if any(mark in word for mark in "*?"):
            return joined(_matching(word, names), "and")
        raise ConditionError(f"{word!r} is no selection of {', '.join(names) or 'none'}")

    pieces = re.split(r"(\x00\d+\x00)", _QUANTIFIED.sub(quantified, text))
    spelled = "".join(p if p.startswith("\x00") else _WORD.sub(plain, p) for p in pieces)
    spelled = re.sub(r"\x00(\d+)\x00", lambda m: groups[int(m[1])], spelled)
    try:
        return ast.parse(" ".join(spelled.split()), mode="eval").body
    except SyntaxError as problem:
        raise ConditionError(f"{text!r}: {problem.msg}") from problem


def condition(text: str | Sequence[str], selections: Mapping[str, Column]) -> Column:
    """The condition over boolean columns; a list of conditions means any of them."""
    if not isinstance(text, str):
        return any_of([condition(part, selections) for part in text])
    names = list(selections)

    def build(node: ast.expr) -> Column:
        if isinstance(node, ast.Name) and node.id[1:].isdigit():
            return selections[names[int(node.id[1:])]]
        if isinstance(node, ast.BoolOp):
            parts = [build(part) for part in node.values]
            return all_of(parts) if isinstance(node.op, ast.And) else any_of(parts)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
            return ~build(node.operand)
        raise ConditionError(f"{text!r}: unexpected {ast.unparse(node)}")

    return build(resolve(text, names))


def used_selections(text: str | Sequence[str], names: Sequence[str]) -> set[str]:
    texts = [text] if isinstance(text, str) else text
    return {
        names[int(node.id[1:])]
        for part in texts
        for node in ast.walk(resolve(part, list(names)))
        if isinstance(node, ast.Name)
    }
