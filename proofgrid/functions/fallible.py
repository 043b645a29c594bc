"""Predicates in Python that may fail.

A user's test of a value runs on Arrow batches with two results: did it match, and the error it raised. An event for which a
rule's test fails is no match of that rule, also under `not`; the error comes out as a row (see `rules.match_or_fail`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_errors: ContextVar[list[Column] | None] = ContextVar("errors", default=None)


def _runner(test: Callable[[str, Any], bool], candidate: Any, listed: bool):
    """A column function: (hit, error) of a text, or of a list up to its first hit or error. NULL matches nothing."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def outcome(value):
            try:
                texts = [value] if not listed else [] if value is None else value
                return any(text is not None and test(text, candidate) for text in texts), None
            except Exception as problem:  # noqa: BLE001 - whatever a user's test raises is its result
                return False, f"{type(problem).__name__}: {problem}"

        for batch in batches:
            found = [outcome(value) for value in batch]
            yield pd.DataFrame({"hit": [bool(h) for h, _ in found], "error": pd.Series([e for _, e in found], dtype=object)})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "hit boolean, error string")


@dataclass(frozen=True)
class Fallible:
    """A matcher that notes the error column of each of its uses with the `failures` around it."""

    test: Callable[[str, Any], bool]
    candidate: Any

    def _noted(self, values: Column, listed: bool) -> Column:
        out = _runner(self.test, self.candidate, listed)(values)
        noted = _errors.get()
        if noted is not None:
            noted.append(out["error"])
        return out["hit"]

    def __call__(self, item) -> Column:
        return self._noted(item.text, False)

    def among(self, texts: Column) -> Column:
        """The same for an array of texts: Python functions can't stand inside `exists`."""
        return self._noted(texts, True)


@contextmanager
def failures() -> Iterator[list[Column]]:
    """The error columns of the fallible tests that are built inside."""
    noted: list[Column] = []
    token = _errors.set(noted)
    try:
        yield noted
    finally:
        _errors.reset(token)


__all__ = ["Fallible", "failures"]
