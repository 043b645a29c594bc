"""Many plain texts looked for inside others in one pass.

A list of texts under `contains`, or of keywords, costs one comparison each as separate predicates. From LIST_SIZE on they
become one Aho-Corasick automaton, which reads a text once whatever the number of needles. It is built once per task, from
needles that travel with the plan as any literal does, and runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: So many needles are looked for together; fewer stay single comparisons inside the JVM.
LIST_SIZE = 64


def _finder(needles: tuple[str, ...], listed: bool):
    """A column function: does a text (or, `listed`, one of an array of texts) hold a needle?"""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for needle in needles:
            automaton.add_word(needle, True)
        automaton.make_automaton()
        holds = lambda text: text is not None and next(automaton.iter(text), None) is not None
        any_holds = lambda texts: texts is not None and any(map(holds, texts))
        for batch in batches:
            yield batch.map(any_holds if listed else holds).astype(bool)

    search.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, "boolean")


def _lister(needed: tuple[tuple[str, ...], ...]):
    """A column function: the places, from 1, of the members of which a text holds one."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        places: dict[str, list[int]] = {}
        for place, texts in enumerate(needed, 1):
            for text in texts:
                places.setdefault(text, []).append(place)
        automaton = ahocorasick.Automaton()
        for text, of in places.items():
            automaton.add_word(text, of)
        automaton.make_automaton()
        found = lambda text: sorted({place for _, of in automaton.iter(text) for place in of}) if text is not None else []
        for batch in batches:
            yield batch.map(found)

    search.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(search, "array<int>")


@dataclass(frozen=True)
class Needles:
    """A matcher for the values of a field that hold one of many texts. Lower-case needles match without regard to case."""

    texts: tuple[str, ...]
    cased: bool = False

    @classmethod
    def of(cls, texts: Iterable[str], cased: bool = False) -> Needles:
        return cls(tuple(sorted(set(texts) if cased else {t.lower() for t in texts})), cased)

    def __call__(self, item) -> Column:
        text = item.text if self.cased else item.lower
        # Every text holds the empty one.
        return text.isNotNull() if "" in self.texts else _finder(self.texts, False)(text)

    def among(self, texts: Column) -> Column:
        """The same for an array of texts: Python functions can't stand inside `exists`."""
        if "" in self.texts:
            return F.exists(texts, lambda t: t.isNotNull())
        return _finder(self.texts, True)(texts if self.cased else F.transform(texts, F.lower))


@dataclass(frozen=True)
class Guarded:
    """A matcher that can't hold where a search finds nothing. Members of lists go to the matcher directly."""

    search: Needles
    matcher: Callable[..., Column]

    def __call__(self, item) -> Column:
        return self.search(item) & self.matcher(item)


@dataclass(frozen=True)
class Patterns:
    """A matcher for values that match one of many patterns, each tried only where one of its texts was found.

    `needed` holds Java patterns and, for each, lower-case texts of which every match holds one. Members of lists go to the
    matcher directly.
    """

    needed: tuple[tuple[str, tuple[str, ...]], ...]
    matcher: Callable[..., Column]

    def __call__(self, item) -> Column:
        patterns = F.array(*[F.lit(pattern) for pattern, _ in self.needed])
        places = _lister(tuple(texts for _, texts in self.needed))(item.lower)
        return F.exists(places, lambda place: F.regexp_like(item.text, F.element_at(patterns, place)))


__all__ = ["LIST_SIZE", "Guarded", "Needles", "Patterns"]
