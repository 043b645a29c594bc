"""Looking a rule's field name up in an event row.

A name is found as: the exact key, else the key in any case, else a dotted path in any
case, else the only nested key of that name. The last rule is per record: a name that
occurs twice in one document counts as absent.

Events are typed columns, VARIANT documents, or both. Which paths a corpus holds is found
once by `discover_paths`; after that every lookup is a plain column expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofgrid.functions.fallible import Fallible
from proofgrid.functions.needles import Guarded, Needles, Patterns
from proofgrid.session import cut_lineage

ARRAY_STEP = "[*]"
# Fixed value: a name is looked for under at most so many keys. Dotted paths may be longer.
MAX_KEYS = 7
#: Levels of objects and lists that one pass of `discover_paths` opens.
LEVELS = 8
WHITESPACE = " \t\n\r\f\x0b"

# The numeric spellings accepted from text: a decimal with optional digit grouping by
# single underscores, an exponent, infinities, not-a-number, or hexadecimal.
_DIGITS = r"[0-9](?:_?[0-9])*"
DECIMAL_TEXT = (
    rf"^(?i)[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?"
    r"|inf|infinity|nan)$"
)
HEX_TEXT = r"^(?i)-?0x(?:_?[0-9a-f])+$"


def number_from_text(text: Column) -> Column:
    """Text as a double, NULL when it is not a number. Never fails under ANSI mode."""
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    plain = F.replace(trimmed, F.lit("_"), F.lit(""))
    digits = F.lower(F.regexp_replace(plain, r"^-?0[xX]", ""))
    head = F.conv(F.substr(digits, F.lit(1), F.lit(15)), 16, 10).try_cast("double")
    tail = F.pow(F.lit(16.0), F.greatest(F.length(digits) - 15, F.lit(0)).cast("double"))
    sign = F.when(F.startswith(plain, F.lit("-")), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(trimmed.rlike(HEX_TEXT), sign * head * tail).when(
        trimmed.rlike(DECIMAL_TEXT), plain.try_cast("double")
    )


@dataclass(frozen=True)
class Item:
    """One scalar seen by a matcher."""

    text: Column
    lower: Column
    number: Column
    null: Column


@dataclass(frozen=True)
class Located:
    """A field's value in a row.

    `present` tells a key that holds null from one that is absent; `blank` is absent, null,
    empty text or empty list; `any_item` is true when one of the values passes the test.
    """

    present: Column
    blank: Column
    filled: Column
    text: Column
    any_item: Callable[[Callable[[Item], Column]], Column]
    item: Item | None = None


def _never(_: Callable[[Item], Column]) -> Column:
    return F.lit(False)


def _absent() -> Located:
    no, nothing = F.lit(False), F.lit(None).cast("string")
    return Located(no, F.lit(True), no, nothing, _never)


def _typed_item(column: Column, dtype: T.DataType) -> Item:
    text = column.cast("string")
    if isinstance(dtype, T.BooleanType):
        number = F.lit(None).cast("double")
    elif isinstance(dtype, T.NumericType):
        number = column.cast("double")
    else:
        number = number_from_text(text)
    return Item(text, F.lower(text), number, column.isNull())


def _any_of(values: Column, test: Callable[[Item], Column], item_of: Callable[[Column], Item]) -> Column:
    """Does a member of a list pass the test?"""
    if isinstance(test, (Needles, Fallible)):
        return test.among(F.transform(values, lambda x: _filled_text(item_of(x)).text))
    test = test.matcher if isinstance(test, (Guarded, Patterns)) else test
    return F.exists(values, lambda x: test(_filled_text(item_of(x))))


def _typed(column: Column, dtype: T.DataType) -> Located:
    if isinstance(dtype, T.ArrayType):
        return Located(
            column.isNotNull(),
            column.isNull() | (F.size(column) == 0),
            column.isNotNull(),
            F.to_json(column),
            lambda test: _any_of(column, test, lambda x: _typed_item(x, dtype.elementType)),
        )
    item = _typed_item(column, dtype)
    return Located(
        column.isNotNull(),
        column.isNull() | (item.text == ""),
        column.isNotNull(),
        item.text,
        lambda test: test(item),
        item,
    )


def _variant_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _variant_item(value: Column) -> Item:
    text = _variant_text(value)
    return Item(text, F.lower(text), number_from_text(text), F.is_variant_null(value))


def _filled_text(item: Item) -> Item:
    """A null member of a list compares as empty text."""
    text, lower = (F.coalesce(c, F.lit("")) for c in (item.text, item.lower))
    return Item(text, lower, item.number, item.null)


def _variant(value: Column, may_be_list: bool) -> Located:
    scalar = _variant_item(value)
    filled = value.isNotNull() & ~F.coalesce(F.is_variant_null(value), F.lit(False))
    blank = ~filled | (_variant_text(value) == "") | (F.schema_of_variant(value) == "ARRAY<VOID>")

    def any_item(test: Callable[[Item], Column]) -> Column:
        if not may_be_list:
            return test(scalar)
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))
        return _any_of(items, test, _variant_item)

    return Located(
        value.isNotNull(),
        F.coalesce(blank, F.lit(True)),
        filled,
        scalar.text,
        any_item,
        None if may_be_list else scalar,
    )


@dataclass(frozen=True)
class EventFields:
    """Field lookup over a DataFrame's typed columns and, optionally, one VARIANT document.

    `paths` are key tuples found in the document, with ``[*]`` standing for list members.
    Typed columns come first; the document is searched for names no column has.
    """

    columns: dict[str, T.DataType] = field(default_factory=dict)
    document: str | None = None
    paths: frozenset[tuple[str, ...]] = frozenset()
    ready: dict[str, Located] = field(default_factory=dict)

    @classmethod
    def of(
        cls,
        df: DataFrame,
        document: str | None = None,
        paths: Iterable[tuple[str, ...]] = (),
        columns: Iterable[str] | None = None,
    ) -> EventFields:
        chosen = set(df.columns if columns is None else columns) - {document}
        typed = {f.name: f.dataType for f in df.schema.fields if f.name in chosen}
        nodes = {p[:i] for p in paths for i in range(1, len(p) + 1)}
        return cls(typed, document, frozenset(nodes))

    # -- lookup ------------------------------------------------------------

    def locate(self, name: str) -> Located:
        if name in self.ready:
            return self.ready[name]
        typed = self._typed_column(name)
        if typed is not None:
            return typed
        if self.document is None:
            return _absent()
        return self._in_document(name)

    def _typed_column(self, name: str) -> Located | None:
        for match in (
            lambda c: c == name,
            lambda c: c.lower() == name.lower(),
        ):
            for column, dtype in self.columns.items():
                if match(column):
                    return _typed(F.col(f"`{column}`"), dtype)
        return None

    def _in_document(self, name: str) -> Located:
        lowered = name.lower()
        keyed = sorted(p for p in self.paths if ARRAY_STEP not in p)
        top = [p for p in keyed if len(p) == 1 and p[0].lower() == lowered]
        top.sort(key=lambda p: p[0] != name)
        dotted = [
            p
            for p in keyed
            if len(p) > 1 and [k.lower() for k in p] == lowered.split(".")
        ]
        leaves = [
            p
            for p in self.paths
            if p[-1].lower() == lowered
            and len([k for k in p if k != ARRAY_STEP]) in range(2, MAX_KEYS + 1)
            and not any(k.lower() == lowered for k in p[:-1])
            and (ARRAY_STEP, ARRAY_STEP) not in zip(p, p[1:])
        ]
        options = [self._value(p) for p in top + dotted]
        if leaves:
            found = F.concat(*[self._occurrences(F.col(f"`{self.document}`"), p) for p in sorted(leaves)])
            options.append(F.when(F.size(found) == 1, F.get(found, 0)))
        if not options:
            return _absent()
        listed = any(p + (ARRAY_STEP,) in self.paths for p in top + dotted + leaves)
        return _variant(F.coalesce(*options), listed)

    def _value(self, path: tuple[str, ...]) -> Column:
        return F.variant_get(F.col(f"`{self.document}`"), json_path(path), "variant")

    def _occurrences(self, root: Column, path: tuple[str, ...]) -> Column:
        """Every value at a path, as an array; members of lists count one by one."""
        if ARRAY_STEP not in path:
            value = F.try_variant_get(root, json_path(path), "variant")
            return F.filter(F.array(value), lambda x: x.isNotNull())
        cut = path.index(ARRAY_STEP)
        members = F.try_variant_get(root, json_path(path[:cut]), "array<variant>")
        rest = path[cut + 1 :]
        if not rest:
            return F.coalesce(members, F.array().cast("array<variant>"))
        nested = F.flatten(F.transform(members, lambda x: self._occurrences(x, rest)))
        return F.coalesce(nested, F.array().cast("array<variant>"))

    def project(self, df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, EventFields]:
        """Compute the named fields once, as columns that many predicates then share.

        Each scalar field becomes columns for its text, lower-case text and number; the ones
        no predicate reads are pruned away again.
        """
        extra: dict[str, Column] = {}
        ready: dict[str, Located] = {}
        for i, name in enumerate(dict.fromkeys(names)):
            found = self.locate(name)
            if found.item is None:
                continue
            made = {
                "present": found.present,
                "blank": found.blank,
                "filled": found.filled,
                "text": found.item.text,
                "lower": found.item.lower,
                "number": found.item.number,
                "null": found.item.null,
            }
            column = {part: F.col(f"_f{i}_{part}") for part in made}
            extra |= {f"_f{i}_{part}": c for part, c in made.items()}
            item = Item(column["text"], column["lower"], column["number"], column["null"])
            ready[name] = Located(
                column["present"], column["blank"], column["filled"], column["text"],
                lambda test, item=item: test(item), item,
            )
        return df.select("*", *[c.alias(n) for n, c in extra.items()]), replace(self, ready={**self.ready, **ready})

    # -- whole-row search --------------------------------------------------

    def texts(self) -> Column:
        """Array of every scalar in the row as text, for keyword search."""
        parts = [
            F.coalesce(F.col(f"`{c}`").cast("array<string>"), F.array().cast("array<string>"))
            if isinstance(t, T.ArrayType)
            else F.array(F.col(f"`{c}`").cast("string"))
            for c, t in self.columns.items()
        ]
        if self.document is not None:
            root = F.col(f"`{self.document}`")
            leaves = [p for p in self.paths if not any(q[: len(p)] == p and q != p for q in self.paths)]
            mixed = [p for p in self.paths if p not in leaves]
            for path in sorted(leaves) + sorted(mixed):
                values = self._occurrences(root, path)
                if path in mixed:
                    values = F.filter(values, lambda x: ~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)<"))
                parts.append(F.transform(values, _variant_text))
        if not parts:
            return F.array().cast("array<string>")
        return F.array_compact(F.flatten(F.array(*parts)))


def json_path(path: tuple[str, ...]) -> str:
    """`$`-path that reaches nested keys whatever characters they hold."""
    return "$" + "".join(
        f"['{key}']" if "'" not in key else f'["{key}"]' for key in path
    )


def _opened(nodes: DataFrame) -> DataFrame:
    """Nodes with their paths, LEVELS levels further down; what holds nothing or is no container stays as it is, without node."""
    for _ in range(LEVELS):
        members = nodes.sparkSession.sql(
            """
            SELECT n.path, e.pos, e.key, e.value
            FROM {nodes} n, LATERAL variant_explode_outer(n.node) AS e(pos, key, value)
            """,
            nodes=nodes,
        )
        grown = F.concat("path", F.array(F.coalesce("key", F.lit(ARRAY_STEP))))
        end = F.col("pos").isNull()
        nodes = members.select(
            F.when(end, F.col("path")).otherwise(grown).alias("path"),
            F.when(~end, F.col("value")).alias("node"),
        )
    return nodes


def _leading_to(paths: DataFrame, names: Iterable[str]) -> DataFrame:
    """The parts of paths, from their start, under which a lookup of the names can find a value or a list's members."""
    asked = F.array(*map(F.lit, sorted({n.lower() for n in names}))).cast("array<string>")
    starts = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))
    start = paths.filter(F.size("path") > 0).select(F.explode(starts).alias("path"))
    member = F.element_at("path", -1) == ARRAY_STEP
    value = F.when(member, F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path"))
    by_key = F.array_contains(asked, F.lower(F.try_element_at(value, F.lit(-1))))
    by_path = F.array_contains(asked, F.lower(F.array_join(value, ".")))
    return start.filter((F.size(value) > 0) & (by_key | by_path)).distinct()


def discover_paths(df: DataFrame, document: str, names: Iterable[str] | None = None) -> list[tuple[str, ...]]:
    """Every key path that occurs in a VARIANT column, however deep; with `names` those that lookups of them need.

    A pass over the data opens LEVELS levels of objects and lists. Only where a document goes deeper, its unopened part is
    written and taken up in a further pass. Distinct paths are found by aggregation and stay in a table; what reaches the
    driver is the shape of the corpus or, with `names`, its part under these names, even if the data holds keys without end.
    """
    level = df.select(F.array().cast("array<string>").alias("path"), F.col(f"`{document}`").alias("node"))
    tables = []
    while True:
        level = _opened(level)
        container = F.coalesce(F.schema_of_variant("node").rlike("^(OBJECT|ARRAY)<"), F.lit(False))
        shape = cut_lineage(level.groupBy("path").agg(F.max(container).alias("unopened")))
        tables.append(shape.select("path"))
        if shape.filter("unopened").isEmpty():
            break
        level = cut_lineage(level.filter(container))
    found = reduce(DataFrame.union, tables)
    found = found.distinct() if names is None else _leading_to(found, names)
    return sorted(tuple(r.path) for r in found.collect() if r.path)
