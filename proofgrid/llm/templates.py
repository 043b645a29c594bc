"""A sandboxed template language, compiled to Python closures.

    {{ expression }}   {# comment #}   {% set name = expression %}   {% if e %} {% elif e %} {% else %} {% endif %}
    {% for name in expression %} {% endfor %}   {% generation %} {% endgeneration %}

A dash inside a mark (`{%-`, `-%}`) drops the white space beside it. Expressions have text, whole numbers, true, false, none,
names, fields (`a.b`, `a['b']`), == != < <= > >=, in, not in, and, or, not, + - * // % ~, `x if c else y` and filters
(`x | trim`). Fields are looked up in mappings alone, and there are no calls, so a template reaches nothing but the values
it is given and the filters; every loop ends with the sequence it runs over.

A template is parsed into a syntax tree; constants are folded (operators and filters on constants, names bound when the
template is compiled, branches whose condition is known, neighbouring text), and each node becomes a closure that yields
the pieces of the rendered text. OPEN and CLOSE stand around what a generation block yields.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

OPEN, CLOSE = object(), object()

TOKEN = re.compile(
    r"\s*(?:(?P<number>[0-9]+)|(?P<name>[A-Za-z_][A-Za-z_0-9]*)|(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")"
    r"|(?P<sign>==|!=|<=|>=|//|[-+*%~<>|.()\[\]=]))",
    re.DOTALL,
)
MARK = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.DOTALL)
WORDS = {"and", "or", "not", "in", "if", "else"}
CONSTANTS = {"true": True, "false": False, "none": None}
BINARY: dict[str, tuple[int, Callable]] = {
    "==": (4, operator.eq),
    "!=": (4, operator.ne),
    "<": (4, operator.lt),
    "<=": (4, operator.le),
    ">": (4, operator.gt),
    ">=": (4, operator.ge),
    "in": (4, lambda a, b: a in b),
    "not in": (4, lambda a, b: a not in b),
    "~": (5, lambda a, b: shown(a) + shown(b)),
    "+": (6, operator.add),
    "-": (6, operator.sub),
    "*": (7, operator.mul),
    "//": (7, operator.floordiv),
    "%": (7, operator.mod),
}
#: Operators that a text must not enter: it could be multiplied, or formatted.
NUMBERS = {"-", "*", "//", "%"}


#: Largest values that operators make, so that a loop can't grow them without end.
LONGEST, LARGEST = 1 << 26, 1 << 63


class TemplateError(ValueError):
    """A template that can't be compiled, or a value that an operator or filter doesn't take."""


def shown(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: shown(x).strip(),
    "upper": lambda x: shown(x).upper(),
    "lower": lambda x: shown(x).lower(),
    "length": lambda x: len(x),
}


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    """An operator, `and`, `or`, `not`, `if`, or a filter, on its operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Show:
    value: Any


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class If:
    condition: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


class Parser:
    """Marks and text of a template, to a syntax tree."""

    def __init__(self, source: str):
        self.marks: list[tuple[str, str]] = []
        at, strip = 0, False
        for m in MARK.finditer(source):
            kind = "show" if m[2] is not None else "do" if m[5] is not None else "note"
            left, right = {"show": (m[1], m[3]), "do": (m[4], m[6]), "note": (m[7], m[8])}[kind]
            self.text(source[at : m.start()], strip, bool(left))
            if kind != "note":
                self.marks.append((kind, m[2] if kind == "show" else m[5]))
            at, strip = m.end(), bool(right)
        self.text(source[at:], strip, False)
        self.at = 0

    def text(self, text: str, left: bool, right: bool) -> None:
        text = text.lstrip() if left else text
        text = text.rstrip() if right else text
        if text:
            self.marks.append(("text", text))

    def template(self) -> tuple:
        body, end = self.body()
        if end:
            raise TemplateError(f"{end} without its beginning")
        return body

    def body(self) -> tuple[tuple, str]:
        """Nodes up to a statement that ends or divides a block, and that statement's first word."""
        nodes: list = []
        while self.at < len(self.marks):
            kind, content = self.marks[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Show(Const(content)))
                continue
            self.tokens, self.next = tokens(content), 0
            if kind == "show":
                nodes.append(Show(self.whole()))
                continue
            word = self.word()
            if word in ("endfor", "endif", "endgeneration", "else", "elif"):
                return tuple(nodes), word
            nodes.append(self.statement(word))
        return tuple(nodes), ""

    def block(self, *ends: str) -> tuple[tuple, str]:
        body, end = self.body()
        if end not in ends:
            raise TemplateError(f"{' or '.join(ends)} expected, not {end or 'the end'}")
        return body, end

    def statement(self, word: str):
        if word == "set":
            name = self.word()
            self.sign("=")
            return Set(name, self.whole())
        if word == "for":
            name = self.word()
            if self.word() != "in":
                raise TemplateError("for without in")
            return For(name, self.whole(), self.block("endfor")[0])
        if word == "generation":
            self.ended()
            return Generation(self.block("endgeneration")[0])
        if word == "if":
            return self.branches()
        raise TemplateError(f"unknown statement {word}")

    def branches(self) -> If:
        condition = self.whole()
        then, end = self.block("elif", "else", "endif")
        if end == "elif":
            return If(condition, then, (self.branches(),))
        return If(condition, then, self.block("endif")[0] if end == "else" else ())

    # Tokens of one mark.

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.next] if self.next < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        self.next += 1
        return self.tokens[self.next - 1] if self.next <= len(self.tokens) else ("end", "")

    def word(self) -> str:
        kind, word = self.take()
        if kind != "name":
            raise TemplateError(f"name expected, not {word!r}")
        return word

    def sign(self, sign: str) -> None:
        if self.take() != ("sign", sign):
            raise TemplateError(f"{sign} expected")

    def ended(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def whole(self):
        found = self.choice()
        self.ended()
        return found

    def choice(self):
        value = self.binary(1)
        if self.peek() == ("name", "if"):
            self.take()
            condition = self.binary(1)
            other: Any = Const(None)
            if self.peek() == ("name", "else"):
                self.take()
                other = self.choice()
            return Op("if", (condition, value, other))
        return value

    def operator(self) -> tuple[int, str]:
        kind, word = self.peek()
        if kind == "name" and word in ("or", "and"):
            return (1, word) if word == "or" else (2, word)
        if kind == "name" and word == "not" and self.tokens[self.next + 1 : self.next + 2] == [("name", "in")]:
            return BINARY["not in"][0], "not in"
        if (kind == "sign" or word == "in") and word in BINARY:
            return BINARY[word][0], word
        return 0, ""

    def binary(self, least: int):
        """Operators of at least a precedence; all of them bind to the left."""
        left = self.unary()
        while (found := self.operator())[0] >= least:
            level, name = found
            self.next += 2 if name == "not in" else 1
            left = Op(name, (left, self.binary(level + 1)))
        return left

    def unary(self):
        if self.peek() == ("name", "not"):
            self.take()
            return Op("not", (self.binary(3),))
        if self.peek() == ("sign", "-"):
            self.take()
            return Op("-", (Const(0), self.unary()))
        return self.postfix()

    def postfix(self):
        kind, word = self.take()
        if kind == "number":
            value: Any = Const(int(word))
        elif kind == "text":
            value = Const(unquoted(word))
        elif kind == "name" and word not in WORDS:
            value = Const(CONSTANTS[word]) if word in CONSTANTS else Name(word)
        elif (kind, word) == ("sign", "("):
            value = self.choice()
            self.sign(")")
        else:
            raise TemplateError(f"value expected, not {word!r}")
        while (sign := self.peek()) in (("sign", "."), ("sign", "["), ("sign", "|")):
            self.take()
            if sign[1] == ".":
                value = Field(value, Const(self.word()))
            elif sign[1] == "[":
                value = Field(value, self.choice())
                self.sign("]")
            else:
                value = Op(f"|{self.word()}", (value,))
        return value


def tokens(source: str) -> list[tuple[str, str]]:
    found, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        found.append((str(m.lastgroup), m[m.lastgroup or 0]))
        at = m.end()
    return found


def unquoted(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1], flags=re.DOTALL)


def apply(name: str, args: list, filters: dict[str, Callable]) -> Any:
    """An operator or filter on values."""
    try:
        if name[0] == "|":
            return filters[name[1:]](args[0])
        if name in NUMBERS and not all(isinstance(a, int) for a in args):
            raise TypeError("not a number")
        value = BINARY[name][1](*args)
        if isinstance(value, str) and len(value) > LONGEST or isinstance(value, int) and abs(value) > LARGEST:
            raise TypeError("too large")
        return value
    except TemplateError:
        raise
    except Exception as problem:  # noqa: BLE001 - whatever a value may raise is an error of the template
        raise TemplateError(f"{name.strip('|')}: {problem}") from None


def field(of: Any, key: Any) -> Any:
    """A mapping's value; none where there is no mapping or no such key."""
    return of.get(key) if isinstance(of, dict) and isinstance(key, str) else None


class Folder:
    """Folds what is known when a template is compiled. Names that are set or looped over anywhere are unknown."""

    def __init__(self, known: dict[str, Any], filters: dict[str, Callable]):
        self.known, self.filters = known, filters

    def value(self, node):
        if isinstance(node, Name):
            return Const(self.known[node.name]) if node.name in self.known else node
        if isinstance(node, Field):
            of, key = self.value(node.of), self.value(node.key)
            return Const(field(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Field(of, key)
        if not isinstance(node, Op):
            return node
        args = tuple(self.value(a) for a in node.args)
        first = args[0]
        if node.name in ("if", "and", "or") and isinstance(first, Const):
            if node.name == "if":
                return args[1] if first.value else args[2]
            return args[1] if bool(first.value) == (node.name == "and") else first
        if all(isinstance(a, Const) for a in args) and node.name not in ("if", "and", "or"):
            return Const(not first.value if node.name == "not" else apply(node.name, [a.value for a in args], self.filters))
        return Op(node.name, args)

    def nodes(self, body: tuple) -> tuple:
        out: list = []
        for node in body:
            for n in self.node(node):
                # Neighbouring constant text is one piece.
                if isinstance(n, Show) and isinstance(n.value, Const):
                    n = Show(Const(shown(n.value.value)))
                    if out and isinstance(out[-1], Show) and isinstance(out[-1].value, Const):
                        out[-1] = Show(Const(out[-1].value.value + n.value.value))
                        continue
                out.append(n)
        return tuple(n for n in out if n != Show(Const("")))

    def node(self, node) -> tuple:
        if isinstance(node, Show):
            return (Show(self.value(node.value)),)
        if isinstance(node, Set):
            return (Set(node.name, self.value(node.value)),)
        if isinstance(node, Generation):
            return (Generation(self.nodes(node.body)),)
        if isinstance(node, For):
            return (For(node.name, self.value(node.over), self.nodes(node.body)),)
        condition = self.value(node.condition)
        then, other = self.nodes(node.then), self.nodes(node.other)
        if isinstance(condition, Const):
            return then if condition.value else other
        return (If(condition, then, other),)


def walk(nodes: Iterable) -> Iterator[Any]:
    """All nodes of a tree."""
    for node in nodes:
        yield node
        if hasattr(node, "__dataclass_fields__"):
            for name in node.__dataclass_fields__:
                part = getattr(node, name)
                yield from walk(part if isinstance(part, tuple) else (part,))


Scope = dict[str, Any]


def evaluated(node, filters: dict[str, Callable]) -> Callable[[Scope], Any]:
    """A closure for an expression."""
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Field):
        of, key = evaluated(node.of, filters), evaluated(node.key, filters)
        return lambda scope: field(of(scope), key(scope))
    args = [evaluated(a, filters) for a in node.args]
    if node.name == "if":
        condition, yes, no = args
        return lambda scope: yes(scope) if condition(scope) else no(scope)
    if node.name == "not":
        return lambda scope: not args[0](scope)
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    name = node.name
    return lambda scope: apply(name, [a(scope) for a in args], filters)


def rendered(nodes: tuple, filters: dict[str, Callable]) -> Callable[[Scope], Iterator[Any]]:
    """A closure that yields what some nodes render."""
    parts = [_rendered(node, filters) for node in nodes]
    if len(parts) == 1:
        return parts[0]

    def run(scope: Scope) -> Iterator[Any]:
        for part in parts:
            yield from part(scope)

    return run


def _rendered(node, filters: dict[str, Callable]) -> Callable[[Scope], Iterator[Any]]:
    if isinstance(node, Show):
        if isinstance(node.value, Const):
            text = (node.value.value,)
            return lambda scope: iter(text)
        value = evaluated(node.value, filters)
        return lambda scope: iter((shown(value(scope)),))
    if isinstance(node, Set):
        name, value = node.name, evaluated(node.value, filters)

        def assign(scope: Scope) -> Iterator[Any]:
            scope[name] = value(scope)
            return iter(())

        return assign
    body = rendered(node.then if isinstance(node, If) else node.body, filters)
    if isinstance(node, If):
        condition, other = evaluated(node.condition, filters), rendered(node.other, filters)
        return lambda scope: body(scope) if condition(scope) else other(scope)
    if isinstance(node, Generation):

        def marked(scope: Scope) -> Iterator[Any]:
            yield OPEN
            yield from body(scope)
            yield CLOSE

        return marked
    name, over = node.name, evaluated(node.over, filters)

    def loop(scope: Scope) -> Iterator[Any]:
        values = over(scope)
        if values is None or isinstance(values, (str, int, dict)):
            raise TemplateError(f"can't loop over {type(values).__name__}")
        outer, shadowed = scope.get("loop"), scope.get(name)
        rest = iter(values)
        for k, (value, last) in enumerate(ahead(rest)):
            scope[name] = value
            scope["loop"] = {"first": k == 0, "last": last, "index": k + 1, "index0": k}
            yield from body(scope)
        scope["loop"], scope[name] = outer, shadowed

    return loop


def ahead(values: Iterator) -> Iterator[tuple[Any, bool]]:
    """Each value, and whether it is the last."""
    end = object()
    held = next(values, end)
    while held is not end:
        following = next(values, end)
        yield held, following is end
        held = following


class Template:
    """A compiled template over `messages`, with constants bound and filters added."""

    def __init__(self, source: str, constants: dict[str, Any] | None = None, filters: dict[str, Callable] | None = None):
        self.filters = FILTERS | (filters or {})
        tree = Parser(source).template()
        nodes = list(walk(tree))
        bound = {n.name for n in nodes if isinstance(n, (Set, For))} | {"loop", "messages"}
        known = {k: v for k, v in (constants or {}).items() if k not in bound}
        for node in nodes:
            if isinstance(node, Name) and node.name not in bound | set(known):
                raise TemplateError(f"unknown name {node.name}")
            if isinstance(node, Op) and node.name[0] == "|" and node.name[1:] not in self.filters:
                raise TemplateError(f"unknown filter {node.name[1:]}")
            if isinstance(node, Generation) and any(isinstance(n, Generation) for n in walk(node.body)):
                raise TemplateError("a generation block inside another")
        self.tree = Folder(known, self.filters).nodes(tree)
        #: Whether messages are only looped over, once and not inside another loop, so that they may be an iterator.
        loops = [n for n in self.tree if isinstance(n, For) and n.over == Name("messages")]
        self.one_pass = len(loops) <= 1 and sum(n == Name("messages") for n in walk(self.tree)) == len(loops)
        self.run = rendered(self.tree, self.filters)

    def render(self, messages: Iterable[dict]) -> Iterator[Any]:
        """The pieces of the text, and OPEN and CLOSE around generated ones."""
        return self.run({"messages": messages if self.one_pass else list(messages)})
