"""Compiler of a small sandboxed template language for conversations.

Text stands for itself; ``{{ expression }}`` is replaced by a value. Statements: ``{% for x in e %}`` (with ``loop.index``,
``loop.index0``, ``loop.first``, ``loop.last``), ``{% if e %}``/``{% elif e %}``/``{% else %}``, ``{% set x = e %}`` and
``{% generation %}``, whose output a model is trained on; each block ends in ``{% end... %}``. A ``-`` beside a delimiter strips white space there.
Expressions: strings, integers, ``true``, ``false``, ``none``, names, ``a.b``, ``a[b]``, ``~ + - == != < <= > >= in, not in, and or not``,
``x if c else y``, and filters ``|name``. There are no calls, a name is looked up in the given values only, and ``a.b`` reads keys
of mappings only, so that a template reaches nothing else. Constant parts are computed once, when the template is compiled; what
remains becomes nested Python closures that yield pieces lazily, so a conversation of any length renders in bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any


class TemplateError(ValueError):
    pass


_DELIMITER = re.compile(r"""\{([{%])(-?)((?:'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"])*?)(-?)[}%]\}""", re.DOTALL)  # what is quoted ends no tag
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[~+\-<>|.\[\]()=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
}
FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "string": lambda x: _text(x),
    "length": len,
}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# Expressions are tuples: ("const", v), ("name", n), ("item", a, b), ("binary", op, a, b), ("and"/"or", a, b), ("not", a), ("choose", c, a, b), ("filter", name, a).


class _Expression:
    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((found.lastgroup or "", found[found.lastgroup or 0]))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *wanted: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in wanted:
            self.at += 1
            return value
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing before {self.peek()[1]!r}")

    def whole(self) -> tuple:
        found = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"{self.peek()[1]!r} is left over")
        return found

    def choice(self) -> tuple:
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return ("choose", test, value, self.choice())
        return value

    def either(self) -> tuple:
        value = self.both()
        while self.take("or"):
            value = ("or", value, self.both())
        return value

    def both(self) -> tuple:
        value = self.inverse()
        while self.take("and"):
            value = ("and", value, self.inverse())
        return value

    def inverse(self) -> tuple:
        return ("not", self.inverse()) if self.take("not") else self.compare()

    def compare(self) -> tuple:
        value = self.add()
        while True:
            if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
                value = ("binary", op, value, self.add())
            elif self.tokens[self.at : self.at + 2] == [("name", "not"), ("name", "in")]:
                self.at += 2
                value = ("not", ("binary", "in", value, self.add()))
            else:
                return value

    def add(self) -> tuple:
        value = self.filtered()
        while op := self.take("~", "+", "-"):
            value = ("binary", op, value, self.filtered())
        return value

    def filtered(self) -> tuple:
        value = self.item()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name":
                raise TemplateError("a filter's name is missing")
            self.at += 1
            value = ("filter", name, value)
        return value

    def item(self) -> tuple:
        value = self.atom()
        while op := self.take(".", "["):
            if op == "[":
                value = ("item", value, self.choice())
                self.need("]")
            else:
                kind, name = self.peek()
                if kind != "name":
                    raise TemplateError("a name is missing after '.'")
                self.at += 1
                value = ("item", value, ("const", name))
        return value

    def atom(self) -> tuple:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return ("const", int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return ("const", fixed[value]) if value in fixed else ("name", value)
        if value == "(":
            inner = self.choice()
            self.need(")")
            return inner
        raise TemplateError(f"{value!r} can't begin an expression")


def fold(e: tuple, filters: Mapping[str, Callable]) -> tuple:
    """Compute what depends on constants only."""
    kind, *parts = e
    parts = [fold(p, filters) if isinstance(p, tuple) else p for p in parts]
    if kind in ("const", "name"):
        return e
    if kind == "filter" and parts[0] not in filters:
        raise TemplateError(f"no filter {parts[0]!r}")
    inner = [p for p in parts if isinstance(p, tuple)]
    if all(p[0] == "const" for p in inner):
        try:
            return ("const", closure((kind, *parts), filters)({}))
        except Exception as error:
            raise TemplateError(f"a constant expression fails: {error}") from error
    if kind == "choose" and parts[0][0] == "const":
        return parts[1] if parts[0][1] else parts[2]
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    return (kind, *parts)


def _item(value: Any, key: Any) -> Any:
    if isinstance(value, Mapping):
        return value.get(key)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else None
    raise TemplateError(f"a {type(value).__name__} has no {key!r} here")


def closure(e: tuple, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A folded expression as a function of the values."""
    kind, *parts = e
    if kind == "const":
        return lambda env, v=parts[0]: v
    if kind == "name":
        return lambda env, n=parts[0]: env.get(n)
    f = [closure(p, filters) for p in parts if isinstance(p, tuple)]
    if kind == "item":
        return lambda env: _item(f[0](env), f[1](env))
    if kind == "binary":
        op = _BINARY[parts[0]]
        return lambda env: op(f[0](env), f[1](env))
    if kind == "and":
        return lambda env: f[0](env) and f[1](env)
    if kind == "or":
        return lambda env: f[0](env) or f[1](env)
    if kind == "not":
        return lambda env: not f[0](env)
    if kind == "choose":
        return lambda env: f[1](env) if f[0](env) else f[2](env)
    return lambda env, g=filters[parts[0]]: g(f[0](env))


Piece = tuple[str, bool]  # text, and whether a model is trained on it
Render = Callable[[dict, bool], Iterator[Piece]]


class Template:
    """``render(values)`` yields pieces (text, generated); a ``for`` may run over any iterator."""

    def __init__(self, source: str, filters: Mapping[str, Callable] | None = None):
        self.filters = FILTERS | dict(filters or {})
        self.parts = self._split(source)
        self.at = 0
        self.tree = self._block(())
        self._render = self._compile(self.tree)

    def render(self, values: Mapping[str, Any]) -> Iterator[Piece]:
        return self._render(dict(values), False)

    @staticmethod
    def _split(source: str) -> list[tuple[str, str]]:
        parts: list[tuple[str, str]] = []
        at, strip = 0, False
        for found in _DELIMITER.finditer(source):
            if found[0][-2] != ("}" if found[1] == "{" else "%"):
                raise TemplateError(f"{found[0]!r} mixes delimiters")
            text = source[at : found.start()]
            text = text.lstrip() if strip else text
            text = text.rstrip() if found[2] else text
            parts += [("text", text), ("value" if found[1] == "{" else "do", found[3].strip())]
            at, strip = found.end(), bool(found[4])
        rest = source[at:].lstrip() if strip else source[at:]
        if re.search(r"\{[{%]|[%}]\}", rest):
            raise TemplateError("a delimiter isn't closed")
        return [p for p in [*parts, ("text", rest)] if p != ("text", "")]

    def _parse(self, source: str) -> tuple:
        return fold(_Expression(source).whole(), self.filters)

    def _block(self, ends: tuple[str, ...]) -> list[tuple]:
        """The nodes up to a statement that begins with one of ``ends``; constant text is merged."""
        nodes: list[tuple] = []

        def text(value: str) -> None:
            if nodes and nodes[-1][0] == "text":
                nodes[-1] = ("text", nodes[-1][1] + value)
            elif value:
                nodes.append(("text", value))

        while self.at < len(self.parts):
            kind, source = self.parts[self.at]
            if kind == "do" and source.split(" ")[0] in ends:
                return nodes
            self.at += 1
            if kind == "text":
                text(source)
            elif kind == "value":
                e = self._parse(source)
                text(_text(e[1])) if e[0] == "const" else nodes.append(("value", e))
            else:
                self._statement(source, nodes, text)
        if ends:
            raise TemplateError(f"{{% {ends[-1]} %}} is missing")
        return nodes

    def _close(self) -> str:
        self.at += 1
        return self.parts[self.at - 1][1]

    def _statement(self, source: str, nodes: list[tuple], text: Callable[[str], None]) -> None:
        verb, _, rest = source.partition(" ")
        if verb == "for" and (found := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)):
            body = self._block(("endfor",))
            self._close()
            nodes.append(("for", found[1], self._parse(found[2]), body))
        elif verb == "set" and (found := re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)):
            nodes.append(("set", found[1], self._parse(found[2])))
        elif verb == "generation":
            body = self._block(("endgeneration",))
            self._close()
            nodes.append(("generation", body))
        elif verb == "if":
            arms: list[tuple[tuple, list]] = []
            test = self._parse(rest)
            while True:
                body = self._block(("elif", "else", "endif"))
                arms.append((test, body))
                verb, _, rest = self._close().partition(" ")
                if verb == "endif":
                    break
                test = self._parse(rest) if verb == "elif" else ("const", True)
            live = [a for a in arms if a[0][0] != "const" or a[0][1]]
            if live and live[0][0][0] == "const":  # the test is known to hold
                for node in live[0][1]:
                    text(node[1]) if node[0] == "text" else nodes.append(node)
            elif live:
                nodes.append(("if", live))
        else:
            raise TemplateError(f"unknown statement {source!r}")

    def _compile(self, nodes: list[tuple]) -> Render:
        steps = [self._node(n) for n in nodes]

        def run(env: dict, generated: bool) -> Iterator[Piece]:
            for step in steps:
                yield from step(env, generated)

        return steps[0] if len(steps) == 1 else run

    def _node(self, node: tuple) -> Render:
        kind = node[0]
        if kind == "text":
            return lambda env, generated, t=node[1]: iter(((t, generated),))
        if kind == "value":
            f = closure(node[1], self.filters)
            return lambda env, generated: iter(((_text(f(env)), generated),))
        if kind == "generation":
            body = self._compile(node[1])
            return lambda env, generated: body(env, True)
        if kind == "set":
            f = closure(node[2], self.filters)

            def put(env: dict, generated: bool) -> Iterator[Piece]:
                env[node[1]] = f(env)
                return iter(())

            return put
        if kind == "if":
            arms = [(closure(test, self.filters), self._compile(body)) for test, body in node[1]]

            def choose(env: dict, generated: bool) -> Iterator[Piece]:
                for test, body in arms:
                    if test(env):
                        return body(env, generated)
                return iter(())

            return choose
        source, body = closure(node[2], self.filters), self._compile(node[3])

        def loop(env: dict, generated: bool) -> Iterator[Piece]:
            items, inner, i = iter(source(env) or ()), dict(env), 0
            item = next(items, _END)
            while item is not _END:  # one item ahead, for loop.last
                after = next(items, _END)
                inner[node[1]] = item
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is _END}
                yield from body(inner, generated)
                item, i = after, i + 1

        return loop


_END = object()
