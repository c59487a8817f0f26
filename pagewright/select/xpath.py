"""XPath 1.0 on a page's tree: location paths with axes and predicates, unions, operators and the
core string, number and boolean functions. Attributes are ``(element, name, value)`` nodes."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import Any

from pagewright.dom.tree import Node, normal


class InvalidXPath(ValueError):
    """An expression that can't be read."""


class Attr:
    """An attribute node."""

    __slots__ = ("parent", "name", "text")

    def __init__(self, parent: Node, name: str, text: str) -> None:
        self.parent, self.name, self.text = parent, name, text


_TOKEN = re.compile(
    r"\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>\"[^\"]*\"|'[^']*')|(?P<op>::|//|\.\.|!=|<=|>=|[/()\[\]@,.|+\-=<>*$])|(?P<name>[A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?))"
)
_AXES = frozenset(
    "child descendant descendant-or-self parent ancestor ancestor-or-self self following-sibling preceding-sibling following preceding attribute".split()
)
_REVERSE = frozenset("ancestor ancestor-or-self preceding-sibling preceding parent".split())


def _tokens(text: str) -> list[tuple[str, str]]:
    out, i = [], 0
    text = text.strip()
    while i < len(text):
        m = _TOKEN.match(text, i)
        if not m:
            raise InvalidXPath(text)
        out.append((m.lastgroup, m[m.lastgroup]))
        i = m.end()
    return out


class _Parser:
    """Recursive descent; expressions are nested tuples."""

    def __init__(self, text: str) -> None:
        self.text, self.t, self.i = text, _tokens(text), 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k][1] if self.i + k < len(self.t) else ""

    def kind(self, k: int = 0) -> str:
        return self.t[self.i + k][0] if self.i + k < len(self.t) else ""

    def take(self, want: str | None = None) -> str:
        got = self.peek()
        if not got or want is not None and got != want:
            raise InvalidXPath(self.text)
        self.i += 1
        return got

    def binary(self, level: int = 0):
        levels = [("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod")]
        if level == len(levels):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in levels[level] and self.kind() in ("op", "name"):
            op = self.take()
            left = ("op", op, left, self.binary(level + 1))
        return left

    def unary(self):
        if self.peek() == "-":
            self.take()
            return ("neg", self.unary())
        left = self.path()
        while self.peek() == "|":
            self.take()
            left = ("union", left, self.path())
        return left

    def path(self):
        start = None
        if self.kind() in ("num", "str"):
            kind, value = self.t[self.i]
            self.i += 1
            return ("lit", float(value) if kind == "num" else value[1:-1])
        if self.peek() == "(" or self.kind() == "name" and self.peek(1) == "(" and self.peek() not in ("text", "node", "comment"):
            start = self.primary()
            if self.peek() not in ("/", "//", "["):
                return start
            steps: list = [("filter", self.predicates())]
        else:
            steps = []
        if self.peek() in ("/", "//"):
            if start is None:
                start = ("root",)
            if self.peek() == "/" and self.peek(1) in ("", "|", ")", "]", ","):
                self.take()
                return start
        elif start is None:
            start = ("here",)
            steps.append(self.step())
        while self.peek() in ("/", "//"):
            if self.take() == "//":
                steps.append(("step", "descendant-or-self", ("node",), []))
            steps.append(self.step())
        return ("path", start, steps)

    def primary(self):
        if self.peek() == "(":
            self.take()
            out = self.binary()
            self.take(")")
            return out
        name = self.take()
        self.take("(")
        args = []
        while self.peek() != ")":
            args.append(self.binary())
            if self.peek() == ",":
                self.take()
        self.take(")")
        return ("call", name, args)

    def predicates(self) -> list:
        out = []
        while self.peek() == "[":
            self.take()
            out.append(self.binary())
            self.take("]")
        return out

    def step(self):
        if self.peek() == ".":
            self.take()
            return ("step", "self", ("node",), self.predicates())
        if self.peek() == "..":
            self.take()
            return ("step", "parent", ("node",), self.predicates())
        axis = "child"
        if self.peek() == "@":
            self.take()
            axis = "attribute"
        elif self.peek(1) == "::":
            axis = self.take()
            self.take("::")
            if axis not in _AXES:
                raise InvalidXPath(self.text)
        if self.peek() == "*":
            self.take()
            test = ("any",)
        elif self.kind() == "name":
            name = self.take()
            if self.peek() == "(" and name in ("text", "node", "comment"):
                self.take()
                self.take(")")
                test = (name,)
            else:
                test = ("name", name.lower())
        else:
            raise InvalidXPath(self.text)
        return ("step", axis, test, self.predicates())


@lru_cache(maxsize=2048)
def compile_xpath(text: str):
    p = _Parser(text)
    out = p.binary()
    if p.i != len(p.t):
        raise InvalidXPath(text)
    return out


def string_value(x: Node | Attr) -> str:
    if isinstance(x, Attr) or x.kind in ("text", "comment"):
        return x.text
    return "".join(n.text for n in x.walk() if n.kind == "text")


def _order(x: Node | Attr) -> tuple[int, int]:
    if isinstance(x, Attr):
        return x.parent.pre, 1 + [k for k, _ in x.parent.attrs].index(x.name)
    return x.pre, 0


def _axis(x: Node | Attr, axis: str) -> list[Node | Attr]:
    if isinstance(x, Attr):
        up = [x.parent, *x.parent.ancestors()]
        return {"self": [x], "parent": up[:1], "ancestor": up, "ancestor-or-self": [x, *up], "descendant-or-self": [x]}.get(axis, [])
    if axis == "attribute":
        seen: dict[str, str] = {}
        for k, v in x.attrs:
            seen.setdefault(k, v)
        return [Attr(x, k, v) for k, v in seen.items()]
    if axis == "child":
        return list(x.children)
    if axis == "self":
        return [x]
    if axis in ("descendant", "descendant-or-self"):
        return [n for n in x.walk() if axis[-4:] == "self" or n is not x]
    if axis == "parent":
        return [x.parent] if x.parent is not None else []
    if axis in ("ancestor", "ancestor-or-self"):
        out, n = ([x] if axis[-4:] == "self" else []), x.parent
        while n is not None:
            out.append(n)
            n = n.parent
        return out
    same = x.parent.children if x.parent is not None else [x]
    at = next(i for i, s in enumerate(same) if s is x)
    if axis == "following-sibling":
        return same[at + 1 :]
    if axis == "preceding-sibling":
        return same[:at][::-1]
    top = x
    while top.parent is not None:
        top = top.parent
    everything = list(top.walk())
    if axis == "following":
        return [n for n in everything if n.pre > x.last]
    above = set(map(id, _axis(x, "ancestor")))
    return [n for n in reversed(everything) if n.pre < x.pre and id(n) not in above]


def _fits(x: Node | Attr, axis: str, test: tuple) -> bool:
    if test[0] == "node":
        return True
    if isinstance(x, Attr):
        return test[0] == "any" or test[0] == "name" and x.name == test[1]
    if test[0] in ("text", "comment"):
        return x.kind == test[0]
    return x.kind == "element" and (test[0] == "any" or x.tag == test[1])


def _number(v: Any) -> float:
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, float):
        return v
    try:
        return float(_string(v).strip() or "nan")
    except ValueError:
        return float("nan")


def _string(v: Any) -> str:
    if isinstance(v, list):
        return string_value(v[0]) if v else ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return "NaN" if v != v else str(int(v)) if v == int(v) else repr(v)
    return v


def _boolean(v: Any) -> bool:
    if isinstance(v, float):
        return v == v and v != 0
    return bool(v)


def _compare(op: str, a: Any, b: Any) -> bool:
    if isinstance(a, list) and not isinstance(b, bool):
        return any(_compare(op, string_value(x), b) for x in a)
    if isinstance(b, list) and not isinstance(a, bool):
        return any(_compare(op, a, string_value(x)) for x in b)
    if op in ("=", "!="):
        if isinstance(a, bool) or isinstance(b, bool):
            same = _boolean(a) == _boolean(b)
        elif isinstance(a, float) or isinstance(b, float):
            same = _number(a) == _number(b)
        else:
            same = _string(a) == _string(b)
        return same == (op == "=")
    x, y = _number(a), _number(b)
    return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def _call(name: str, args: list, node, place: int, size: int) -> Any:
    v = [evaluate(a, node, place, size) for a in args]
    s = [_string(x) for x in v]
    own = s[0] if s else string_value(node)
    calls = {
        "position": lambda: float(place),
        "last": lambda: float(size),
        "count": lambda: float(len(v[0])),
        "not": lambda: not _boolean(v[0]),
        "true": lambda: True,
        "false": lambda: False,
        "boolean": lambda: _boolean(v[0]),
        "number": lambda: _number(v[0] if v else string_value(node)),
        "string": lambda: own,
        "contains": lambda: s[1] in s[0],
        "starts-with": lambda: s[0].startswith(s[1]),
        "ends-with": lambda: s[0].endswith(s[1]),
        "normalize-space": lambda: normal(own),
        "string-length": lambda: float(len(own)),
        "concat": lambda: "".join(s),
        "substring-before": lambda: s[0].partition(s[1])[0] if s[1] in s[0] else "",
        "substring-after": lambda: s[0].partition(s[1])[2] if s[1] in s[0] else "",
        "substring": lambda: "".join(c for i, c in enumerate(s[0], 1) if i >= round(_number(v[1])) and (len(v) < 3 or i < round(_number(v[1])) + round(_number(v[2])))),
        "translate": lambda: "".join(c if (k := s[1].find(c)) < 0 else s[2][k : k + 1] for c in s[0]),
        "name": lambda: (v[0][0] if v and v[0] else node).tag if not (v and not v[0]) else "",
        "local-name": lambda: (v[0][0] if v and v[0] else node).tag if not (v and not v[0]) else "",
        "sum": lambda: sum(_number(string_value(x)) for x in v[0]),
        "floor": lambda: float(_number(v[0]) // 1),
        "ceiling": lambda: float(-(-_number(v[0]) // 1)),
        "round": lambda: float((_number(v[0]) + 0.5) // 1),
    }
    if name not in calls:
        raise InvalidXPath(name)
    try:
        return calls[name]()
    except (IndexError, TypeError, AttributeError) as e:
        raise InvalidXPath(name) from e


def _filtered(nodes: list, predicates: list) -> list:
    for p in predicates:
        kept = []
        for i, n in enumerate(nodes, 1):
            v = evaluate(p, n, i, len(nodes))
            if v == i if isinstance(v, float) else _boolean(v):
                kept.append(n)
        nodes = kept
    return nodes


def evaluate(e: tuple, node: Node | Attr, place: int = 1, size: int = 1) -> Any:
    kind = e[0]
    if kind == "lit":
        return e[1]
    if kind == "neg":
        return -_number(evaluate(e[1], node, place, size))
    if kind == "call":
        return _call(e[1], e[2], node, place, size)
    if kind == "root":
        top = node.parent if isinstance(node, Attr) else node
        while top.parent is not None:
            top = top.parent
        return [top]
    if kind == "here":
        return [node]
    if kind == "op":
        op = e[1]
        if op in ("or", "and"):
            left = _boolean(evaluate(e[2], node, place, size))
            return left if left == (op == "or") else _boolean(evaluate(e[3], node, place, size))
        a, b = (evaluate(x, node, place, size) for x in e[2:])
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return _compare(op, a, b)
        x, y = _number(a), _number(b)
        if op in ("div", "mod") and y == 0:
            return float("nan")
        return {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "div": lambda: x / y, "mod": lambda: x - y * int(x / y)}[op]()
    if kind == "union":
        nodes = evaluate(e[1], node, place, size) + evaluate(e[2], node, place, size)
        return sorted({_order(n): n for n in nodes}.values(), key=_order)
    nodes = evaluate(e[1], node, place, size)
    for s in e[2]:
        if not isinstance(nodes, list):
            raise InvalidXPath("a path on a value")
        if s[0] == "filter":
            nodes = _filtered(nodes, s[1])
            continue
        _, axis, test, predicates = s
        out: dict[tuple[int, int], Any] = {}
        for n in nodes:
            for x in _filtered([x for x in _axis(n, axis) if _fits(x, axis, test)], predicates):
                out[_order(x)] = x
        nodes = [out[k] for k in sorted(out)]
    return nodes


def select(node: Node, expression: str) -> list[tuple[Node, str | None]]:
    """(element, value) pairs: values alone if any text or attribute has a non-empty one, elements
    otherwise. An expression whose result is no set of nodes gives its string at the root."""
    got = evaluate(compile_xpath(expression), node)
    if not isinstance(got, list):
        return [(node, _string(got))]
    values = [(x.parent, t) for x in got if isinstance(x, Attr) or x.kind == "text" if (t := normal(x.text))]
    return values or [(x, None) for x in got if isinstance(x, Node) and x.kind == "element"]
