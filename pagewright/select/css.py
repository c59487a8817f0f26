"""CSS selectors: parsing and matching on a page's tree.

A selector list is split at top-level commas; its branches are matched one after the other and their
results follow each other without removing repeats. Each branch may end with ``::text`` (the direct
text pieces) or ``::attr(name)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

from pagewright.dom.tree import Node, full_text, normal


class InvalidSelector(ValueError):
    """A selector that can't be read."""


Test = Callable[[Node], bool]


@dataclass(frozen=True)
class Branch:
    """Compound tests from left to right with the combinator before each, and the value asked for."""

    steps: tuple[tuple[str, tuple[Test, ...]], ...]
    value: str | None = None  # None, "text" or "attr:name"


_IDENT = r"-?(?:[_A-Za-z\u0080-\U0010ffff]|\\[0-9a-fA-F]{1,6}\s?|\\.)(?:[\w\u0080-\U0010ffff-]|\\[0-9a-fA-F]{1,6}\s?|\\.)*"
_NAME = re.compile(_IDENT)
_ATTR = re.compile(rf"\[\s*({_IDENT}(?::{_IDENT})?)\s*(?:([~|^$*!]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|({_IDENT}|[\w./:-]+))\s*(i)?\s*)?\]")
_NTH = re.compile(r"^\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$")


def unescape(ident: str) -> str:
    return re.sub(r"\\(?:([0-9a-fA-F]{1,6})\s?|(.))", lambda m: chr(int(m[1], 16)) if m[1] else m[2], ident)


def split_list(selector: str) -> list[str]:
    """Branches of a selector list; commas inside brackets, parentheses and quotes don't count."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(selector):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and not depth:
            out.append(selector[start:i])
            start = i + 1
    out.append(selector[start:])
    return [x.strip() for x in out]


def _nth(spec: str) -> tuple[int, int]:
    m = _NTH.match(spec.lower())
    if not m:
        raise InvalidSelector(spec)
    if m[1]:
        return 2, 1 if m[1] == "odd" else 0
    if m[5] is not None:
        return 0, int(m[5])
    a = {"": 1, "+": 1, "-": -1}.get(m[2])
    return int(m[2]) if a is None else a, int((m[3] or "+") + (m[4] or "0"))


def _nth_test(spec: str, of_type: bool, last: bool) -> Test:
    a, b = _nth(spec)

    def test(n: Node) -> bool:
        same = [s for s in n.siblings() if not of_type or s.tag == n.tag]
        i = next(k for k, s in enumerate(reversed(same) if last else same, 1) if s is n)
        return i == b if a == 0 else (i - b) % a == 0 and (i - b) // a >= 0

    return test


def _attr_test(name: str, op: str | None, want: str, ignore: bool) -> Test:
    name = name.lower()
    fold = (lambda s: s.lower()) if ignore else (lambda s: s)
    want = fold(want)

    def test(n: Node) -> bool:
        got = n.attr(name)
        if op == "!=":
            return got is None or fold(got) != want
        if got is None:
            return False
        got = fold(got)
        return {
            None: lambda: True,
            "=": lambda: got == want,
            "~=": lambda: bool(want) and want in got.split(),
            "|=": lambda: got == want or got.startswith(want + "-"),
            "^=": lambda: bool(want) and got.startswith(want),
            "$=": lambda: bool(want) and got.endswith(want),
            "*=": lambda: bool(want) and want in got,
        }[op]()

    return test


def _pseudo(name: str, arg: str | None) -> Test:
    plain: dict[str, Test] = {
        "first-child": lambda n: n.siblings()[0] is n,
        "last-child": lambda n: n.siblings()[-1] is n,
        "only-child": lambda n: len(n.siblings()) == 1,
        "first-of-type": _nth_test("1", True, False),
        "last-of-type": _nth_test("1", True, True),
        "only-of-type": lambda n: sum(s.tag == n.tag for s in n.siblings()) == 1,
        "empty": lambda n: all(c.kind == "comment" for c in n.children),
        "root": lambda n: n.parent is None or n.parent.kind == "document",
    }
    if arg is None:
        if name in plain:
            return plain[name]
        raise InvalidSelector(f":{name}")
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        return _nth_test(arg, "of-type" in name, "last" in name)
    if name in ("contains", "containsown"):
        want = arg.strip().strip("\"'")
        return (lambda n: want in full_text(n)) if name == "contains" else (lambda n: want in "".join(c.text for c in n.children if c.kind == "text"))
    if name in ("not", "is", "where", "matches"):
        inner = [parse_branch(x) for x in split_list(arg)]
        return (lambda n: not any(matches(n, b) for b in inner)) if name == "not" else (lambda n: any(matches(n, b) for b in inner))
    if name == "has":
        inner = [parse_branch(x) for x in split_list(arg)]
        return lambda n: any(x is not n and x.kind == "element" and matches(x, b) for b in inner for x in n.walk())
    raise InvalidSelector(f":{name}()")


def _closing(text: str, i: int) -> int:
    """The place of the parenthesis that closes the one before i."""
    depth, quote = 1, ""
    for j in range(i, len(text)):
        c = text[j]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return j
    raise InvalidSelector(text)


def _split_value(branch: str) -> tuple[str, str | None]:
    m = re.search(r"::([\w-]+)(\(.*\))?\s*$", branch)
    if not m:
        if "::" in re.sub(r"\"[^\"]*\"|'[^']*'|\[[^\]]*\]", "", branch):
            raise InvalidSelector(branch)
        return branch, None
    if m[1] == "text" and m[2] is None:
        return branch[: m.start()], "text"
    if m[1] == "attr" and m[2]:
        name = m[2][1:-1].strip()
        if len(name) > 1 and name[0] == name[-1] and name[0] in "\"'":
            name = name[1:-1]
        if name and not re.search(r"\s", name):
            return branch[: m.start()], "attr:" + name.lower()
    raise InvalidSelector(branch)


@lru_cache(maxsize=2048)
def parse_branch(branch: str) -> Branch:
    text, value = _split_value(branch)
    text = text.strip() or ("*" if value else "")
    steps: list[tuple[str, tuple[Test, ...]]] = []
    tests: list[Test] = []
    combinator, i, need = " ", 0, True
    while i < len(text):
        c = text[i]
        if m := re.match(r"\s*([>+~])\s*|\s+", text[i:]):
            if need and m[1]:
                raise InvalidSelector(branch)
            if not need:
                steps.append((combinator, tuple(tests)))
                tests, combinator, need = [], m[1] or " ", True
            i += m.end()
            continue
        if c == "*":
            i += 1
            tests.append(lambda n: True)
        elif c in "#." and (m := _NAME.match(text, i + 1)):
            want = unescape(m[0])
            tests.append((lambda n, w=want: n.attr("id") == w) if c == "#" else (lambda n, w=want: w in (n.attr("class") or "").split()))
            i = m.end()
        elif c == "[" and (m := _ATTR.match(text, i)):
            tests.append(_attr_test(unescape(m[1]), m[2], next((x for x in m.group(3, 4, 5) if x is not None), ""), bool(m[6])))
            i = m.end()
        elif c == ":" and (m := _NAME.match(text, i + 1)):
            i, arg = m.end(), None
            if text[i : i + 1] == "(":
                end = _closing(text, i + 1)
                arg, i = text[i + 1 : end], end + 1
            tests.append(_pseudo(m[0].lower(), arg))
        elif m := _NAME.match(text, i):
            want = unescape(m[0]).lower()
            tests.append(lambda n, w=want: n.tag == w)
            i = m.end()
        else:
            raise InvalidSelector(branch)
        need = False
    if need:
        raise InvalidSelector(branch)
    steps.append((combinator, tuple(tests)))
    return Branch(tuple(steps), value)


def matches(node: Node, branch: Branch) -> bool:
    """Whether the branch selects the element."""

    def step(n: Node | None, k: int) -> bool:
        if n is None or n.kind != "element" or not all(t(n) for t in branch.steps[k][1]):
            return False
        if k == 0:
            return True
        how = branch.steps[k][0]
        if how == ">":
            return step(n.parent, k - 1)
        if how == " ":
            return any(step(a, k - 1) for a in n.ancestors())
        same = n.siblings()
        at = next(i for i, s in enumerate(same) if s is n)
        return (at > 0 and step(same[at - 1], k - 1)) if how == "+" else any(step(s, k - 1) for s in same[:at])

    return step(node, len(branch.steps) - 1)


def select(root: Node, selector: str) -> Iterator[tuple[int, Node, str | None]]:
    """(branch, element, value) in branch and document order; value is none for plain branches.
    An element comes once for each of its text pieces under ``::text``."""
    for i, text in enumerate(split_list(selector)):
        branch = parse_branch(text)
        for n in root.walk():
            if n.kind != "element" or n is root or not matches(n, branch):
                continue
            if branch.value is None:
                yield i, n, None
            elif branch.value == "text":
                for c in n.children:
                    if c.kind == "text" and (t := normal(c.text)):
                        yield i, n, t
            else:
                got = n.attr(branch.value[5:])
                if got is not None:
                    yield i, n, got
