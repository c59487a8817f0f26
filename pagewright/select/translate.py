"""CSS to XPath, and selectors that find an element again."""

from __future__ import annotations

import re

from pagewright.dom.tree import Node, nth_of_type
from pagewright.select.css import InvalidSelector, split_list

_PART = re.compile(r"([A-Za-z][\w-]*|\*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:(\*?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([\w-]+))\s*)?\]")
_VALUE = re.compile(r"::(?:text|attr\(\s*[\"']?([\w:-]+)[\"']?\s*\))\s*$")


def literal(value: str) -> str:
    """A string as an XPath expression."""
    if "'" not in value:
        return f"'{value}'"
    if '"' not in value:
        return f'"{value}"'
    return "concat(" + ", \"'\", ".join(f"'{x}'" for x in value.split("'")) + ")"


def _compound(text: str) -> str:
    tag, tests, i = "*", [], 0
    while i < len(text):
        m = _PART.match(text, i)
        if not m or m[1] and i:
            raise InvalidSelector(text)
        if m[1]:
            tag = m[1]
        elif m[2]:
            tests.append(f"contains(concat(' ', normalize-space(@class), ' '), {literal(f' {m[2]} ')})")
        elif m[3]:
            tests.append(f"@id = {literal(m[3])}")
        else:
            want = next((x for x in m.group(6, 7, 8) if x is not None), None)
            tests.append(f"@{m[4]}" if m[5] is None else f"@{m[4]} = {literal(want)}" if m[5] == "=" else f"contains(@{m[4]}, {literal(want)})")
        i = m.end()
    if not text:
        raise InvalidSelector(text)
    return tag + "".join(f"[{t}]" for t in tests)


def css_to_xpath(selector: str) -> str:
    """Tags, ``*``, classes, ids, ``[a]``, ``[a=v]``, ``[a*=v]``, descendants, children, lists,
    ``::text`` and ``::attr(n)``; anything else is an invalid selector."""
    out = []
    for branch in split_list(selector):
        m = _VALUE.search(branch)
        tail = ("/text()" if m[1] is None else f"/@{m[1]}") if m else ""
        text = re.sub(r"\s*>\s*", " > ", branch[: m.start()] if m else branch).strip()
        path, how = "", "//"
        for part in re.findall(r"(?:\[[^\]]*\]|[^\s\[])+", text):
            if part == ">":
                how = "/"
                continue
            path += how + _compound(part)
            how = "//"
        if not path or how == "/":
            raise InvalidSelector(branch)
        out.append(path + tail)
    return " | ".join(out)


def css_identifier(value: str) -> str:
    """An identifier for CSS; other characters, and a digit in front, as hexadecimal escapes."""
    return "".join(c if c.isascii() and (c.isalpha() or c in "_-" or c.isdigit() and i) or not c.isascii() else f"\\{ord(c):X} " for i, c in enumerate(value))


def generated(node: Node, css: bool, full: bool = False) -> str:
    """A selector that leads to the element: from the nearest ancestor with an id, or from the body
    if ``full``. Places are given where an element isn't the first of its tag."""
    steps: list[str] = []
    for x in [node, *node.ancestors()]:
        if x.tag == "html":
            break
        ident = x.attr("id")
        if ident and not full:
            steps.append(f"#{css_identifier(ident)}" if css else f"//*[@id={literal(ident)}]")
            break
        n = nth_of_type(x)
        steps.append(x.tag if n == 1 else f"{x.tag}:nth-of-type({n})" if css else f"{x.tag}[{n}]")
    steps.reverse()
    if css:
        return " > ".join(steps)
    head = steps[0] if steps else ""
    return "/".join(steps) if head.startswith("//*") else "//" + "/".join(steps)
