"""Views of rendered pages: Markdown, links, semantic nodes, structured data, cleaned main content."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from pagewright.dom import tree
from pagewright.dom.nodes import per_page
from pagewright.dom.tree import Node, normal

#: Elements that Markdown leaves out, and those that the semantic view leaves out (fixed values).
NOT_MARKDOWN = frozenset("script style noscript template svg nav header footer aside".split())
NOT_SEMANTIC = frozenset("script style noscript template svg".split())
NOT_CONTENT = NOT_MARKDOWN
_TIGHT = re.compile(r" ([.,!?;:])")
ZERO_WIDTH = dict.fromkeys(map(ord, "​‌‍⁠﻿"))


def tight(text: str) -> str:
    return _TIGHT.sub(r"\1", normal(text))


def inline(node: Node, inside: bool = False) -> str:
    """Text of a node with its links; ``inside`` leaves the node's own link mark out."""
    if node.kind == "text":
        return f" {node.text} "
    if node.kind != "element" or node.tag in NOT_MARKDOWN:
        return ""
    if node.tag == "a" and not inside:
        label, href = tight(inline(node, True)), node.attr("href")
        if label and href:
            return f" [{label}]({href}) "
    return "".join(map(inline, node.children))


def markdown(root: Node) -> str:
    """Headings, paragraphs and list items as blocks; a block inside another is inlined in it."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.kind == "element" and n.tag in NOT_MARKDOWN:
            continue
        lead = "#" * int(n.tag[1]) + " " if n.tag in tree.HEADINGS else {"p": "", "li": "- "}.get(n.tag)
        if n.kind == "element" and lead is not None:
            if block := tight(lead + tight(inline(n))):
                out.append(block)
            continue
        todo.extend(reversed(n.children))
    return "\n\n".join(out)


def visible_text(node: Node) -> str:
    return tight(" ".join(n.text for n in _visible(node) if n.kind == "text"))


def _visible(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        if n.kind != "element" or n.tag not in NOT_SEMANTIC:
            yield n
            todo.extend(reversed(n.children))


def accessible_name(node: Node, labels: dict[str, str], text: str) -> str:
    for a in ("aria-label", "title", "alt", "placeholder"):
        if got := normal(node.attr(a) or ""):
            return got
    if got := labels.get(node.attr("id") or ""):
        return got
    return (node.tag == "button" and normal(node.attr("value") or "")) or text


def semantic(root: Node) -> Iterator[tuple]:
    """(id, role, tag, name, text, xpath, interactive, disabled, checked, value, href)"""
    labels = {n.attr("for"): visible_text(n) for n in root.walk() if n.tag == "label" and n.attr("for")}
    i = 0
    for n in _visible(root):
        if n.kind != "element":
            continue
        text = visible_text(n)
        name, value, href, checked = accessible_name(n, labels, text), "", "", False
        kind = (n.attr("type") or "text").lower() if n.tag == "input" else ""
        role = {"a": "link", "button": "button", "textarea": "textbox", "select": "combobox"}.get(n.tag) or ("heading" if n.tag in tree.HEADINGS else None)
        if n.tag == "input":
            value, checked = n.attr("value") or "", n.attr("checked") is not None
            role = kind if kind in ("checkbox", "radio") else "button" if kind in ("submit", "button") else "textbox"
            name = name or (value if role == "button" else "")
        if role is None or role in ("link", "heading") and not name or n.tag == "button" and not name:
            continue
        if n.tag == "a":
            href = n.attr("href") or ""
            if not href:
                continue
        if n.tag == "textarea":
            value = text
        i += 1
        yield i, role, n.tag, name, text, tree.absolute_xpath(n), role != "heading", n.attr("disabled") is not None, checked, value, href


def opengraph(root: Node) -> dict[str, str]:
    """og: properties of meta elements without their prefix; the last of a name counts."""
    found = {}
    for n in root.walk():
        if n.tag == "meta" and (p := (n.attr("property") or "").strip()).lower().startswith("og:"):
            found[p[3:]] = n.attr("content") or ""
    return found


def jsonld(root: Node, objects_only: bool = True) -> list[str]:
    """Texts of JSON-LD scripts in page order; only those that hold an object, if asked."""
    out = []
    for n in root.walk():
        if n.tag == "script" and (n.attr("type") or "").strip().lower() == "application/ld+json":
            text = "".join(c.text for c in n.children)
            if objects_only:
                try:
                    if not isinstance(json.loads(text), dict):
                        continue
                except (ValueError, RecursionError):
                    continue
            out.append(text)
    return out


def _hidden(n: Node) -> bool:
    style = re.sub(r"\s", "", (n.attr("style") or "").lower())
    return n.attr("hidden") is not None or (n.attr("aria-hidden") or "").lower() == "true" or n.tag == "input" and (n.attr("type") or "").lower() == "hidden" or "display:none" in style or "visibility:hidden" in style


def main_content(root: Node) -> Node:
    """The first main element, else the body, without comments, scripts, navigation, hidden elements
    and zero-width characters. The tree is changed."""
    todo = [root]
    while todo:
        n = todo.pop()
        n.children = [c for c in n.children if c.kind != "comment" and not (c.kind == "element" and (c.tag in NOT_CONTENT or _hidden(c)))]
        for c in n.children:
            if c.kind == "text":
                c.text = c.text.translate(ZERO_WIDTH)
        todo.extend(n.children)
    for want in ("main", "body"):
        found = next((n for n in root.walk() if n.tag == want), None)
        if found is not None:
            return found
    return root


def markdown_view(pages: DataFrame) -> DataFrame:
    """(page_id, markdown)"""
    return per_page(pages, "page_id long, markdown string", lambda i, u, r: [(i, markdown(r))])


def link_view(pages: DataFrame) -> DataFrame:
    """(page_id, ord, text, href) of links with both."""

    def rows(i: int, u: str | None, r: Node) -> Iterator[tuple]:
        found = ((visible_text(n), n.attr("href")) for n in r.walk() if n.tag == "a")
        yield from ((i, k, t, h) for k, (t, h) in enumerate(((t, h) for t, h in found if t and h), 1))

    return per_page(pages, "page_id long, ord int, text string, href string", rows)


def semantic_view(pages: DataFrame) -> DataFrame:
    """Semantic nodes; the interactive ones are ``where("interactive")``."""
    schema = "page_id long, id int, role string, tag string, name string, text string, xpath string, interactive boolean, disabled boolean, checked boolean, value string, href string"
    return per_page(pages, schema, lambda i, u, r: [(i, *x) for x in semantic(r)])


def opengraph_view(pages: DataFrame) -> DataFrame:
    """(page_id, key, value)"""
    return per_page(pages, "page_id long, key string, value string", lambda i, u, r: [(i, k, v) for k, v in opengraph(r).items()])


def jsonld_view(pages: DataFrame, objects_only: bool = True) -> DataFrame:
    """(page_id, ord, text)"""
    return per_page(pages, "page_id long, ord int, text string", lambda i, u, r: [(i, k, t) for k, t in enumerate(jsonld(r, objects_only))])


def evidence_view(pages: DataFrame) -> DataFrame:
    """(page_id, markdown, links, nodes, opengraph, jsonld) of each page: all views of one parse."""
    schema = (
        "page_id long, markdown string, links array<struct<text:string,href:string>>, nodes array<struct<id:int,role:string,tag:string,name:string,interactive:boolean>>,"
        "opengraph map<string,string>, jsonld array<string>"
    )

    def rows(i: int, u: str | None, r: Node) -> list[tuple]:
        found = ((visible_text(n), n.attr("href")) for n in r.walk() if n.tag == "a")
        nodes = [{"id": x[0], "role": x[1], "tag": x[2], "name": x[3], "interactive": x[6]} for x in semantic(r)]
        return [(i, markdown(r), [{"text": t, "href": h} for t, h in found if t and h], nodes, list(opengraph(r).items()), jsonld(r))]

    return per_page(pages, schema, rows)


def cleaned_view(pages: DataFrame) -> DataFrame:
    """(page_id, text, html) of each page's main content."""

    def rows(i: int, u: str | None, r: Node) -> list[tuple]:
        m = main_content(r)
        return [(i, tree.full_text(m), tree.outer_html(m))]

    return per_page(pages, "page_id long, text string, html string", rows)
