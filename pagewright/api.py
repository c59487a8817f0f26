"""One page in the driver: documents, elements and selections, for interactive use and callbacks."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

from pagewright.dom import tree
from pagewright.operators import views
from pagewright.select import css as css_
from pagewright.select import translate
from pagewright.select import xpath as xpath_


class Element:
    """An element of a document."""

    def __init__(self, node: tree.Node) -> None:
        self.node = node

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Element) and other.node is self.node

    def __hash__(self) -> int:
        return id(self.node)

    tag = property(lambda self: self.node.tag)
    text = property(lambda self: tree.full_text(self.node))
    own_text = property(lambda self: tree.direct_text(self.node))
    html = property(lambda self: tree.outer_html(self.node))
    attributes = property(lambda self: dict(self.node.attrs))
    depth = property(lambda self: self.node.depth)

    def attr(self, name: str) -> str | None:
        return self.node.attr(name)

    def has_class(self, name: str) -> bool:
        return name in (self.node.attr("class") or "").split()

    def css(self, selector: str) -> Selection:
        return Selection.of_css(self.node, selector)

    def xpath(self, expression: str) -> Selection:
        return Selection.of_xpath(self.node, expression)

    @property
    def parent(self) -> Element | None:
        return next((Element(n) for n in self.node.ancestors()), None)

    @property
    def children(self) -> list[Element]:
        return [Element(n) for n in self.node.elements()]

    @property
    def siblings(self) -> list[Element]:
        return [Element(n) for n in self.node.siblings() if n is not self.node]

    @property
    def ancestors(self) -> list[Element]:
        return [Element(n) for n in self.node.ancestors()]

    def _beside(self, step: int) -> Element | None:
        same = self.node.siblings()
        at = next(i for i, s in enumerate(same) if s is self.node) + step
        return Element(same[at]) if 0 <= at < len(same) else None

    next = property(lambda self: self._beside(1))
    previous = property(lambda self: self._beside(-1))

    def find_ancestor(self, test: Callable[[Element], bool]) -> Element | None:
        return next((a for a in self.ancestors if test(a)), None)

    def css_selector(self, full: bool = False) -> str:
        return translate.generated(self.node, True, full)

    def xpath_selector(self, full: bool = False) -> str:
        return translate.generated(self.node, False, full)


class Selection:
    """Elements in order, with a value each where texts or attributes were asked for."""

    def __init__(self, rows: list[tuple[tree.Node, str | None]]) -> None:
        self.rows = rows

    @classmethod
    def of_css(cls, root: tree.Node, selector: str) -> Selection:
        try:
            return cls([(n, v) for _, n, v in css_.select(root, selector)])
        except css_.InvalidSelector:
            return cls([])

    @classmethod
    def of_xpath(cls, root: tree.Node, expression: str) -> Selection:
        try:
            return cls(xpath_.select(root, expression))
        except xpath_.InvalidXPath:
            return cls([])

    def __len__(self) -> int:
        return len(self.rows)

    def __iter__(self) -> Iterator[Element]:
        return (Element(n) for n, _ in self.rows)

    def __add__(self, other: Selection) -> Selection:
        return Selection(self.rows + other.rows)

    @property
    def first(self) -> Element | None:
        return Element(self.rows[0][0]) if self.rows else None

    def get_all(self) -> list[str]:
        return [tree.outer_html(n) if v is None else v for n, v in self.rows]

    def get(self, default: str = "") -> str:
        return next(iter(self.get_all()), default)

    @property
    def text(self) -> str:
        return "\n".join(t for t in (tree.full_text(n) if v is None else v for n, v in self.rows) if t)

    def filter(self, test: Callable[[Element], bool]) -> Selection:
        return Selection([(n, None) for n, _ in self.rows if test(Element(n))])

    def search(self, test: Callable[[Element], bool]) -> Element | None:
        return next((e for e in self if test(e)), None)

    def regex(self, pattern: str) -> list[str]:
        """Matches in all values (markup for elements), all groups of each, unescaped."""
        out = []
        for text in self.get_all():
            for m in re.finditer(pattern, text):
                out += [html.unescape(g or "") for g in (m.groups() or (m[0],))]
        return out

    def regex_first(self, pattern: str, default: str = "") -> str:
        return next(iter(self.regex(pattern)), default)

    def json(self) -> Any:
        return json.loads(self.get())


class Document:
    """A parsed page."""

    def __init__(self, source: str | None, url: str = "") -> None:
        self.root, self.url = tree.parse(source), url

    def css(self, selector: str) -> Selection:
        return Selection.of_css(self.root, selector)

    def xpath(self, expression: str) -> Selection:
        return Selection.of_xpath(self.root, expression)

    def find_all(self, text: str, partial: bool = False, case: bool = False) -> Selection:
        """Elements by their own text; any case unless told otherwise."""
        fold = (lambda s: s) if case else str.lower
        want = fold(tree.normal(text))
        found = ((n, fold(tree.direct_text(n))) for n in self.root.walk() if n.kind == "element")
        return Selection([(n, None) for n, t in found if (want in t if partial else want == t)])

    def find_regex(self, pattern: str, case: bool = False) -> Selection:
        p = re.compile(pattern, 0 if case else re.I)
        return Selection([(n, None) for n in self.root.walk() if n.kind == "element" and p.search(tree.direct_text(n))])

    @property
    def html(self) -> str:
        return tree.outer_html(self.root)

    @property
    def markdown(self) -> str:
        return views.markdown(self.root)

    @property
    def opengraph(self) -> dict[str, str]:
        return views.opengraph(self.root)

    @property
    def jsonld(self) -> list[Any]:
        return [json.loads(t) for t in views.jsonld(self.root)]


def parse(source: str | None, url: str = "") -> Document:
    return Document(source, url)


def render(document: Document, name: str, selector: str = "") -> str:
    """A document, or a selection of it, as the extension of a file name tells: markup for html and htm,
    Markdown for md, text for txt and none; another extension is an error."""
    extension = name.rpartition(".")[2].lower() if "." in name else ""
    chosen = document.css(selector) if selector else None
    if extension in ("html", "htm"):
        return "\n".join(chosen.get_all()) if chosen is not None else document.html
    if extension == "md":
        return document.markdown if chosen is None else "\n\n".join(views.markdown(e.node) for e in chosen)
    if extension in ("txt", ""):
        return chosen.text if chosen is not None else document.css("body").text
    raise ValueError(f"unknown extension {extension}")
