"""HTML to a tree, for one page.

A subset of the HTML standard's tree construction that covers what pages in bulk contain: implied
``html``/``head``/``body``, void and raw-text elements, implied end tags, re-opening of unclosed
formatting elements in the next block, tables with content moved out in front of them, and entity
decoding. It never fails: malformed markup gives some tree.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())
FORMAT = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start tag ends an open paragraph.
ENDS_P = HEADINGS | frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: Start tag -> open elements that it ends, and where the search for them stops.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir body table td th".split())),
    "dd": (frozenset("dd dt".split()), frozenset("dl body td th".split())),
    "dt": (frozenset("dd dt".split()), frozenset("dl body td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist optgroup body".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset("select body".split())),
    "tr": (frozenset("tr td th".split()), frozenset("table tbody thead tfoot body".split())),
    "td": (frozenset("td th".split()), frozenset("tr table body".split())),
    "th": (frozenset("td th".split()), frozenset("tr table body".split())),
    "tbody": (frozenset("tbody thead tfoot tr td th".split()), frozenset("table body".split())),
    "thead": (frozenset("tbody thead tfoot tr td th".split()), frozenset("table body".split())),
    "tfoot": (frozenset("tbody thead tfoot tr td th".split()), frozenset("table body".split())),
}
_SCOPE = frozenset("applet caption html table td th marquee object template body".split())
_IN_TABLE = frozenset("table tbody thead tfoot tr".split())
_TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th table script style template input".split())

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|--!>|\Z)|<!(?P<decl>[^>]*)>|<\?(?P<pi>[^>]*)>|</(?P<end>[A-Za-z][^\s/>]*)[^>]*>"
    r"|<(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """An element, text, comment or doctype. ``attrs`` keeps duplicates in order."""

    __slots__ = ("kind", "tag", "attrs", "text", "parent", "children", "pre", "last", "depth")

    def __init__(self, kind: str, tag: str = "", attrs: list[tuple[str, str]] | None = None, text: str = "") -> None:
        self.kind, self.tag, self.attrs, self.text = kind, tag, attrs or [], text
        self.parent: Node | None = None
        self.children: list[Node] = []
        self.pre = self.last = self.depth = -1

    def append(self, child: Node) -> None:
        child.parent = self
        if child.kind == "text" and self.children and self.children[-1].kind == "text":
            self.children[-1].text += child.text
        else:
            self.children.append(child)

    def attr(self, name: str) -> str | None:
        """The first attribute of that name; none if there is none."""
        name = name.lower()
        return next((v for k, v in self.attrs if k == name), None)

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def walk(self) -> Iterator[Node]:
        """This node and all below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def ancestors(self) -> Iterator[Node]:
        node = self.parent
        while node is not None and node.kind == "element":
            yield node
            node = node.parent

    def siblings(self) -> list[Node]:
        """Element children of the parent, this one included."""
        return self.parent.elements() if self.parent is not None else [self]


class _Open(list):
    """Open elements, with how many there are of each tag, so that looking for one that isn't there costs
    nothing however deep a page nests."""

    def __init__(self, nodes: list[Node] = ()) -> None:
        super().__init__(nodes)
        self.tags: dict[str, int] = {}
        for x in self:
            self.tags[x.tag] = self.tags.get(x.tag, 0) + 1

    def append(self, x: Node) -> None:
        super().append(x)
        self.tags[x.tag] = self.tags.get(x.tag, 0) + 1

    def pop(self) -> Node:
        x = super().pop()
        self.tags[x.tag] -= 1
        return x

    def cut(self, i: int) -> None:
        """Close all from place i on."""
        while len(self) > i:
            self.pop()

    def any(self, tags: Iterable[str]) -> bool:
        return any(self.tags.get(t) for t in tags)


class _Builder:
    def __init__(self) -> None:
        self.root = Node("document")
        self.open = _Open()
        self.formatting: list[tuple[str, list[tuple[str, str]]]] = []
        self.head: Node | None = None
        self.body: Node | None = None
        self.html: Node | None = None

    # the three elements that are always there
    def ensure_html(self, attrs: list[tuple[str, str]] | None = None) -> Node:
        if self.html is None:
            self.html = Node("element", "html", attrs)
            self.root.append(self.html)
            self.open = _Open([self.html])
        elif attrs:
            self.html.attrs += [a for a in attrs if self.html.attr(a[0]) is None]
        return self.html

    def ensure_head(self) -> Node:
        top = self.ensure_html()
        if self.head is None:
            self.head = Node("element", "head")
            top.append(self.head)
            self.open = _Open([top, self.head])
        return self.head

    def ensure_body(self, attrs: list[tuple[str, str]] | None = None) -> Node:
        self.ensure_head()
        if self.body is None:
            self.body = Node("element", "body", attrs)
            self.html.append(self.body)
            self.open = _Open([self.html, self.body])
        elif attrs:
            self.body.attrs += [a for a in attrs if self.body.attr(a[0]) is None]
        return self.body

    def place(self, node: Node) -> None:
        """Insert at the current place, or in front of a table that can't hold the node."""
        here = self.open[-1]
        if here.tag in _IN_TABLE and not (node.kind == "comment" or node.tag in _TABLE_PARTS or node.kind == "text" and not node.text.strip()):
            table = next((x for x in reversed(self.open) if x.tag == "table"), None)
            if table is not None and table.parent is not None:
                around = table.parent
                at = around.children.index(table)
                node.parent = around
                if node.kind == "text" and at and around.children[at - 1].kind == "text":
                    around.children[at - 1].text += node.text
                else:
                    around.children.insert(at, node)
                return
        here.append(node)

    def reopen(self) -> None:
        """Open again the formatting elements that are active but no longer open."""
        if not self.formatting:
            return
        opened = [x.tag for x in self.open]
        for tag, attrs in list(self.formatting):
            if tag in opened:
                opened.remove(tag)
            else:
                node = Node("element", tag, list(attrs))
                self.place(node)
                self.open.append(node)

    def close_to(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        if not self.open.any(tags):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                self.open.cut(i)
                return
            if self.open[i].tag in stop:
                return

    def close_p(self) -> None:
        self.close_to(frozenset(["p"]), _SCOPE)

    def start(self, tag: str, attrs: list[tuple[str, str]], closed: bool) -> None:
        if tag == "html":
            self.ensure_html(attrs)
            return
        if tag == "head":
            self.ensure_head().attrs += attrs
            return
        if tag == "body":
            self.ensure_body(attrs)
            return
        if tag in HEAD and self.body is None:
            self.ensure_head()
        else:
            self.ensure_body()
            if tag in ENDS_P:
                self.close_p()
            if tag in HEADINGS and self.open[-1].tag in HEADINGS:
                self.open.pop()
            if tag in IMPLIED:
                ends, stop = IMPLIED[tag]
                while self.open.any(ends) and any(x.tag in ends for x in self.open[self.depth_of(stop) :]):
                    self.close_to(ends, stop)
            if tag == "a" and any(t == "a" for t, _ in self.formatting):
                self.end("a")
            if tag in ("td", "th") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
                self.start("tr", [], False)
            if tag == "tr" and self.open[-1].tag == "table":
                self.start("tbody", [], False)
            if tag not in ENDS_P and tag not in IMPLIED and tag not in _TABLE_PARTS:
                self.reopen()
        node = Node("element", tag, attrs)
        self.place(node)
        if tag in VOID or closed and tag in ("svg", "path", "math"):
            return
        self.open.append(node)
        if tag in FORMAT:
            self.formatting.append((tag, attrs))

    def depth_of(self, stop: frozenset[str]) -> int:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag in stop:
                return i + 1
        return 0

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "head":
            if self.head is not None and self.open[-1:] == [self.head]:
                self.open.pop()
            return
        if tag == "br":
            self.start("br", [], False)
            return
        if tag == "p" and not self.open.tags.get("p"):
            self.ensure_body()
            self.place(Node("element", "p"))
            return
        if tag in FORMAT:
            for i in range(len(self.formatting) - 1, -1, -1):
                if self.formatting[i][0] == tag:
                    del self.formatting[i]
                    break
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag == tag:
                    # elements opened inside stay open only if they are formatting (they reopen) or blocks
                    inner = [x for x in self.open[i + 1 :] if x.tag not in FORMAT]
                    self.open.cut(i)
                    for x in inner:
                        self.open.append(x)
                    return
            return
        if not self.open.tags.get(tag) and tag not in HEADINGS:
            return
        stop = _SCOPE - {tag} if tag != "table" else frozenset(["html", "body"])
        for i in range(len(self.open) - 1, 0, -1):
            own = self.open[i].tag
            if own == tag or tag in HEADINGS and own in HEADINGS:
                self.open.cut(i)
                return
            if own in stop:
                return

    def text(self, text: str) -> None:
        if self.body is None:
            if not text.strip():
                if self.head is not None:
                    self.open[-1].append(Node("text", text=text))
                return
            if self.open and self.open[-1].tag in HEAD and self.open[-1].tag != "head":
                self.open[-1].append(Node("text", text=text))
                return
            self.ensure_body()
        if text.strip():
            self.reopen()
        self.place(Node("text", text=text))


def parse(source: str | None) -> Node:
    """The document of a page. A null page is an empty one: html, head and body without content."""
    b = _Builder()
    source = (source or "").replace("\r\n", "\n").replace("\r", "\n").replace("\x00", "\ufffd")
    at = 0
    for m in iter(lambda: _TOKEN.search(source, at), None):
        if m.start() > at:
            b.text(html.unescape(source[at : m.start()]))
        at = m.end()
        if m["comment"] is not None:
            (b.open[-1] if b.open else b.root).append(Node("comment", text=m["comment"]))
        elif m["decl"] is not None:
            if m["decl"][:7].lower() == "doctype" and b.html is None:
                b.root.append(Node("doctype", m["decl"][7:].strip().lower()))
            elif m["decl"][:7].lower() != "doctype":
                (b.open[-1] if b.open else b.root).append(Node("comment", text=m["decl"]))
        elif m["pi"] is not None:
            (b.open[-1] if b.open else b.root).append(Node("comment", text="?" + m["pi"]))
        elif m["end"] is not None:
            if b.open:
                b.end(m["end"].lower())
        else:
            tag = m["start"].lower()
            raw = m["attrs"]
            closed = raw.rstrip().endswith("/")
            attrs = [(k.lower(), html.unescape(next((x for x in v if x is not None and x != ""), ""))) for k, *v in _ATTR.findall(raw.rstrip().removesuffix("/") if closed and not re.search(r"=\s*[^\s\"']*/$", raw.rstrip()) else raw)]
            b.start(tag, attrs, closed)
            if tag in RAW or tag in RCDATA:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else len(source)
                inner = source[at:stop]
                if inner and b.open and b.open[-1].tag == tag:
                    b.open[-1].append(Node("text", text=inner if tag in RAW else html.unescape(inner)))
                at = stop
                if b.open and b.open[-1].tag == tag and not end:
                    b.open.pop()
    if at < len(source):
        b.text(html.unescape(source[at:]))
    b.ensure_body()
    return number(b.root)


def number(root: Node) -> Node:
    """Number nodes in document order and give each the number of its last descendant; depth counts
    element ancestors."""
    n = 0
    todo: list[tuple[Node, int, bool]] = [(root, 0, False)]
    while todo:
        node, depth, done = todo.pop()
        if done:
            node.last = n - 1
            continue
        node.pre, node.depth = n, depth
        n += 1
        todo.append((node, depth, True))
        inner = depth + (node.kind == "element")
        todo.extend((c, inner, False) for c in reversed(node.children))
    return root


_SPACE = re.compile(r"\s+")


def normal(text: str) -> str:
    """White space runs to one blank, trimmed."""
    return " ".join(text.split())


def full_text(node: Node) -> str:
    """All text below, each piece normalised, joined by one blank; script and style included."""
    return " ".join(t for t in (normal(x.text) for x in node.walk() if x.kind == "text") if t)


def direct_text(node: Node, clean: bool = True) -> str:
    """The node's own text pieces."""
    own = [c.text for c in node.children if c.kind == "text"]
    return " ".join(t for t in map(normal, own) if t) if clean else "".join(own).strip()


_ESCAPE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"})


def outer_html(node: Node) -> str:
    """Markup of a node and all below; void elements end with a slash, quotes are numeric."""
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.kind == "text":
            out.append(x.text if x.parent is not None and x.parent.tag in RAW else x.text.translate(_ESCAPE))
        elif x.kind == "comment":
            out.append(f"<!--{x.text}-->")
        elif x.kind == "doctype":
            out.append(f"<!DOCTYPE {x.tag}>")
        elif x.kind == "document":
            todo.extend(reversed(x.children))
        else:
            out.append("<" + x.tag + "".join(f' {k}="{v.translate(_ESCAPE)}"' for k, v in x.attrs) + ("/>" if x.tag in VOID else ">"))
            if x.tag not in VOID:
                todo.append(f"</{x.tag}>")
                todo.extend(reversed(x.children))
    return "".join(out)


def nth_of_type(node: Node) -> int:
    """Place among siblings of the same tag, from 1."""
    return next(i for i, x in enumerate((s for s in node.siblings() if s.tag == node.tag), 1) if x is node)


def absolute_xpath(node: Node) -> str:
    """``/html[1]/body[1]/...`` with the index on every step."""
    return "".join(f"/{x.tag}[{nth_of_type(x)}]" for x in [*reversed(list(node.ancestors())), node])
