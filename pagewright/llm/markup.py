"""Markup residue: HTML, Markdown, wiki and LaTeX in texts, and clean text from it.

A text, however the four are mixed, is parsed into leaves, each with its root-to-leaf tag path
(``body/ul/li``), the construct steps by which it was reached (``html:b``, ``md:em``), its text and its
kind. Text length and punctuation are aggregated per path; both are divided by the number of leaves (the
path ratios), smoothed along the order in which paths first appear, and fused by their geometric mean.
Paths whose score reaches the threshold (a part of the mean over all leaves) are content nodes. Headings,
lists, code, tables, quotes and formulas are kept whatever their scores and however far from a content
path, so a block of them is never cut. Of the leaves below the threshold, those that say a sentence or lie
between content leaves are kept too, so short paragraphs stay; labels around the content go, as do scripts
and styles.

A record has markup if any leaf was reached by a construct step. Mere punctuation is none: a tag needs
a known name, mathematics between dollars needs no blank inside its ends and no digit behind it, and
emphasis needs word characters right inside and no word character outside.
"""

from __future__ import annotations

import html
import html.entities
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.session import spread, table

#: Part of the mean score that a content path has at least.
THRESHOLD = 0.25

# Names of HTML elements.
HTML_NAMES = frozenset(
    "a abbr address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog "
    "dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend "
    "li link main map mark math menu meta meter nav nobr noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section "
    "select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WIKI_TAGS = frozenset("ref references nowiki syntaxhighlight source math gallery includeonly noinclude onlyinclude poem".split())
_BLOCKS = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li table tr td th section article header footer nav aside main pre blockquote body html head title form dl dt dd figure figcaption br hr".split())
_LISTS = frozenset("ul ol menu dir".split())
_GONE = frozenset("script style template noscript head".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!(?:doctype|DOCTYPE)\b[^<>]*>|<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s+[^<>]*?|\s*)/?)>", re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")

#: Inline constructs: (family, tag, pattern); the first group that took part is the text that stays.
INLINE: list[tuple[str, str, re.Pattern]] = [
    ("md", "code", re.compile(r"(?<!`)(`+)(?!`)([^\n]+?)(?<!`)\1(?!`)")),
    ("latex", "math", re.compile(r"\\\((.+?)\\\)|(?<![\\$\w])\$(?![\s$])((?:[^$\n\\]|\\.)+?)(?<![\s\\])\$(?![\d$])|\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S)),
    ("wiki", "template", re.compile(r"\{\{()[^{}\n]*\}\}(?!\})")),
    ("wiki", "a", re.compile(r"\[\[(?:[^\[\]|\n]*\|)*([^\[\]|\n]*)\]\]|\[(?:https?|ftp|mailto):[^\s\]]*(?: ([^\]\n]*))?\]")),
    ("md", "img", re.compile(r"!\[([^\[\]\n]*)\](?:\([^()\n]*\)|\[[^\]\n]*\])")),
    ("md", "a", re.compile(r"\[((?:[^\[\]\n]|\[[^\[\]\n]*\])*)\](?:\((?:[^()\n]|\([^()\n]*\))*\)|\[[^\[\]\n]+\])|<((?:https?|ftp|mailto):[^\s<>]+)>")),
    ("md", "note", re.compile(r"\[\^()[^\[\]\s]+\]:?")),
    ("wiki", "b", re.compile(r"'''(?=\S)(.+?)(?<=\S)'''")),
    ("wiki", "i", re.compile(r"(?<!')''(?=[^\s'])(.+?)(?<=[^\s'])''(?!')")),
    ("md", "b", re.compile(r"(?<!\*)\*\*(?=[^\s*])(.+?)(?<=[^\s*])\*\*(?!\*)|(?<![\w_])__(?=[^\s_])(.+?)(?<=[^\s_])__(?![\w_])")),
    ("md", "em", re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_\\/.])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")),
    ("md", "s", re.compile(r"(?<!~)~~(?=\S)([^~\n]+?)(?<=\S)~~(?!~)")),
    ("latex", "arg", re.compile(r"\\(?:href|textcolor)\{[^{}]*\}\{([^{}]*)\}|\\(?:text[a-z]+|emph|underline|mbox|url|footnote|title|author|caption|chapter|paragraph|(?:sub)*section|part)\*?\{((?:[^{}]|\{[^{}]*\})*)\}")),
    ("latex", "ref", re.compile(r"\\(?:ref|eqref|cite[a-z]*|label|pageref|autoref|usepackage|documentclass|bibliography\w*|include\w*|input|begin|end)\*?(?:\[[^\]]*\])?\{()[^{}]*\}")),
    ("latex", "arg", re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]]*\])?\{([^{}]*)\}")),
    ("latex", "sym", re.compile(r"\\(?:LaTeX|TeX|ldots|dots|quad|qquad|newline|noindent|par|alpha|beta|gamma|delta|lambda|mu|pi|sigma|omega|cdot|times|leq|geq|approx|sum|int|infty|newpage|maketitle|tableofcontents|item|hline|centering)()(?![A-Za-z\\])|(?<=\s)\\\\()(?=\s|$)|\\([%&#_])(?=[\s\d])")),
    ("wiki", "switch", re.compile(r"__(?:NO)?(?:TOC|EDITSECTION|INDEX|GALLERY)__()")),
]

_FENCE = re.compile(r"^\s{0,3}(`{3,}|~{3,})\s*([\w+#.-]*)\s*$")
_ATX = re.compile(r"^\s{0,3}(#{1,6})\s+(\S.*?)\s*#*\s*$")
_WIKI_H = re.compile(r"^\s*(={1,6})(?!=)\s*([^=\s](?:.*?[^=\s])?)\s*\1\s*$")
_SETEXT = re.compile(r"^\s{0,3}(=+|-+)\s*$")
_RULE = re.compile(r"^\s{0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$")
_ITEM = re.compile(r"^(\s*)([-*+•]|\*{2,4}|#{2,4}(?=\s)|\d{1,3}[.)])\s+(\S.*)$")
_QUOTE = re.compile(r"^\s{0,3}>\s?(\S.*|)$")
_ROW = re.compile(r"^\s*\|?.*\|.*$")
_RULER = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)*\|?\s*$")
_ENV = re.compile(r"^\s*\\begin\{([a-zA-Z]+)\*?\}(?:\[[^\]]*\]|\{[^{}]*\})*(.*)$")
_SECTION = re.compile(r"^\s*\\(part|chapter|(?:sub){0,2}section|paragraph|title)\*?\{(.*)\}\s*$")
_REFDEF = re.compile(r"^\s{0,3}\[[^\]\n]+\]:\s*\S+")
_LEVEL = {"part": 1, "chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
_PUNCTUATION = re.compile(r"[.,;:!?。、，；：！？…]")


class Leaf(NamedTuple):
    """A text with its path. Kind "mark" is a construct without text (a comment, an empty element)."""

    path: str
    kind: str
    text: str
    depth: int = 0
    steps: tuple[str, ...] = ()


class Parser:
    """Leaves of one text."""

    def __init__(self) -> None:
        self.leaves: list[Leaf] = []
        self.stack: list[str] = []
        self.pending: list[str] = []  # construct steps since the last leaf
        self.counts: dict[int, int] = {}  # items of the list at a place of the stack
        self.fresh = False  # whether an item has no text yet
        self.row: list[str] | None = None  # cells of the open table row
        self.above = -1  # depth of the item before

    def mark(self, family: str, tag: str) -> None:
        self.pending.append(f"{family}:{tag}")

    # inline -----------------------------------------------------------------------------------
    def inline(self, text: str) -> str:
        """The text without inline constructs; formulas keep their source, code its content."""
        kept: list[str] = []

        def keep(x: str) -> str:
            kept.append(x)
            return f"\x00{len(kept) - 1}\x00"

        for family, tag, pattern in INLINE:

            def swap(m: re.Match, tag=tag, family=family) -> str:
                self.mark(family, tag)
                got = m[2] if tag == "code" else next((g for g in m.groups() if g is not None), "")
                return keep(f"${got.strip()}$") if tag == "math" else keep(got) if tag == "code" else got

            while True:  # constructs inside others; each pass takes signs away, so it ends
                new = pattern.sub(swap, text)
                if new == text:
                    break
                text = new
        text = self.entities(text)
        while "\x00" in text:
            new = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text)
            if new == text:
                break
            text = new
        return re.sub(r"[ \t]+", " ", text).strip()

    def entities(self, text: str) -> str:
        def swap(m: re.Match) -> str:
            if m[1] and m[1] + ";" not in html.entities.html5:
                return m[0]
            self.mark("html", "entity")
            return html.unescape(m[0]).replace("\xa0", " ")

        return ENTITY.sub(swap, text)

    # blocks -----------------------------------------------------------------------------------
    def add(self, path: str, kind: str, text: str, depth: int = 0) -> None:
        if kind not in ("li", "oli"):
            self.above = -1
        if text.strip():
            self.leaves.append(Leaf("/".join([*self.stack, path]).strip("/"), kind, text.strip("\n") if kind == "code" else text.strip(), depth, tuple(self.pending)))
            self.pending.clear()

    def end_row(self) -> None:
        if self.row is not None:
            cells, self.row = self.row, None
            if any(cells):
                self.add("", "row", " | ".join(cells))

    def lines(self, text: str) -> None:
        """Markdown, wiki and LaTeX blocks of a text without HTML tags."""
        lines = text.split("\n")
        i, n = 0, len(lines)
        paragraph: list[str] = []

        def flush() -> None:
            if paragraph:
                self.add("p", "text", self.inline("\n".join(paragraph)))
                paragraph.clear()

        while i < n:
            line = lines[i]
            bare = line.strip()
            if not bare:
                flush()
                i += 1
                continue
            if m := _FENCE.match(line):
                flush()
                self.mark("md", "block")
                j = i + 1
                while j < n and not (lines[j].strip().startswith(m[1]) and not lines[j].strip().strip(m[1][0])):
                    j += 1
                self.add("md/pre", "code", "\n".join(lines[i + 1 : j]))
                i = j + 1
                continue
            if m := _ATX.match(line):
                flush()
                self.mark("md", "block")
                self.add(f"md/h{len(m[1])}", f"h{len(m[1])}", self.inline(m[2]))
            elif (m := _WIKI_H.match(line)) and (len(m[1]) > 1 or i + 1 >= n or not lines[i + 1].strip()):
                flush()
                self.mark("wiki", "block")
                self.add(f"wiki/h{len(m[1])}", f"h{len(m[1])}", self.inline(m[2]))
            elif m := _SECTION.match(line):
                flush()
                self.mark("latex", "block")
                self.add(f"latex/{m[1]}", f"h{_LEVEL[m[1]]}", self.inline(m[2]))
            elif i + 1 < n and (m := _SETEXT.match(lines[i + 1])) and len(m[1]) > 2 and not paragraph and not _RULER.match(line) and "|" not in line:
                self.mark("md", "block")
                self.add("md/h" + ("1" if m[1][0] == "=" else "2"), "h1" if m[1][0] == "=" else "h2", self.inline(bare))
                i += 1
            elif bare.startswith("{|"):
                flush()
                self.mark("wiki", "block")
                j = i + 1
                cells: list[str] = []
                while j < n and not lines[j].strip().startswith("|}"):
                    row = lines[j].strip()
                    if row.startswith("|-"):
                        self.add("wiki/table/tr", "row", " | ".join(cells))
                        cells = []
                    elif row[:1] in "|!":
                        cells += [self.inline(c.split("|")[-1] if "|" in c and "[[" not in c else c) for c in re.split(r"\|\||!!", row[1:])]
                    j += 1
                self.add("wiki/table/tr", "row", " | ".join(cells))
                i = j
            elif m := _ENV.match(line):
                flush()
                self.mark("latex", "block")
                start, end = "\\begin{" + m[1], "\\end{" + m[1]
                body, j, open_ = [], i, 1
                rest = m[2]
                while True:  # up to its own end, whatever lies inside
                    open_ += rest.count(start) - rest.count(end)
                    if open_ <= 0 or j + 1 >= n:
                        body.append(rest.rpartition(end)[0] if end in rest else rest)
                        break
                    body.append(rest)
                    j += 1
                    rest = lines[j]
                self.environment(m[1], "\n".join(body))
                i = j
            elif "|" in line and i + 1 < n and _RULER.match(lines[i + 1]) and "-" in lines[i + 1] and "|" in lines[i + 1]:
                flush()
                self.mark("md", "block")
                j = i
                while j < n and "|" in lines[j]:
                    if not _RULER.match(lines[j]):
                        self.add("md/table/tr", "row", " | ".join(self.inline(c) for c in lines[j].strip().strip("|").split("|")))
                    j += 1
                i = j - 1
            elif bare in ("\\[", "$$"):
                flush()
                self.mark("latex", "block")
                end, j = ("\\]" if bare == "\\[" else "$$"), i + 1
                while j < n and lines[j].strip() != end:
                    j += 1
                self.add("latex/math", "formula", " ".join(x.strip() for x in lines[i + 1 : j]))
                i = j
            elif _RULE.match(line):
                flush()
                self.mark("md", "block")
            elif m := _ITEM.match(line):
                flush()
                self.mark("md", "block")
                kind = "oli" if m[2][0].isdigit() else "li"
                deep = len(m[2]) - 1 if m[2][0] in "*#" else len(m[1].expandtabs(4)) // 2
                depth = min(deep, self.above + 1)  # an item is at most one level below the one before
                self.add("md/ol/li" if kind == "oli" else "md/ul/li", kind, (m[2] + " " if kind == "oli" else "") + self.inline(m[3]), depth)
                self.above = depth
            elif bare[0] == ">" and (m := _QUOTE.match(line)) and not paragraph:
                self.mark("md", "block")
                self.add("md/blockquote", "quote", self.inline(m[1]))
            elif _REFDEF.match(line):
                flush()
                self.mark("md", "block")
            else:
                paragraph.append(line)
            i += 1
        flush()

    def environment(self, name: str, body: str) -> None:
        if name in ("itemize", "enumerate", "description"):
            self.latex_list(name, body, 0)
        elif name in ("verbatim", "lstlisting", "minted", "Verbatim"):
            self.add(f"latex/{name}", "code", body)
        elif name in ("equation", "align", "displaymath", "eqnarray", "gather", "multline", "math"):
            self.add(f"latex/{name}", "formula", " ".join(body.split()))
        elif name in ("tabular", "array", "tabularx", "longtable"):
            for row in re.split(r"\\\\|\n", body.replace("\\hline", "")):
                self.add(f"latex/{name}/tr", "row", " | ".join(self.inline(c) for c in re.split(r"(?<!\\)&", row)) if row.strip() else "")
        else:
            self.stack.append(f"latex/{name}")
            self.lines(body)
            self.stack.pop()

    def latex_list(self, name: str, body: str, depth: int) -> None:
        """Items of a list and of the lists inside it, numbered in enumerations."""
        kinds = "itemize|enumerate|description"
        n, inner, begun = [0], [name], False
        for part in re.split(rf"(\\(?:begin|end)\{{(?:{kinds})\}}|\\item\b(?:\[[^\]]*\])?)", body):
            if m := re.match(rf"\\begin\{{({kinds})\}}", part):
                inner.append(m[1])
                n.append(0)
            elif part.startswith("\\end{"):
                if len(inner) > 1:
                    inner.pop()
                    n.pop()
            elif part.startswith("\\item"):
                n[-1] += 1
                begun = True
            elif begun and part.strip():
                text = self.inline(" ".join(part.split()))
                numbered = inner[-1] == "enumerate"
                self.add(f"latex/{inner[-1]}/item", "oli" if numbered else "li", f"{n[-1]}. {text}" if numbered else text, depth + len(inner) - 1)

    def parse(self, text: str) -> Parser:
        """HTML tags first; what lies between them is looked at for the other three."""
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        pieces: list[tuple[str, str]] = []
        at, run = 0, []

        def out() -> None:
            if run:
                pieces.append(("text", "".join(run)))
                run.clear()

        fenced = [m.span() for m in re.finditer(r"(?ms)^\s{0,3}(`{3,}|~{3,})[^\n`]*\n.*?(?:^\s{0,3}\1[`~]*\s*$|\Z)", text)]
        verbatim = [m.span() for m in re.finditer(r"(?s)\\begin\{(verbatim|lstlisting)\}.*?(?:\\end\{\1\}|\Z)", text)]
        inline_code = [m.span() for m in re.finditer(r"(?<!`)`(?!`)[^`\n]+`(?!`)", text)]
        guard = sorted(fenced + verbatim + inline_code)
        g = 0
        for m in TAG.finditer(text):
            while g < len(guard) and guard[g][1] <= m.start():
                g += 1
            if g < len(guard) and guard[g][0] <= m.start():
                continue
            name = (m[2] or "").lower()
            if name and name not in HTML_NAMES and name not in _WIKI_TAGS:
                continue
            run.append(text[at : m.start()])
            at = m.end()
            family = "wiki" if name in _WIKI_TAGS and name not in ("math", "source") else "html"
            if not (name in _BLOCKS or name in _GONE or name in ("math", "syntaxhighlight", "nowiki", "ref")):
                self.mark(family, name or "comment")
            if not name:
                continue
            if name in _BLOCKS or name in _GONE or name in ("math", "syntaxhighlight", "nowiki", "ref"):
                out()
                pieces.append(("close" if m[1] else "open", name))
                pieces.append(("step", f"{family}:{name}"))
                if name in _VOID or m[3].endswith("/") and not m[1]:
                    pieces.append(("close", name))
        run.append(text[at:])
        out()
        for kind, value in pieces:
            if kind == "step":
                self.pending.append(value)
            elif kind == "open":
                if value == "li" and self.stack and self.stack[-1] == "li" or value == "p" and self.stack and self.stack[-1] == "p":
                    self.stack.pop()
                if value in ("tr", "table"):
                    self.end_row()
                self.stack.append(value)
                if value in _LISTS:
                    self.counts[len(self.stack)] = 0
                elif value == "li":
                    self.fresh = True
                    at = self.list_place()
                    self.counts[at] = self.counts.get(at, 0) + 1
                elif value in ("td", "th"):
                    self.row = [*(self.row or []), ""]
            elif kind == "close":
                if value in ("tr", "table"):
                    self.end_row()
                if value in self.stack:
                    del self.stack[len(self.stack) - 1 - self.stack[::-1].index(value) :]
            else:
                self.html_text(value)
        self.end_row()
        if self.pending:
            self.leaves.append(Leaf("", "mark", "", 0, tuple(self.pending)))
        return self

    def list_place(self) -> int:
        """The place in the stack of the innermost list, 0 without one."""
        return next((i for i in range(len(self.stack), 0, -1) if self.stack[i - 1] in _LISTS), 0)

    def item(self, text: str) -> None:
        """Text of an HTML list item: numbered in ordered lists, indented in nested ones; what follows inside
        the same item goes on with it."""
        if not text:
            return
        at = self.list_place()
        depth = max(0, sum(x in _LISTS for x in self.stack) - 1)
        if not self.fresh and self.leaves and self.leaves[-1].kind in ("li", "oli"):
            last = self.leaves[-1]
            self.leaves[-1] = last._replace(text=f"{last.text} {text}", steps=last.steps + tuple(self.pending))
            self.pending.clear()
            return
        numbered = self.fresh and at and self.stack[at - 1] == "ol"
        self.fresh = False
        self.add("", "oli" if numbered else "li", f"{self.counts[at]}. {text}" if numbered else text, depth)

    def html_text(self, text: str) -> None:
        names = [x for x in self.stack]
        if any(x in _GONE for x in names):
            return
        inner = next((x for x in reversed(names) if x != "p" or len(names) == 1), "")
        if "pre" in names or "syntaxhighlight" in names:
            self.add("", "code", self.entities(text))
        elif "math" in names:
            self.add("", "formula", text)
        elif inner in ("h1", "h2", "h3", "h4", "h5", "h6", "title"):
            self.add("", "h1" if inner == "title" else inner, self.inline(" ".join(text.split())))
        elif "ref" in names:
            return
        elif self.row is not None and ("td" in names or "th" in names):
            cell = self.inline(" ".join(text.split()))
            self.row[-1] = f"{self.row[-1]} {cell}".strip()
        elif "li" in names:
            self.item(self.inline(" ".join(text.split())))
        elif "blockquote" in names:
            self.add("", "quote", self.inline(" ".join(text.split())))
        else:
            self.lines(text)


STRUCTURE = frozenset(["code", "formula", "row", "li", "oli", "h1", "h2", "h3", "h4", "h5", "h6", "quote"])


def path_scores(leaves: list[Leaf]) -> dict[str, float]:
    """Fused path ratios: text length and punctuation per leaf of each path, smoothed over the
    neighbouring paths with weights 1-2-1."""
    size: dict[str, list[int]] = {}
    for x in leaves:
        own = size.setdefault(x.path, [0, 0, 0])
        own[0] += 1
        own[1] += len(x.text)
        own[2] += len(_PUNCTUATION.findall(x.text))
    paths = list(size)
    ratios = [[size[p][k] / size[p][0] for p in paths] for k in (1, 2)]

    def smooth(v: list[float]) -> list[float]:
        return [(v[max(i - 1, 0)] + 2 * v[i] + v[min(i + 1, len(v) - 1)]) / 4 for i in range(len(v))]

    length, points = (smooth(v) for v in ratios)
    return {p: math.sqrt(a * (b + 0.5)) for p, a, b in zip(paths, length, points, strict=True)}


def content(leaves: list[Leaf]) -> list[Leaf]:
    """Content leaves by thresholded path scores, all structure, and of the rest what says a sentence or lies
    between content leaves."""
    leaves = [x for x in leaves if x.kind != "mark"]
    if not leaves:
        return []
    score = path_scores(leaves)
    bar = THRESHOLD * sum(score[x.path] for x in leaves) / len(leaves)
    good = [score[x.path] >= bar for x in leaves]
    first, last = (good.index(True), len(good) - 1 - good[::-1].index(True)) if any(good) else (len(good), -1)
    return [x for i, x in enumerate(leaves) if good[i] or x.kind in STRUCTURE or first < i < last or _SENTENCE_END.search(x.text)]


_SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*(?:\s|$)")


def families(leaves: list[Leaf]) -> list[str]:
    """Construct families of the steps in the leaves' paths."""
    return sorted({step.partition(":")[0] for x in leaves for step in x.steps})


def rendered(leaves: list[Leaf]) -> str:
    """Clean text: headings with #, list items with - or their number and indented by their depth, code
    between fences, formulas between $$, table rows with |; blocks are parted by blank lines, items and
    rows by line feeds."""
    out, before, above = "", "", 0
    for x in leaves:
        text = (
            "#" * int(x.kind[1]) + " " + x.text
            if x.kind[0] == "h"
            else {"li": f"- {x.text}", "code": f"```\n{x.text}\n```", "formula": f"$$ {x.text} $$", "quote": f"> {x.text}"}.get(x.kind, x.text)
        )
        items = x.kind in ("li", "oli") and before in ("li", "oli") and (x.kind == before or x.depth > 0 or above > 0)
        together = items or x.kind == "row" and before == "row"
        out += ("" if not out else "\n" if together else "\n\n") + "  " * x.depth + text
        before, above = x.kind, x.depth
    return out


def clean(text: str) -> tuple[str, list[str]]:
    """(clean text, construct families) of a text. A text without markup stays as it is."""
    leaves = Parser().parse(text).leaves
    found = families(leaves)
    return (rendered(content(leaves)), found) if found else (text, [])


SOURCES = ["browser_markdown_dumps", "response_models"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    dumps = table(spark, sf_dir, SOURCES[0]).where("dump_id is not null")
    models = table(spark, sf_dir, SOURCES[1]).where("response_id is not null")
    return dumps.select(F.lit(SOURCES[0]).alias("tbl"), F.col("dump_id").alias("record_id"), F.array("markdown").alias("elements")).unionByName(
        models.select(F.lit(SOURCES[1]).alias("tbl"), F.col("response_id").alias("record_id"), F.col("content").alias("elements"))
    )


def cleaned(rows: DataFrame) -> DataFrame:
    """(tbl, record_id, families, text) for each record of (tbl, record_id, elements).

    Elements are parsed one by one and joined by blank lines; null elements are skipped, a record
    without any has no families and a null text. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            families, texts = [], []
            for elements in b.column(2).to_pylist():
                own = [clean(e) for e in elements or [] if e is not None]
                families.append(sorted({f for _, fs in own for f in fs}))
                texts.append("\n\n".join(t for t, _ in own if t.strip()).encode("utf-8", "replace").decode() if own else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(families, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["tbl", "record_id", "families", "text"])

    return spread(rows).mapInArrow(run, "tbl string, record_id long, families array<string>, text string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_id) of records with markup."""
    return cleaned(_rows(spark, sf_dir)).where(F.size("families") > 0).select("tbl", "record_id")


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, record_id, families, text): the clean text of every record."""
    return cleaned(_rows(spark, sf_dir)).withColumn("families", F.array_join("families", ","))
