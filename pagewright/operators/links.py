"""Links of pages under domain, pattern, extension and scope rules, with the reason of each drop."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.dom import tree
from pagewright.dom.nodes import per_page
from pagewright.functions import urls
from pagewright.select import css, xpath

#: Extensions that aren't followed unless others are given (fixed values).
IGNORED_EXTENSIONS = frozenset(
    "7z 7zip bz2 rar tar tar.gz xz zip mng pct bmp gif jpg jpeg png pst psp tif tiff ai drw dxf eps ps svg cdr ico webp mp3 wma ogg wav ra aac mid au aiff "
    "3gp asf asx avi mov mp4 mpg qt rm swf wmv m4a m4v flv webm xls xlsm xlsx xltm xltx potm potx ppt pptm pptx pps doc docb docm docx dotm dotx odt ods odg odp "
    "css pdf exe bin rss dmg iso apk jar sh rb js hta bat cpl msi msp py".split()
)


@dataclass(frozen=True)
class LinkExtractor:
    """Which links are taken. ``process`` may change a URL or reject it with none; it runs in Python
    workers. Patterns are searched in the whole URL; empty lists admit all."""

    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    allow_domains: tuple[str, ...] = ()
    deny_domains: tuple[str, ...] = ()
    restrict_css: tuple[str, ...] = ()
    restrict_xpath: tuple[str, ...] = ()
    tags: tuple[str, ...] = ("a", "area")
    attrs: tuple[str, ...] = ("href",)
    canonicalize: bool = True
    strip: bool = True
    keep_fragment: bool = False
    deny_extensions: frozenset[str] | None = None
    process: Callable[[str], str | None] | None = None

    def __post_init__(self) -> None:
        for p in (*self.allow, *self.deny):
            if re.search(r"\(\?[=!<]|\\[1-9]", p):
                raise ValueError(f"look-around and back-references aren't allowed: {p}")
            re.compile(p)

    def prepared(self, base: str | None, raw: str | None) -> tuple[str | None, str]:
        """(URL, "") of a taken link, or (none, reason)."""
        text = (raw or "").strip() if self.strip else raw or ""
        if not text:
            return None, "empty_raw"
        url = urls.resolve_url(base, text)
        if url is None:
            return None, "invalid_raw"
        if self.process is not None:
            got = self.process(url)
            if not got:
                return None, "process_rejected"
            url = urls.resolve_url(base, got)
            if url is None:
                return None, "invalid_processed"
        if self.canonicalize:
            url = urls.canonical_link_url(url, self.keep_fragment)
            if url is None:
                return None, "invalid_canonical"
        return (url, "") if self.passes(url) else (None, "filtered")

    def passes(self, url: str) -> bool:
        u = urls.parse_url(url)
        if u is None or not (u.scheme in ("http", "https") and u.host or u.scheme == "file"):
            return False
        denied = IGNORED_EXTENSIONS if self.deny_extensions is None else self.deny_extensions
        if urls.link_extension(u.path) in denied:
            return False
        host = u.host.lower().rstrip(".")
        under = lambda domains: any(host == d or host.endswith("." + d) for d in (x.lower().strip().strip(".") for x in domains))
        if self.allow_domains and not under(self.allow_domains) or self.deny_domains and under(self.deny_domains):
            return False
        return (not self.allow or any(re.search(p, url) for p in self.allow)) and not any(re.search(p, url) for p in self.deny)

    def candidates(self, root: tree.Node) -> Iterator[str]:
        """Raw links of a page in document order: of the scopes (XPath ones first), else of all."""
        scopes: list[tree.Node] = []
        for e in self.restrict_xpath:
            scopes += [n for n, _ in xpath.select(root, e)]
        for s in self.restrict_css:
            scopes += [n for _, n, _ in css.select(root, s)]
        for scope in scopes or [root]:
            for n in scope.walk():
                if n.tag in self.tags:
                    yield from (v for a in self.attrs if (v := n.attr(a)) is not None)


def base_of(root: tree.Node, url: str | None) -> str | None:
    """The address that links are resolved against: the first base element's, else the page's."""
    found = next((n.attr("href") for n in root.walk() if n.tag == "base" and n.attr("href")), None)
    return urls.resolve_url(url, found) if found else url


def link_candidates(pages: DataFrame, extractor: LinkExtractor) -> DataFrame:
    """(page_id, ord, raw, url, reason): every candidate, taken (reason '') or dropped."""

    def rows(i: int, url: str | None, root: tree.Node) -> Iterator[tuple]:
        base = base_of(root, (url or "").strip() or None)
        for k, raw in enumerate(extractor.candidates(root), 1):
            yield (i, k, raw, *extractor.prepared(base, raw))

    return per_page(pages, "page_id long, ord int, raw string, url string, reason string", rows)


def extract_links(pages: DataFrame, extractor: LinkExtractor) -> DataFrame:
    """(page_id, ord, url): taken links of each page, each once, in the order they first appear."""
    taken = link_candidates(pages, extractor).where("reason = ''")
    return taken.groupBy("page_id", "url").agg(F.min("ord").alias("ord")).select("page_id", "ord", "url")


def allowed(url: Column, domains: list[str]) -> Column:
    """Whether a follow-up may be crawled: its host is an allowed one or under it; no list allows all."""
    return urls.domain_in(F.regexp_replace(urls.host(url), r"\.$", ""), domains) if domains else F.lit(True)


@dataclass(frozen=True)
class Rule:
    """Links of an extractor go to a callback, with a priority of their own if given."""

    name: str
    extractor: LinkExtractor
    callback: str = ""
    priority: int | None = None


def dispatch(urls_: DataFrame, rules: list[Rule], fallback: str = "", every: bool = False) -> DataFrame:
    """(*, rule, callback, rule_priority): the first rule that takes each row's url, or with ``every`` a
    row for each of them; without rules all go to the fallback, and rows that no rule takes are
    dropped. ``rule_priority`` is null where the rule has none of its own."""
    if not rules:
        return urls_.withColumns({"rule": F.lit(""), "callback": F.lit(fallback), "rule_priority": F.lit(None).cast("int")})

    @F.pandas_udf("array<int>")
    def taking(c):
        def of(u):
            hits = (i for i, r in enumerate(rules) if u and r.extractor.prepared(None, u)[0])
            return list(hits) if every else [i for i in [next(hits, None)] if i is not None]

        return c.map(of)

    names, calls = (F.array(*[F.lit(x) for x in v]) for v in ([r.name for r in rules], [r.callback or fallback for r in rules]))
    ranks = F.array(*[F.lit(r.priority).cast("int") for r in rules])
    at = F.col("__rule") + 1
    each = urls_.withColumn("__rule", F.explode(taking("url")))
    return each.withColumns({"rule": F.element_at(names, at), "callback": F.element_at(calls, at), "rule_priority": F.element_at(ranks, at)}).drop("__rule")
