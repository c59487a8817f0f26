"""Declarative extraction: named fields by CSS, XPath or JSON path."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.dom import tree
from pagewright.dom.nodes import per_page
from pagewright.functions.json_path import values_at
from pagewright.select import css, xpath


@dataclass(frozen=True)
class Field:
    """A field of a recipe; ``kind`` is css, xpath or json."""

    name: str
    selector: str
    kind: str = "css"
    multiple: bool = False
    prefix: str = ""
    html_to_text: bool = False


# Texts of errors.
NO_MATCH = "selector matched no values"
NO_ELEMENTS = "css_selector matched no elements"
NO_CONTENT = "empty extracted content"
HTTP_ERROR = "HTTP "
SCHEMA = "page_id long, name string, type string, selector string, value string, values array<string>, error string"


def field_values(root: tree.Node, source: str, f: Field) -> list[str]:
    if f.kind == "json":
        found = values_at(source, f.selector, f.multiple)
    elif f.kind == "xpath":
        found = [tree.full_text(n) if v is None else v for n, v in xpath.select(root, f.selector)]
    else:
        found = [tree.full_text(n) if v is None else v for _, n, v in css.select(root, f.selector)]
    if f.html_to_text:
        found = [html.unescape(re.sub(r"<[^>]*>", " ", x)) for x in found]
    found = [t for t in map(tree.normal, found) if t]
    return [f.prefix + t for t in found]


def extract(pages: DataFrame, fields: list[Field], no_result_statuses: list[int] | None = None) -> DataFrame:
    """One row per page and field: the first value, all of them where there are several or several are
    asked for, or an error. Invalid selectors are an error of their field. Pages (with ``status``) of a
    no-result status have no rows."""
    if no_result_statuses:
        pages = pages.where(~F.coalesce(no_result(F.col("status"), no_result_statuses), F.lit(False)))

    def rows(i: int, url: str | None, root: tree.Node) -> Iterator[tuple]:
        # JSON fields read the text of the page's body
        body = "".join(n.text for n in root.walk() if n.kind == "text")
        for f in fields:
            try:
                found = field_values(root, body, f)
            except (css.InvalidSelector, xpath.InvalidXPath) as e:
                yield i, f.name, f.kind, f.selector, "", [], str(e)
                continue
            yield i, f.name, f.kind, f.selector, found[0] if found else "", found if f.multiple or len(found) > 1 else [], "" if found else NO_MATCH

    return per_page(pages, SCHEMA, rows)


def static_extract(pages: DataFrame, selector: str = "") -> DataFrame:
    """(page_id, title, content, error): a page's title and the trimmed text of a selection (of the body
    without one), its markup where there is no text.

    ``pages`` may have ``status``; statuses outside 200 to 299 give ``HTTP n`` and no content. A selector
    without elements, and a selection without text and markup, are errors of their own.
    """
    chosen = selector.strip()

    def rows(i: int, url: str | None, root: tree.Node) -> Iterator[tuple]:
        title = next((v for _, _, v in css.select(root, "title::text")), "").strip()
        try:
            found = [(n, v) for _, n, v in css.select(root, chosen or "body")]
        except css.InvalidSelector:
            found = []
        if chosen and not found:
            yield i, title, "", NO_ELEMENTS
            return
        text = "\n".join(t for t in (tree.full_text(n) if v is None else v for n, v in found) if t).strip()
        content = text or "\n".join(tree.outer_html(n) if v is None else v for n, v in found).strip()
        yield i, title, content, "" if content else NO_CONTENT

    got = per_page(pages, "page_id long, title string, content string, error string", rows)
    if "status" not in pages.columns:
        return got
    bad = ~F.coalesce(F.col("status").between(200, 299), F.lit(False))
    out = got.join(pages.select("page_id", "status"), "page_id")
    return out.select(
        "page_id", "title", F.when(bad, "").otherwise(F.col("content")).alias("content"), F.when(bad, F.concat(F.lit(HTTP_ERROR), F.coalesce(F.col("status").cast("string"), F.lit("0")))).otherwise(F.col("error")).alias("error")
    )


def projected(pages: DataFrame, selector: str = "", main_only: bool = False, kind: str = "text") -> DataFrame:
    """(page_id, status, url, content) of responses (page_id, url, html, status): a list of no or one text.

    It is that of the selector's elements, else of the first main element if only main content is asked
    for, else of the body. ``kind`` is ``html`` for markup; ``text`` and ``markdown`` give text.
    """
    if kind not in ("text", "html", "markdown"):
        raise ValueError(f"unknown kind {kind}")

    def rows(i: int, url: str | None, root: tree.Node) -> Iterator[tuple]:
        first = [selector.strip()] if selector.strip() else ["main", "body"] if main_only else ["body"]
        found: list = []
        for s in first:
            try:
                found = [(n, v) for _, n, v in css.select(root, s)]
            except css.InvalidSelector:
                found = []
            if found:
                found = found[:1] if s == "main" and not selector.strip() else found
                break
        texts = [v if v is not None else tree.outer_html(n) if kind == "html" else tree.full_text(n) for n, v in found]
        text = "\n".join(t for t in texts if t)
        yield i, [text] if text else []

    got = per_page(pages, "page_id long, content array<string>", rows)
    return pages.select("page_id", "status", "url").join(got, "page_id")


@dataclass(frozen=True)
class Provider:
    """An entry of a registry of sources: how it is called, what it is for and which recipe reads it."""

    name: str
    shortcut: str = ""
    categories: tuple[str, ...] = ()
    enabled: bool = True
    weight: float = 1.0
    recipe: str = ""


def providers_of(providers: list[Provider], category: str = "") -> list[Provider]:
    """The enabled ones of a category (any case; all without one), by name."""
    want = category.strip().lower()
    fits = (p for p in providers if p.enabled and (not want or want in {c.strip().lower() for c in p.categories}))
    return sorted(fits, key=lambda p: p.name)


def resolved(calls: DataFrame, providers: list[Provider], key: str = "key") -> DataFrame:
    """Calls with the provider their key names, by name before shortcut (any case), and an ``error`` for
    a blank or unknown key, a disabled provider or a shortcut of several. The registry is part of the plan."""
    rows = [("name", p.name.lower(), p) for p in providers] + [("shortcut", p.shortcut.lower(), p) for p in providers if p.shortcut]
    by: dict[tuple[str, str], list[Provider]] = {}
    for how, k, p in rows:
        by.setdefault((how, k), []).append(p)
    names: dict[str, tuple[str | None, str | None]] = {}
    for (how, k), own in sorted(by.items()):  # names sort before shortcuts, so they stay
        if how == "name":
            names[k] = (own[0].name, None if own[0].enabled else f"provider {own[0].name} is disabled")
        elif k not in names:
            one = own[0]
            wrong = f"ambiguous provider shortcut {k}: " + ", ".join(sorted(p.name for p in own)) if len(own) > 1 else None if one.enabled else f"provider {one.name} is disabled"
            names[k] = (one.name, wrong)
    want = F.lower(F.trim(F.coalesce(F.col(key), F.lit(""))))
    known = F.create_map(*[x for k, (n, e) in names.items() for x in (F.lit(k), F.struct(F.lit(n).cast("string").alias("name"), F.lit(e).cast("string").alias("error")))]) if names else None
    hit = F.try_element_at(known, want) if names else F.lit(None).cast("struct<name:string,error:string>")
    error = F.when(want == "", "provider is required").when(hit.isNull(), F.concat(F.lit("unknown provider "), F.trim(F.col(key)))).otherwise(hit["error"])
    return calls.withColumns({"provider": F.when(error.isNull(), hit["name"]), "error": error})


def no_result(status: Column, codes: list[int]) -> Column:
    """Whether a status means that there is no result."""
    return status.isin(*codes) if codes else F.lit(False)


def paging(page: int, size: int = 1, first: int = 1) -> int:
    """The number that stands for a page in a URL."""
    return (max(page, 1) - 1) * max(size, 1) + first


def language(tag: str, every: str = "en") -> str:
    """The primary part of a language tag; "all" and '' stand for ``every``."""
    primary = re.split(r"[-_]", tag.strip().lower())[0]
    return every if primary in ("", "all") else primary


def chosen_value(value: str, values: dict[str, str], default: str = "") -> str:
    """What a search option (safe search, time range) is called at a source: the entry of its lower-case
    name, the default for an unknown or empty one."""
    return values.get(value.strip().lower(), default)
