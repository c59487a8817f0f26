"""Pages as DataFrames of nodes.

``dom_nodes`` holds each node with its number in document order and that of its last descendant, so
that structure is arithmetic: b lies under a on the same page iff ``a.node_id < b.node_id <= a.last``.
What a single page decides alone (selectors, views) runs in one pass over the pages without a
shuffle; a page is parsed once for all that is asked of it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from pagewright.dom import tree
from pagewright.select import css, xpath
from pagewright.session import spread

NODES = (
    "page_id long, node_id int, last int, parent_id int, kind string, tag string, depth int, "
    "attr map<string,string>, text string, text_direct string, text_full string, child_ord int, nth_of_type int, xpath string"
)


def per_page(pages: DataFrame, schema: str, rows: Callable[[int, str | None, tree.Node], Iterable[tuple]]) -> DataFrame:
    """Rows that a function makes of each parsed page (page_id, url, html). A null html is an empty
    page; other columns play no part."""
    fields = _parse_datatype_string(schema)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.extend(rows(page_id, url, tree.parse(html)))
                if len(out) > 20_000:
                    yield _batch(out, arrow)
                    out = []
            if out:
                yield _batch(out, arrow)

    return spread(pages.select(F.col("page_id").cast("long"), "url", "html")).mapInArrow(run, fields)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(_storable(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _storable(column: tuple) -> list[Any]:
    """Lone surrogates, which no encoding can hold, become question marks."""
    return [v.encode("utf-8", "replace").decode() if isinstance(v, str) and not v.isascii() else v for v in column]


_COLUMNS = [c.strip().partition(" ")[0] for c in NODES.replace("map<string,string>", "map").split(",")]


def dom_nodes(pages: DataFrame, columns: list[str] | None = None, tags: list[str] | None = None) -> DataFrame:
    """All nodes of all pages, or only the asked columns and the elements of the asked tags.

    One walk counts places among siblings and writes paths from the parent's, so the work grows with
    the page and with what is asked. The last of repeated attributes counts; texts are null where they
    don't apply. Unknown columns are an error.
    """
    names = list(columns or _COLUMNS)
    kinds = {f.name: f.dataType for f in _parse_datatype_string(NODES)}
    if unknown := [c for c in names if c not in kinds]:
        raise ValueError("unknown columns: " + ", ".join(unknown))
    wanted, only = set(names), None if tags is None else frozenset(tags)

    def rows(page_id: int, url: str | None, root: tree.Node) -> Iterator[tuple]:
        pieces: list[str] = []  # normalised text pieces of the page in document order
        upto: list[int] = []  # of each node: how many pieces stand before it
        nodes: list[tree.Node] = list(root.walk())
        if "text_full" in wanted:
            for n in nodes:
                upto.append(len(pieces))
                if n.kind == "text" and (t := tree.normal(n.text)):
                    pieces.append(t)
            upto.append(len(pieces))
        counts: dict[int, dict[str, int]] = {}  # element children of a node seen so far, by tag
        paths: dict[int, str] = {}
        for n in nodes:
            if n is root:
                continue
            element = n.kind == "element"
            place = nth = path = None
            if element:
                seen = counts.setdefault(n.parent.pre, {"": 0})
                seen[""] += 1
                seen[n.tag] = seen.get(n.tag, 0) + 1
                place, nth = seen[""], seen[n.tag]
                if "xpath" in wanted:
                    path = paths[n.pre] = f"{paths.get(n.parent.pre, '')}/{n.tag}[{nth}]"
            if only is not None and not (element and n.tag in only):
                continue
            own = {
                "page_id": page_id, "node_id": n.pre, "last": n.last, "parent_id": n.parent.pre if n.parent is not root else None, "kind": n.kind, "tag": n.tag or None,
                "depth": n.depth, "text": None if element else n.text, "child_ord": place, "nth_of_type": nth, "xpath": path,
            }
            if element:
                if "attr" in wanted:
                    own["attr"] = list(dict(n.attrs).items())
                if "text_direct" in wanted:
                    own["text_direct"] = tree.direct_text(n)
                if "text_full" in wanted:
                    own["text_full"] = " ".join(pieces[upto[n.pre] : upto[n.last + 1]])
            yield tuple(own.get(c) for c in names)

    return per_page(pages, ", ".join(f"{c} {kinds[c].simpleString()}" for c in names), rows)


def counted_within(pages: DataFrame, outer: str, tag: str) -> DataFrame:
    """(page_id, node_id, n): for every ``outer`` element that holds any, how many ``tag`` elements lie
    under it. Structure inside a page is known where it is parsed, so there is no join."""

    def rows(page_id: int, url: str | None, root: tree.Node) -> Iterator[tuple]:
        places: list[int] = []
        tops: list[tree.Node] = []
        for n in root.walk():
            if n.kind == "element":
                if n.tag == tag:
                    places.append(n.pre)
                if n.tag == outer:
                    tops.append(n)
        for n in tops:
            if k := bisect_right(places, n.last) - bisect_right(places, n.pre):
                yield page_id, n.pre, k

    return per_page(pages, "page_id long, node_id int, n long", rows)


SELECTED = "page_id long, name string, branch int, ord int, node_id int, tag string, value string, text string, html string"


def select_all(pages: DataFrame, selectors: dict[str, str], with_html: bool = False) -> DataFrame:
    """Results of named selectors on every page, in branch and document order (``ord`` from 1).

    A selector that begins with ``/``, ``(`` or ``xpath:`` is XPath, any other CSS. Invalid ones
    select nothing. ``value`` is the asked text or attribute, null for elements; ``text`` the element's
    full text.
    """

    def one(root: tree.Node, selector: str) -> Iterator[tuple[int, tree.Node, str | None]]:
        try:
            if selector[:1] in "/(" or selector.startswith("xpath:"):
                return iter([(0, n, v) for n, v in xpath.select(root, selector.removeprefix("xpath:"))])
            return iter(list(css.select(root, selector)))
        except (css.InvalidSelector, xpath.InvalidXPath):
            return iter(())

    def rows(page_id: int, url: str | None, root: tree.Node) -> Iterator[tuple]:
        for name, selector in selectors.items():
            for i, (branch, n, value) in enumerate(one(root, selector), 1):
                yield page_id, name, branch, i, n.pre, n.tag, value, tree.full_text(n), tree.outer_html(n) if with_html else None

    return per_page(pages, SELECTED, rows)


def chosen(selected: DataFrame) -> Column:
    """What a selection's GetAll gives for a row: its value, or the element's markup."""
    return F.coalesce(selected["value"], selected["html"])


def first_of(selected: DataFrame, default: str = "") -> DataFrame:
    """(page_id, name, value): the first value of each selection; the default where it is null."""
    return selected.groupBy("page_id", "name").agg(F.coalesce(F.min_by(F.coalesce("value", "text"), "ord"), F.lit(default)).alias("value"))


# Structure as joins. All of them join on page_id, so they share one partitioning.


def elements(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'element'")


def descendants(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, ancestor_id, *columns of nodes) of elements under the elements of ``a``."""
    up = a.select("page_id", F.col("node_id").alias("ancestor_id"), F.col("last").alias("ancestor_last"))
    return up.join(elements(nodes), "page_id").where("node_id > ancestor_id and node_id <= ancestor_last").drop("ancestor_last")


def ancestors(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, of_id, *columns of nodes, distance) of elements above the elements of ``a``, 1 for the parent."""
    down = a.select("page_id", F.col("node_id").alias("of_id"), F.col("depth").alias("of_depth"))
    return down.join(elements(nodes), "page_id").where("node_id < of_id and of_id <= last").withColumn("distance", F.col("of_depth") - F.col("depth")).drop("of_depth")


def children(a: DataFrame, nodes: DataFrame) -> DataFrame:
    up = a.select("page_id", F.col("node_id").alias("parent_id"))
    return elements(nodes).join(up, ["page_id", "parent_id"], "left_semi")


def parents(a: DataFrame, nodes: DataFrame) -> DataFrame:
    down = a.select("page_id", F.col("parent_id").alias("node_id")).distinct()
    return elements(nodes).join(down, ["page_id", "node_id"], "left_semi")


def siblings(a: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, of_id, *columns): the other element children of each element's parent."""
    own = a.select("page_id", "parent_id", F.col("node_id").alias("of_id"))
    return own.join(elements(nodes), ["page_id", "parent_id"]).where("node_id <> of_id")


def neighbours(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, previous_id, next_id) of elements among their siblings."""
    w = Window.partitionBy("page_id", "parent_id").orderBy("node_id")
    return elements(nodes).select("page_id", "node_id", F.lag("node_id").over(w).alias("previous_id"), F.lead("node_id").over(w).alias("next_id"))


# Search


def find_by_text(nodes: DataFrame, text: str, partial: bool = False, case: bool = False, full: bool = False, clean: bool = True) -> DataFrame:
    """Elements whose own (or full) text is, or holds, a text; any case unless told otherwise. White
    space of the asked text is normalised as the elements' is, if ``clean``."""
    own = F.col("text_full" if full else "text_direct")
    want = F.lit(tree.normal(text) if clean else text)
    if not case:
        own, want = F.lower(own), F.lower(want)
    return elements(nodes).where(own.contains(want) if partial else own == want)


def find_by_regex(nodes: DataFrame, pattern: str, case: bool = False) -> DataFrame:
    """Elements whose own text matches somewhere; any case unless told otherwise."""
    return elements(nodes).where(F.col("text_direct").rlike(pattern if case else "(?i)" + pattern))


def has_class(c: Column, name: str) -> Column:
    """Whether a class attribute holds a name."""
    return F.array_contains(F.split(F.coalesce(c, F.lit("")), r"\s+"), name)


def attributes_with(nodes: DataFrame, value: str, partial: bool = False) -> DataFrame:
    """(page_id, node_id, key, value) of attributes whose value is, or holds, a text."""
    each = elements(nodes).select("page_id", "node_id", F.explode("attr").alias("key", "value"))
    return each.where(F.col("value").contains(value) if partial else F.col("value") == value)
