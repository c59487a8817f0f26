"""Nested records as related flat tables.

Each JSON object becomes a row that carries its own surrogate key (page and node path), its parent's,
the name of the member it hangs on, its ordinal in the innermost list and its ordinals: the places in
all lists between it and its parent, the outer first. Scalars in lists become rows of the same kind, with a value instead of fields. The
*schema path* of a node is its node path with every list place replaced by ``[]``; nodes of one schema
path form one child table, whose columns are the merged schema of all records: every member that holds a
scalar anywhere.

The merged schema is an aggregation over all nodes, and ``explode_level`` gives the children that hang on
one array level, so a schema's tables are made from what is found rather than from a fixed list.

Defined results: null and blank elements, elements that aren't strictly valid JSON (``NaN``, trailing
commas, comments, a second value) and elements whose top isn't an object give no rows but keep their
place in the count. Of a repeated member the last one counts. Nesting may be of any depth. Extra
columns of the input play no part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import spread

NODES = "page_id long, node_path string, parent_path string, schema_path string, member string, ordinal int, ordinals array<int>, kind string, value string, fields map<string,string>, kinds map<string,string>"
_SCALAR = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null', re.ASCII)
_BLANK = re.compile(r"[ \t\n\r]*")


class Number(str):
    """A number, as it is written."""


def _refuse(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_constant=_refuse, parse_int=Number, parse_float=Number)


def strict_object(text: str | None) -> dict | None:
    """The object that a text holds as a whole; none if it isn't strictly valid or no object."""
    if not text:
        return None
    try:
        value = _decoder.decode(text)
    except ValueError:
        return None
    except RecursionError:
        value = _deep(text)
    return value if isinstance(value, dict) else None


def _deep(text: str):
    """The same for nesting deeper than the decoder's stack: containers wait on a list."""
    missing = object()
    stack: list = []
    value, i = missing, _BLANK.match(text, 0).end()
    try:
        while True:
            # a value begins at i
            c = text[i]
            if c in "{[":
                made: dict | list = {} if c == "{" else []
                stack.append((made, None))
                i = _BLANK.match(text, i + 1).end()
                if text[i] in "}]":
                    if text[i] != ("}" if c == "{" else "]"):
                        return None
                    value, i = stack.pop()[0], i + 1
                else:
                    value = missing
            else:
                m = _SCALAR.match(text, i)
                if not m:
                    return None
                value, i = _decoder.decode(m[0]), m.end()
            while value is not missing:
                i = _BLANK.match(text, i).end()
                if not stack:
                    return value if i == len(text) else None
                holder, key = stack[-1]
                if isinstance(holder, dict):
                    holder[key] = value
                else:
                    holder.append(value)
                end = "}" if isinstance(holder, dict) else "]"
                if text[i] == end:
                    value, i = stack.pop()[0], i + 1
                elif text[i] == ",":
                    value, i = missing, _BLANK.match(text, i + 1).end()
                else:
                    return None
            holder = stack[-1][0]
            if isinstance(holder, dict):
                m = _SCALAR.match(text, i)
                if not m or m[0][0] != '"':
                    return None
                i = _BLANK.match(text, m.end()).end()
                if text[i] != ":":
                    return None
                stack[-1] = (holder, _decoder.decode(m[0]))
                i = _BLANK.match(text, i + 1).end()
    except IndexError:
        return None


def _kind(v) -> str:
    return "number" if isinstance(v, Number) else "string" if isinstance(v, str) else "boolean" if isinstance(v, bool) else "null" if v is None else "object" if isinstance(v, dict) else "list"


def _text(v) -> str | None:
    return None if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def flat_rows(element: int, top: dict) -> Iterator[tuple]:
    """(node_path, parent_path, schema_path, member, ordinal, ordinals, kind, value, fields, kinds) of all
    objects and of all scalars in lists."""
    todo = [(top, f"$[{element}]", "", "$[]", None, [element])]
    while todo:
        node, path, parent, schema, member, ordinals = todo.pop()
        fields, kinds = {}, {}
        for k, v in node.items():
            kinds[k] = _kind(v)
            if isinstance(v, dict):
                todo.append((v, f"{path}.{k}", path, f"{schema}.{k}", k, []))
            elif isinstance(v, list):
                inner = [(v, f"{path}.{k}", f"{schema}.{k}", [])]
                while inner:
                    items, at, kind, above = inner.pop()
                    for j, x in enumerate(items):
                        if isinstance(x, dict):
                            todo.append((x, f"{at}[{j}]", path, f"{kind}[]", k, [*above, j]))
                        elif isinstance(x, list):
                            inner.append((x, f"{at}[{j}]", f"{kind}[]", [*above, j]))
                        else:
                            yield f"{at}[{j}]", path, f"{kind}[]", k, j, [*above, j], _kind(x), _text(x), [], []
            elif v is not None:
                fields[k] = _text(v)
        yield path, parent, schema, member, ordinals[-1] if ordinals else None, ordinals, "object", None, list(fields.items()), list(kinds.items())


_ARROW = pa.schema(
    [("page_id", pa.int64()), *((c, pa.string()) for c in ("node_path", "parent_path", "schema_path", "member")), ("ordinal", pa.int32()), ("ordinals", pa.list_(pa.int32())), ("kind", pa.string()), ("value", pa.string())]
    + [(c, pa.map_(pa.string(), pa.string())) for c in ("fields", "kinds")]
)


def json_nodes(df: DataFrame, id_column: str, elements_column: str, items: bool = False) -> DataFrame:
    """One row for each JSON object at any depth in the elements (texts) of each record; with ``items`` also
    for each scalar in a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, elements in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for e, text in enumerate(elements or []):
                    top = strict_object(text)
                    if top is not None:
                        rows.extend((i, *r) for r in flat_rows(e, top) if items or r[6] == "object")
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return spread(df.select(F.col(id_column).cast("long"), elements_column)).mapInArrow(run, NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    clean = lambda v: v if not isinstance(v, str) else v.encode("utf-8", "replace").decode()  # noqa: E731 (lone surrogates can't be stored)
    arrays = []
    for values, field in zip(columns, _ARROW, strict=True):
        if field.type == pa.string():
            values = [clean(v) for v in values]
        elif pa.types.is_map(field.type):
            values = [[(clean(k), clean(v)) for k, v in m] for m in values]
        arrays.append(pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW)


def map_nodes(df: DataFrame, id_column: str, map_column: str, prefix: str) -> DataFrame:
    """One row for each key of a map of colon-separated keys; the parent is the key up to the last
    colon if that is a key too. A null map gives nothing."""
    rows = df.select(F.col(id_column).cast("long").alias("page_id"), F.col(map_column).alias("m"), F.explode(map_column).alias("k", "v"))
    up = F.regexp_extract("k", r"(?s)^(.*):[^:]*$", 1)
    has = F.col("k").contains(":") & F.array_contains(F.map_keys("m"), up)
    member = F.regexp_extract("k", r"(?s)([^:]*)$", 1)
    path = F.concat(F.lit(prefix), F.col("k"))
    nothing = F.create_map().cast("map<string,string>")
    return rows.select(
        "page_id",
        path.alias("node_path"),
        F.when(has, F.concat(F.lit(prefix), up)).otherwise("").alias("parent_path"),
        path.alias("schema_path"),
        member.alias("member"),
        F.lit(None).cast("int").alias("ordinal"),
        F.array().cast("array<int>").alias("ordinals"),
        F.lit("object").alias("kind"),
        F.lit(None).cast("string").alias("value"),
        F.when(F.col("v").isNull(), nothing).otherwise(F.create_map(F.lit("content"), F.col("v"))).alias("fields"),
        F.create_map(F.lit("content"), F.when(F.col("v").isNull(), "null").otherwise("string")).alias("kinds"),
    )


def objects(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind = 'object'")


def list_items(nodes: DataFrame) -> DataFrame:
    """(page_id, node_path, parent_path, member, ordinals, kind, value) of scalars in lists."""
    return nodes.where("kind <> 'object'").select("page_id", "node_path", "parent_path", "member", "ordinals", "kind", "value")


def merged_schema(nodes: DataFrame) -> DataFrame:
    """(schema_path, field, kind, n): how often each member was of each kind in each child table; scalars of
    a list have the field ''."""
    members = nodes.where("kind = 'object'").select("schema_path", F.explode("kinds").alias("field", "kind"))
    items = nodes.where("kind <> 'object'").select("schema_path", F.lit("").alias("field"), "kind")
    return members.unionByName(items).groupBy("schema_path", "field", "kind").agg(F.count("*").alias("n"))


def explode_level(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The nodes one level below some nodes (page_id, node_path): children with their parent's key, their
    member and their ordinals. Both sides share the partitioning on the page."""
    up = parents.select("page_id", F.col("node_path").alias("parent_path"))
    return nodes.join(up, ["page_id", "parent_path"], "left_semi")


def child_table(nodes: DataFrame, schema_path: str, fields: list[str] | None = None) -> DataFrame:
    """The child table of a schema path: keys, links and one text column for each scalar member.

    ``fields`` defaults to the merged schema of the path (its size is the number of distinct members,
    not of rows). A member is null where it is missing, null or no scalar.
    """
    own = objects(nodes).where(F.col("schema_path") == schema_path)
    if fields is None:
        found = own.select(F.explode(F.map_keys("fields")).alias("f")).distinct().orderBy("f").toArrow().column(0).to_pylist()
        fields = list(found)
    links = ["page_id", "node_path", "parent_path", "ordinal"]
    taken = {c.lower() for c in links}
    names = []
    for f in fields:  # a member may be called as a link column or differ from another by case only
        name = f
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return own.select(*links, *[F.try_element_at("fields", F.lit(f)).alias(n) for f, n in zip(fields, names, strict=True)])
