"""Elements found again after a page has changed: fingerprints, weighted scores, relocation.

A fingerprint is a struct column; scores are column expressions over two of them, so relocation is an
equi-join of stored fingerprints with the elements of their pages, followed by ``max_by`` per key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from pagewright.dom import tree
from pagewright.dom.nodes import per_page
from pagewright.functions import text as T

FINGERPRINT = (
    "struct<tag:string,text:string,attributes:map<string,string>,parent_tag:string,parent_text:string,"
    "parent_attributes:map<string,string>,sibling_tags:array<string>,children_tags:array<string>,path_tags:array<string>>"
)
#: Weights of the components (fixed values), and of the parent's own.
WEIGHTS = {"tag": 0.22, "text": 0.22, "attribute_keys": 0.11, "attribute_values": 0.14, "parent": 0.12, "siblings": 0.05, "path": 0.07, "children": 0.07}
PARENT = {"tag": 0.35, "text": 0.25, "keys": 0.20, "values": 0.20}
ACCEPT = 0.65


def fingerprint_of(n: tree.Node) -> dict:
    attrs = lambda x: {k: tree.normal(v) for k, v in reversed(x.attrs)}
    up = n.parent if n.parent is not None and n.parent.kind == "element" else None
    return {
        "tag": n.tag,
        "text": tree.full_text(n),
        "attributes": list(attrs(n).items()),
        "parent_tag": up.tag if up else "",
        "parent_text": tree.direct_text(up) if up else "",
        "parent_attributes": list(attrs(up).items()) if up else [],
        "sibling_tags": [s.tag for s in n.siblings() if s is not n] if up else [],
        "children_tags": [c.tag for c in n.elements()],
        "path_tags": [a.tag for a in reversed(list(n.ancestors()))] + [n.tag],
    }


def element_fingerprints(pages: DataFrame, tags: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, url, node_id, depth, grandparent_tag, fp) of every element, or of those of some tags."""

    def rows(i: int, url: str | None, root: tree.Node) -> Iterator[tuple]:
        for n in root.walk():
            if n.kind == "element" and (not tags or n.tag in tags):
                above = list(n.ancestors())
                yield i, url, n.pre, n.depth, above[1].tag if len(above) > 1 else "", fingerprint_of(n)

    return per_page(pages, f"page_id long, url string, node_id int, depth int, grandparent_tag string, fp {FINGERPRINT}", rows)


@F.pandas_udf(DoubleType())
def sequence_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Longest common subsequence over the longer length; both empty 1, one empty 0."""

    def one(x, y) -> float:
        x, y = list(x) if x is not None else [], list(y) if y is not None else []
        if not x or not y:
            return float(not x and not y)
        if x == y:
            return 1.0
        row = [0] * (len(y) + 1)
        for p in x:
            last = 0
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if p == q else max(row[j], row[j - 1])
        return row[-1] / max(len(x), len(y))

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def key_similarity(a: Column, b: Column) -> Column:
    return T.jaccard(F.transform(F.map_keys(a), F.lower), F.transform(F.map_keys(b), F.lower))


def value_similarity(a: Column, b: Column) -> Column:
    words = lambda m: F.array_distinct(F.flatten(F.transform(F.map_values(m), T.tokens)))
    return T.jaccard(words(a), words(b))


def components(candidate: Column, target: Column) -> list[tuple[str, float, Column]]:
    """(name, weight, similarity) of the eight parts of a score."""
    c, t = candidate, target
    same = lambda a, b: (F.lower(a) == F.lower(b)).cast("double")
    parent = (
        PARENT["tag"] * same(c["parent_tag"], t["parent_tag"])
        + PARENT["text"] * T.string_similarity(c["parent_text"], t["parent_text"])
        + PARENT["keys"] * key_similarity(c["parent_attributes"], t["parent_attributes"])
        + PARENT["values"] * value_similarity(c["parent_attributes"], t["parent_attributes"])
    )
    parts = {
        "tag": same(c["tag"], t["tag"]),
        "text": T.string_similarity(c["text"], t["text"]),
        "attribute_keys": key_similarity(c["attributes"], t["attributes"]),
        "attribute_values": value_similarity(c["attributes"], t["attributes"]),
        "parent": parent,
        "siblings": sequence_similarity(c["sibling_tags"], t["sibling_tags"]),
        "path": sequence_similarity(c["path_tags"], t["path_tags"]),
        "children": sequence_similarity(c["children_tags"], t["children_tags"]),
    }
    return [(k, WEIGHTS[k], parts[k]) for k in WEIGHTS]


def score(candidate: Column, target: Column) -> Column:
    """The weighted sum of the components, from 0 to 1."""
    out = F.lit(0.0)
    for _, w, s in components(candidate, target):
        out = out + F.lit(w) * s
    return out


def percentage(p: float) -> float:
    """The least score that a percentage stands for: 0 is the default, above 100 or below 0 an error."""
    if not 0 <= p <= 100:
        raise ValueError("percentage must lie between 0 and 100")
    return p / 100 if p else ACCEPT


def diagnose(elements: DataFrame, stored: DataFrame, least: float = ACCEPT) -> DataFrame:
    """(page_id, identifier, node_id, components, score, rank, accepted, reason) of all candidates; the reason
    of a refusal is "below the least score" or "not the best".

    ``elements`` are fingerprints with a domain, ``stored`` (domain, identifier, fp). The join is on
    the domain; a page's candidates are ranked by score, ties in document order.
    """
    target = stored.select("domain", "identifier", F.col("fp").alias("target"))
    both = elements.join(target, "domain")
    parts = components(F.col("fp"), F.col("target"))
    scored = both.select("page_id", "identifier", "node_id", *[s.alias(f"s_{n}") for n, _, s in parts])
    total = F.lit(0.0)
    for n, w, _ in parts:
        total = total + F.lit(w) * F.col(f"s_{n}")
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.col(f"s_{n}").alias("score"), (F.lit(w) * F.col(f"s_{n}")).alias("contribution")) for n, w, _ in parts])
    w = Window.partitionBy("page_id", "identifier").orderBy(F.desc("score"), "node_id")
    out = scored.select("page_id", "identifier", "node_id", each.alias("components"), F.round(total, 12).alias("score"))
    out = out.withColumn("rank", F.row_number().over(w)).withColumn("accepted", (F.col("rank") == 1) & (F.col("score") >= least))
    return out.withColumn("reason", F.when(F.col("accepted"), "").when(F.col("score") < least, "below the least score").otherwise("not the best"))


def relocate(elements: DataFrame, stored: DataFrame, least: float = ACCEPT) -> DataFrame:
    """(page_id, identifier, node_id, score): the best candidate of each page and key, if it is good
    enough; the first in document order among equals. Only the best of each group is kept on the way."""
    target = stored.select("domain", "identifier", F.col("fp").alias("target"))
    scored = elements.join(target, "domain").select("page_id", "identifier", "node_id", F.round(score(F.col("fp"), F.col("target")), 12).alias("score"))
    best = scored.groupBy("page_id", "identifier").agg(F.max(F.struct("score", (-F.col("node_id")).alias("n"))).alias("b"))
    return best.select("page_id", "identifier", (-F.col("b.n")).alias("node_id"), F.col("b.score").alias("score")).where(F.col("score") >= least)


def similar(elements: DataFrame, asked: DataFrame | None = None, least: float = 0.2, ignore: tuple[str, ...] = ("href", "src"), with_text: bool = False) -> DataFrame:
    """(page_id, node_id, other_id, score) of similar elements of a page: same tag, depth, parent's and
    grandparent's tag, and attributes that agree in names and words. With ``asked`` (page_id, node_id)
    only the elements similar to those are looked for."""
    kept = lambda m: F.map_filter(m, lambda k, v: ~F.lower(k).isin(*ignore)) if ignore else m
    side = elements.select("page_id", "node_id", "depth", "grandparent_tag", F.col("fp.tag").alias("tag"), F.col("fp.parent_tag").alias("up"), kept(F.col("fp.attributes")).alias("attrs"), F.col("fp.text").alias("text"))
    mine = side if asked is None else side.join(asked.select("page_id", "node_id").distinct(), ["page_id", "node_id"], "left_semi")
    other = side.withColumnsRenamed({"node_id": "other_id", "attrs": "other_attrs", "text": "other_text"})
    both = mine.join(other, ["page_id", "tag", "depth", "up", "grandparent_tag"]).where("node_id <> other_id")
    s = (key_similarity(F.col("attrs"), F.col("other_attrs")) + value_similarity(F.col("attrs"), F.col("other_attrs"))) / 2
    if with_text:
        s = (s + T.string_similarity(F.col("text"), F.col("other_text"))) / 2
    return both.select("page_id", "node_id", "other_id", F.round(s, 12).alias("score")).where(F.col("score") >= least)


def select_adaptive(pages: DataFrame, selector: str, identifier: str, stored: DataFrame | None, least: float = ACCEPT) -> tuple[DataFrame, DataFrame]:
    """(found, to_save): elements that a selector selects and, on pages where it selects none, the
    relocated element of the stored fingerprint.

    ``found`` is (page_id, node_id, relocated), ``to_save`` (domain, identifier, fp) of each domain's
    first hit, for ``upsert``. Each page is parsed once for fingerprints and once for the selector.
    """
    from pagewright.dom.nodes import select_all
    from pagewright.functions import urls

    if stored is None:
        raise ValueError("adaptive selection needs a store")
    if not identifier.strip():
        raise ValueError("an identifier is required")
    hits = select_all(pages, {identifier: selector}).select("page_id", "node_id").distinct()
    fps = element_fingerprints(pages).withColumn("domain", urls.adaptive_domain(F.col("url"))).drop("url")
    missed = fps.join(hits.select("page_id"), "page_id", "left_anti")
    again = relocate(missed, stored.where(F.col("identifier") == identifier), least)
    found = hits.withColumn("relocated", F.lit(False)).unionByName(again.select("page_id", "node_id", F.lit(True).alias("relocated")))
    first = fps.join(hits, ["page_id", "node_id"]).groupBy("domain").agg(F.min_by("fp", F.struct("page_id", "node_id")).alias("fp"))
    return found, first.select("domain", F.lit(identifier).alias("identifier"), "fp")


# Stores of fingerprints: (domain, identifier, fp, version)


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with newer fingerprints in place of older ones of the same key, the last by aggregation;
    a null or blank identifier is an error."""
    name = F.trim("identifier")
    name = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.raise_error(F.lit("an identifier is required")).cast("string"))
    every = store.unionByName(new).withColumn("identifier", name)
    return every.groupBy("domain", "identifier").agg(F.max_by("fp", "version").alias("fp"), F.max("version").alias("version"))


SCHEMA_VERSION = 1


def write_store(store: DataFrame, path: str) -> None:
    """JSON lines with the schema's version, sorted by key within files."""
    store.withColumn("schema_version", F.lit(SCHEMA_VERSION)).sortWithinPartitions("domain", "identifier").write.mode("overwrite").json(path)


def read_store(spark, path: str) -> DataFrame:
    """A written store; another schema version is an error, a missing path an empty store."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"domain string, identifier string, fp {FINGERPRINT}, version long")
    df = spark.read.schema(f"schema_version int, domain string, identifier string, fp {FINGERPRINT}, version long").json(path)
    version = F.when(F.col("schema_version") == SCHEMA_VERSION, F.col("version")).otherwise(F.raise_error(F.concat(F.lit("unsupported store schema "), F.col("schema_version").cast("string"))).cast("long"))
    return df.withColumn("version", version).drop("schema_version")


def export_database(store: DataFrame, path: str) -> None:
    """A store as a one-file database: a row for each key with the fingerprint as JSON. An existing
    file keeps its other keys; rows come to the driver one batch at a time."""
    import sqlite3

    with sqlite3.connect(path) as db:
        version = db.execute("pragma user_version").fetchone()[0]
        if version not in (0, SCHEMA_VERSION):
            raise ValueError(f"unsupported store schema {version}")
        db.execute("create table if not exists fingerprints (domain text, identifier text, element text, version integer, unique (domain, identifier))")
        db.execute(f"pragma user_version = {SCHEMA_VERSION}")
        rows = store.select("domain", F.trim("identifier").alias("identifier"), F.to_json("fp").alias("fp"), "version").where("identifier <> ''")
        for r in rows.toLocalIterator():
            db.execute(
                "insert into fingerprints values (?, ?, ?, ?) on conflict (domain, identifier) do update set element = excluded.element, version = excluded.version where excluded.version >= version",
                tuple(r),
            )


def import_database(spark, path: str) -> DataFrame:
    """A store read from a one-file database; another schema version is an error, a missing file is empty."""
    import sqlite3
    from pathlib import Path

    rows: list[tuple] = []
    if Path(path).exists():
        with sqlite3.connect(path) as db:
            version = db.execute("pragma user_version").fetchone()[0]
            if version != SCHEMA_VERSION:
                raise ValueError(f"unsupported store schema {version}")
            rows = db.execute("select domain, identifier, element, version from fingerprints").fetchall()
    raw = spark.createDataFrame(rows, "domain string, identifier string, element string, version long")
    return raw.select("domain", "identifier", F.from_json("element", FINGERPRINT).alias("fp"), "version")
