"""Responses, their cache, and pages as sources and sinks."""

from __future__ import annotations

import codecs
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@lru_cache(maxsize=1024)
def _codec(name: str | None) -> str:
    try:
        return codecs.lookup((name or "").strip() or "utf-8").name
    except (LookupError, ValueError):
        return "utf-8"


@F.pandas_udf(StringType())
def decoded(body: pd.Series, encoding: pd.Series) -> pd.Series:
    """Bytes as text in an encoding (null, blank, unknown: UTF-8); what can't be read is U+FFFD."""
    return pd.Series([None if b is None else bytes(b).decode(_codec(e), "replace") for b, e in zip(body, encoding, strict=True)], dtype=object)


_HEADERS = "map<string,array<string>>"


def header(headers: Column, name: str) -> Column:
    """The first value of a header, whatever the case of its name; null without one."""
    entries = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.try_element_at(F.try_element_at(entries, F.lit(1))["value"], F.lit(1))


def responses(cache: DataFrame) -> DataFrame:
    """Cached records as responses: text, media type, encoding and the defaults of missing parts.

    Cookies, headers and request headers are empty where they are missing; ``history`` is empty, since a
    cached record is what came last, and ``xhr`` as well.

    The encoding is the record's own, else the charset of its content type, else UTF-8; the method is
    GET unless told otherwise.
    """
    kind = header(F.col("headers"), "content-type")
    charset = F.nullif(F.lower(F.regexp_extract(kind, r"(?i)charset\s*=\s*\"?([^\s;\"]+)", 1)), F.lit(""))
    encoding = F.coalesce(F.nullif(F.trim("encoding"), F.lit("")), charset, F.lit("utf-8"))
    body = F.try_to_binary("content", F.lit("base64"))
    return cache.select(
        "record_id",
        F.trim("url").alias("url"),
        "status",
        "reason",
        F.coalesce(F.nullif(F.upper("method"), F.lit("")), F.lit("GET")).alias("method"),
        F.lower(F.trim(F.substring_index(kind, ";", 1))).alias("media_type"),
        encoding.alias("encoding"),
        body.alias("body"),
        decoded(body, encoding).alias("text"),
        *[F.coalesce(F.col(c), F.create_map().cast(_HEADERS)).alias(c) for c in ("headers", "request_headers") if c in cache.columns],
        *[F.coalesce(F.col(c), F.array().cast(cache.schema[c].dataType)).alias(c) for c in ("cookies",) if c in cache.columns],
        F.array().cast("array<string>").alias("history"),
        F.array().cast("array<struct<url:string,status:int,body:string>>").alias("xhr"),
        "stored_at",
    )


def as_pages(resp: DataFrame) -> DataFrame:
    """(page_id, url, html) of responses that hold markup."""
    return resp.where(F.col("media_type").isNull() | F.col("media_type").isin("text/html", "application/xhtml+xml")).select(F.col("record_id").alias("page_id"), "url", F.col("text").alias("html"))


def cache_lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of requests (with fp) in a cache (with fp): an inner and an anti-join. A cached
    response answers each request of its fingerprint; of several the one stored last does."""
    rest = [c for c in cache.columns if c not in requests.columns]
    newest = cache.where("fp is not null").groupBy("fp").agg(F.max_by(F.struct(*rest), F.col("stored_at") if "stored_at" in cache.columns else F.col(rest[0])).alias("__r"))
    hits = requests.join(newest, "fp").select(*requests.columns, *[F.col("__r")[c].alias(c) for c in rest])
    return hits, requests.join(newest.select("fp"), "fp", "left_anti")


def cache_counters(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(hits, misses): how many requests a cache answers."""
    known = cache.select("fp", F.lit(1).alias("__hit")).where("fp is not null").distinct()
    return requests.join(known, "fp", "left").agg(F.count("__hit").alias("hits"), F.count(F.when(F.col("__hit").isNull(), 1)).alias("misses"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as pages, one page a file; ids are hashes of the paths."""
    files = spark.read.text(path, wholetext=True).withColumn("url", F.input_file_name())
    return files.select(F.xxhash64("url").alias("page_id"), "url", F.col("value").alias("html"))


def write_json_lines(items: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as partitions."""
    items.write.mode("overwrite").json(path)


def write_json_array(items: DataFrame, path: str, order: str, indent: bool = False) -> None:
    """One file that holds all items as one JSON array, two blanks deep if ``indent``; no items are ``[]``.

    Rows are written as they come from sorted partitions, one at a time, so the driver never holds more
    than a batch. The format is one file by definition; large lists belong into ``write_json_lines``.
    """
    import json
    from pathlib import Path

    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    rows = items.orderBy(order).select(F.to_json(F.struct(*items.columns), {"ignoreNullFields": "false"}).alias("j"))
    with target.open("w", encoding="utf-8") as f:
        first = True
        for r in rows.toLocalIterator():
            text = r["j"]
            if indent:
                text = json.dumps(json.loads(text), indent=2, ensure_ascii=False).replace("\n", "\n  ")
            f.write(("[" if first else ",") + ("\n  " if indent else "") + text)
            first = False
        f.write("[]" if first else "\n]" if indent else "]")


def view_file(page: DataFrame, path: str) -> str:
    """The body of one page (page_id, html) written to a file; its path. Several pages are an error."""
    from pathlib import Path

    rows = page.select("html").limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a view needs exactly one page")
    Path(path).write_text(rows[0]["html"] or "", encoding="utf-8")
    return path


def scraped(items: DataFrame, process: Callable[[Column], Column], column: str = "item") -> tuple[DataFrame, DataFrame]:
    """(kept, counters) of items put through a hook, a column expression that gives the replacement or null
    for an item to be dropped; counters are (kept, dropped)."""
    done = items.withColumn(column, process(F.col(column)))
    kept = done.where(F.col(column).isNotNull())
    return kept, done.agg(F.count(column).alias("kept"), (F.count("*") - F.count(column)).alias("dropped"))


def merged_meta(a: Column, b: Column) -> Column:
    """Two maps as one; the second's values count."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
