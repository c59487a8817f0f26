"""Sitemap documents as rows."""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that a document may have after unpacking (the format's own bound is 50 MB).
LIMIT = 64 << 20


def unpacked(body: bytes, content_type: str = "") -> bytes:
    """A gzipped document, told by its first bytes, unpacked; one of more than LIMIT bytes is an error."""
    if body[:2] == b"\x1f\x8b":
        body = zlib.decompressobj(31).decompress(body, LIMIT + 1)
    if len(body) > LIMIT:
        raise ValueError(f"a sitemap has more than {LIMIT} bytes")
    return body


def parse_sitemap(body: bytes, content_type: str = "", alternates: bool = False) -> Iterator[tuple[str, str]]:
    """(kind, url): "url" and "sitemap" for locations right under such an element, "alternate" for
    links of other languages. Locations of extensions, deeper down, don't count; a broken document
    gives what came before the break."""
    above: list[str] = []
    try:
        for event, e in ET.iterparse(io.BytesIO(unpacked(body, content_type)), ("start", "end")):
            tag = e.tag.rpartition("}")[2].lower()
            if event == "start":
                above.append(tag)
                if alternates and tag == "link" and above[-2:-1] == ["url"] and e.get("rel", "").lower() == "alternate" and e.get("href", "").strip():
                    yield "alternate", e.get("href", "").strip()
                continue
            above.pop()
            if tag == "loc" and above[-1:] and above[-1] in ("url", "sitemap") and (e.text or "").strip():
                yield above[-1], e.text.strip()
            if tag in ("url", "sitemap"):
                e.clear()
    except ET.ParseError:
        return


def sitemap_urls(documents: DataFrame, alternates: bool = False) -> DataFrame:
    """(origin, ord, kind, url) of documents (origin, body binary, content_type). A null body has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (o, i, k, u)
                for o, body, kind in zip(*(c.to_pylist() for c in b.columns), strict=True)
                if body
                for i, (k, u) in enumerate(parse_sitemap(body, kind or "", alternates), 1)
            ]
            columns = [*zip(*rows, strict=True)] or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.string(), pa.string()], strict=True)], names=["origin", "ord", "kind", "url"])

    return documents.select(F.col("origin").cast("string"), F.col("body").cast("binary"), "content_type").mapInArrow(run, "origin string, ord int, kind string, url string")
