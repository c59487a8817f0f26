"""Fetches by an engine of one's own: a browser, an HTTP client, a fixture.

The engine is a plug point. A factory is called in each task, its pages are kept in a pool of fixed
size there, and what goes wrong in one request is that row's error and ends no job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Page(Protocol):
    """A page of an engine. ``fetch`` gives status, html and captured requests (url, status, body)."""

    def fetch(self, url: str, options: dict[str, Any]) -> tuple[int, str, list[tuple[str, int, str]]]: ...

    def close(self) -> None: ...


class Engine(Protocol):
    """Makes pages, one for each place in the pool."""

    def page(self) -> Page: ...


class Store(Protocol):
    """Where fingerprints are kept: all of them as rows, and newer ones put in."""

    def load(self) -> DataFrame: ...

    def save(self, new: DataFrame) -> None: ...


class Pool:
    """Pages of an engine, at most ``size`` of them; a page on which a fetch failed is closed and made anew
    when it is needed. ``counts`` tells how many were ready, busy and failed so far."""

    def __init__(self, engine: Engine, size: int) -> None:
        if size < 1:
            raise ValueError("a pool needs at least one page")
        self.engine, self.size = engine, size
        self.ready: list[Page] = []
        self.busy = self.failed = self.made = 0

    def fetch(self, url: str, options: dict[str, Any]) -> tuple[int, str, list[tuple[str, int, str]]]:
        if not self.ready:
            if self.busy >= self.size:
                raise RuntimeError("no page is free")
            self.ready.append(self.engine.page())
            self.made += 1
        page = self.ready.pop()
        self.busy += 1
        try:
            got = page.fetch(url, options)
        except BaseException:
            self.failed += 1
            page.close()
            raise
        else:
            self.ready.append(page)
            return got
        finally:
            self.busy -= 1

    @property
    def counts(self) -> dict[str, int]:
        return {"ready": len(self.ready), "busy": self.busy, "failed": self.failed}

    def close(self) -> None:
        while self.ready:
            self.ready.pop().close()


SCHEMA = "request_id long, url string, status int, html string, xhr array<struct<url:string,status:int,body:string>>, error string"


def rendered(requests: DataFrame, factory: Callable[[], Engine], concurrency: int = 4, options: dict[str, Any] | None = None) -> DataFrame:
    """Requests (request_id, url) fetched by an engine, one row each: status, html, captured requests,
    error. ``concurrency`` is the number of tasks at a time that each hold one page (0 or less: 4); the
    id gives rows back their order. A null or blank URL is an error of its row."""
    tasks = concurrency if concurrency > 0 else 4

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pool = None
        try:
            for f in frames:
                out = []
                for i, url in zip(f["request_id"], f["url"], strict=True):
                    if not isinstance(url, str) or not url.strip():
                        out.append((i, url, None, None, [], "url is required"))
                        continue
                    pool = pool or Pool(factory(), 1)
                    try:
                        status, html, xhr = pool.fetch(url.strip(), options or {})
                        out.append((i, url, status, html, [{"url": u, "status": s, "body": b} for u, s, b in xhr], None))
                    except Exception as e:
                        out.append((i, url, None, None, [], f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(out, columns=["request_id", "url", "status", "html", "xhr", "error"]).astype({"status": "Int32"})
        finally:
            if pool:
                pool.close()

    return requests.select(F.col("request_id").cast("long"), "url").repartition(tasks).mapInPandas(run, SCHEMA)


def captured(fetched: DataFrame) -> DataFrame:
    """(request_id, ord, url, status, body): captured requests as rows."""
    return fetched.select("request_id", F.posexplode("xhr").alias("ord", "x")).select("request_id", "ord", "x.*")
