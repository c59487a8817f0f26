"""Requests as rows: preparation, session defaults, adapters, proxies, safety checks and typed errors.

Every function takes a DataFrame of requests and returns it with more columns. What the data of a row
makes wrong becomes an ``error`` column; what the options alone make wrong is raised on the driver.
"""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.operators.robots import literal_check

HEADERS = "map<string,array<string>>"
# Headers that a request pretends a browser with, where they aren't set.
BROWSER_HEADERS = {
    "User-Agent": "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/147.0.0.0 Safari/537.36",
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.9",
    "Referer": "https://www.google.com/",
    "Upgrade-Insecure-Requests": "1",
}
#: Error kinds (fixed values).
KINDS = ("private_redirect", "redirect", "timeout", "proxy", "retry_exhausted", "robots", "private_address")


def _headers(c: Column) -> Column:
    return F.coalesce(c.cast(HEADERS), F.create_map().cast(HEADERS))


def merged_headers(defaults: Column, own: Column) -> Column:
    """Headers of both; where names agree in any case, the second's count."""
    defaults, own = _headers(defaults), _headers(own)
    names = F.transform(F.map_keys(own), F.lower)
    return F.map_concat(F.map_filter(defaults, lambda k, v: ~F.array_contains(names, F.lower(k))), own)


def browser_headers(own: Column) -> Column:
    """Headers with a browser's where they are missing."""
    defaults = F.create_map(*[x for k, v in BROWSER_HEADERS.items() for x in (F.lit(k), F.array(F.lit(v)))])
    return merged_headers(defaults, own)


def prepare(requests: DataFrame, params: dict[str, list[str]] | None = None, stealthy: bool = False, impersonate: str = "", http3: bool = False) -> DataFrame:
    """Requests (url, headers, body, data, json) made ready: ``url`` with parameters, ``body`` and
    ``headers`` with the content type of its kind, ``error``.

    ``data`` is a map of form fields to value lists, ``json`` a text; of the three at most one may be
    set, else the row has an error and a null body. A URL that can't be parsed is an error as well.
    Pretending a browser's TLS or HTTP/3 is refused.
    """
    if impersonate.strip():
        raise ValueError("TLS fingerprints can't be impersonated")
    if http3:
        raise ValueError("HTTP/3 isn't available")
    form = F.size(F.coalesce("data", F.create_map().cast(HEADERS))) > 0
    given = F.col("body").isNotNull().cast("int") + form.cast("int") + F.col("json").isNotNull().cast("int")
    coded = lambda x: F.replace(F.url_encode(x), F.lit("%20"), F.lit("+"))
    fields = F.array_sort(F.map_keys("data"))
    pairs = F.flatten(F.transform(fields, lambda k: F.transform(F.col("data")[k], lambda v: F.concat(coded(k), F.lit("="), coded(v)))))
    body = F.when(given > 1, None).when(form, F.array_join(pairs, "&")).otherwise(F.coalesce("body", "json"))
    kind = F.when(form, "application/x-www-form-urlencoded").when(F.col("json").isNotNull(), "application/json")
    has_kind = F.exists(F.map_keys(_headers(F.col("headers"))), lambda k: F.lower(k) == "content-type")
    headers = F.when(kind.isNotNull() & ~has_kind, merged_headers(F.create_map(F.lit("Content-Type"), F.array(kind)), F.col("headers"))).otherwise(_headers(F.col("headers")))
    url = urls.append_params(F.col("url"), params or {}) if params else F.col("url")
    out = requests.withColumns({"__url": url, "__body": body, "__headers": browser_headers(headers) if stealthy else headers})
    error = F.when(given > 1, "body, data and json exclude each other").when(F.col("__url").isNull(), "broken url")
    out = out.withColumn("error", error)
    return out.withColumns({"url": "__url", "body": "__body", "headers": "__headers"}).drop("__url", "__body", "__headers")


def cookie_header(cookies: Column, values: Column) -> Column:
    """The Cookie header of explicit cookies (array of name and value) and a map of values: those of the
    map first, by name, unless an explicit one has the name; nameless ones don't count."""
    explicit = F.filter(F.coalesce(cookies, F.array().cast("array<struct<name:string,value:string>>")), lambda c: F.coalesce(c["name"], F.lit("")) != "")
    names = F.transform(explicit, lambda c: c["name"])
    rest = F.filter(F.array_sort(F.map_keys(F.coalesce(values, F.create_map().cast("map<string,string>")))), lambda k: (k != "") & ~F.array_contains(names, k))
    pair = lambda k, v: F.concat(k, F.lit("="), F.coalesce(v, F.lit("")))
    return F.array_join(F.concat(F.transform(rest, lambda k: pair(k, values[k])), F.transform(explicit, lambda c: pair(c["name"], c["value"]))), "; ")


@dataclass(frozen=True)
class Session:
    """Defaults of a session. A proxy and a list to rotate exclude each other."""

    sid: str
    headers: dict[str, list[str]] = field(default_factory=dict)
    proxy: str = ""
    rotate: tuple[str, ...] = ()
    flags: frozenset[str] = frozenset()

    def __post_init__(self) -> None:
        if self.proxy and self.rotate:
            raise ValueError("a proxy and proxies to rotate exclude each other")


def with_session(requests: DataFrame, sessions: list[Session]) -> DataFrame:
    """Requests (sid, headers, proxy) with the defaults of their session: headers of the request replace
    the session's of the same name; its proxy is taken where the request has none. Rows of an unknown
    session stay as they are. The sessions are constants of the plan, so there is no join."""
    headers, proxy = _headers(F.col("headers")), F.nullif(F.trim("proxy"), F.lit(""))
    for s in sessions:
        own = F.col("sid") == s.sid
        defaults = F.create_map(*[x for k, v in s.headers.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if s.headers else F.create_map()
        headers = F.when(own, merged_headers(defaults, F.col("headers"))).otherwise(headers)
        if s.proxy:
            proxy = F.when(own & proxy.isNull(), F.lit(s.proxy)).otherwise(proxy)
    return requests.withColumns({"headers": headers, "proxy": proxy})


def latest_cookies(responses: DataFrame) -> DataFrame:
    """(sid, name, value): the jar of each session, the last value set for each cookie. ``responses`` has
    sid, response_id (the order) and cookies. The last one is taken by aggregation, so no session is hot."""
    each = responses.select("sid", "response_id", F.posexplode("cookies").alias("pos", "cookie")).where("cookie.name <> ''")
    last = each.groupBy("sid", F.col("cookie.name").alias("name")).agg(F.max_by("cookie.value", F.struct("response_id", "pos")).alias("value"))
    return last.select("sid", "name", "value")


def adapted(requests: DataFrame, session: Session, meta: str = "meta") -> DataFrame:
    """Requests as a session's adapter sends them: ``proxy`` is that of the request's meta (the entry of
    the URL's scheme in ``proxies`` before ``proxy``), else the session's own, else the next to rotate;
    ``flags`` are the session's and the request's together, so they can only be switched on.

    ``meta`` is a JSON text; rows are rotated by ``request_id``.
    """
    from pagewright.operators.frontier import rotate

    rows = rotate(requests, "request_id", list(session.rotate)) if session.rotate else requests.withColumn("choice", F.lit(session.proxy))
    scheme = F.lower(F.regexp_extract(F.trim("url"), r"^([A-Za-z]+)://", 1))
    by_scheme = F.when(scheme == "https", F.get_json_object(meta, "$.proxies.https")).when(scheme == "http", F.get_json_object(meta, "$.proxies.http"))
    proxy = F.coalesce(F.nullif(F.trim(by_scheme), F.lit("")), F.nullif(F.trim(F.get_json_object(meta, "$.proxy")), F.lit("")), F.nullif("choice", F.lit("")))
    asked = F.coalesce(F.from_json(F.get_json_object(meta, "$.flags"), "array<string>"), F.array().cast("array<string>"))
    flags = F.array_sort(F.array_union(F.array(*map(F.lit, sorted(session.flags))).cast("array<string>"), asked))
    return rows.withColumns({"proxy": proxy, "flags": flags}).drop("choice")


@dataclass(frozen=True)
class Proxies:
    """A proxy for all requests, or one for each scheme; ``auth`` is put into the address."""

    url: str = ""
    by_scheme: dict[str, str] = field(default_factory=dict)
    auth: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        if self.url and self.by_scheme:
            raise ValueError("one proxy and proxies by scheme exclude each other")
        if self.auth and not (self.url or self.by_scheme):
            raise ValueError("proxy credentials need a proxy")
        for scheme in self.by_scheme:
            if scheme.strip().lower() not in ("http", "https"):
                raise ValueError(f"unsupported proxy scheme {scheme}")
        for address in [self.url] * bool(self.url) + list(self.by_scheme.values()):
            u = urls.parse_url(address.strip())
            if u is None or u.scheme not in ("http", "https") or not u.host:
                raise ValueError("a proxy address must be absolute http or https")

    def selected(self, url: Column) -> Column:
        """The proxy, as it was given, that a URL goes through; null for none."""
        if self.url:
            return F.lit(self.url.strip())
        scheme = F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z]+):", 1))
        out = F.lit(None).cast("string")
        for k, v in self.by_scheme.items():
            out = F.when(scheme == k.strip().lower(), F.lit(v.strip())).otherwise(out)
        return out

    def address(self, url: Column) -> Column:
        """As ``selected``, with the credentials in it."""
        own = self.selected(url)
        if not self.auth:
            return own
        coded = ":".join(urls._escape(x, urls._KEEP_QUERY) for x in self.auth)
        return F.regexp_replace(own, r"^([A-Za-z]+://)(?:[^/@]*@)?", f"$1{coded}@")


def error_message(kind: Column, method: Column, url: Column, attempts: Column, cause: Column) -> Column:
    """A typed error as text; null without a kind."""
    target = F.coalesce(F.nullif(url, F.lit("")), F.lit("<unknown>"))
    tries = F.when(F.coalesce(attempts, F.lit(0)) > 0, F.concat(F.lit(" after "), attempts.cast("string"), F.lit(" attempts"))).otherwise("")
    return F.when(kind.isNotNull(), F.concat(method, F.lit(" "), target, F.lit(" failed"), tries, F.lit(": "), F.coalesce(cause, F.lit(""))))


def safe(requests: DataFrame, block_private: bool = True, blocked: tuple[str, ...] = (), policies: DataFrame | None = None) -> DataFrame:
    """Requests (method, url) with ``error_kind`` and ``error_message`` of unsafe ones: an address that
    is private or in a blocked network, or a path that robots rules (origin, status, body) forbid.

    Only literal addresses are looked at; names are not resolved here, so they pass. A network that can't
    be read is an error of the call.
    """
    nets = [ipaddress.ip_network(n.strip(), strict=False) for n in blocked]
    host = urls.host(F.col("url"))
    bad = F.lit(False)
    if block_private:
        bad = bad | F.coalesce(urls.private_ip(host), F.lit(False))
    if nets:
        bad = bad | urls.ip_in(host, nets)
    kind = F.when(bad, "private_address")
    out = requests
    if policies is not None:
        out = literal_check(requests, policies)
        kind = F.coalesce(kind, F.when(~F.col("allowed"), "robots"))
    out = out.withColumn("error_kind", kind)
    cause = F.when(F.col("error_kind") == "robots", "blocked by robots.txt").otherwise("private address blocked")
    out = out.withColumn("error_message", error_message(F.col("error_kind"), F.col("method"), F.col("url"), F.lit(0), cause))
    return out.drop("allowed", "origin") if policies is not None else out


def effective(value: int | None, default: int, negative: int | None = None) -> int:
    """A limit as it counts: 0 and none mean the default, negative ones ``negative`` (or the default)."""
    if not value:
        return default
    return value if value > 0 else default if negative is None else negative


#: Effective limits of a crawl (fixed values): blocked retries, concurrency, attempts, redirects.
LIMITS = {"blocked_retries": (3, 0), "concurrency": (4, None), "attempts": (3, None), "redirects": (30, None)}


def fetched(requests: DataFrame, stored: DataFrame, verbs: tuple[str, ...] = ("GET", "POST", "PUT", "DELETE")) -> DataFrame:
    """Requests answered from stored responses (method, url, status, body) instead of a network: each
    with its place ``pos``, ``status``, ``body`` and ``error`` ("unsupported method", "not stored").

    The join is on verb and canonical URL; of several stored responses of one key the one with the
    largest ``stored_at`` counts. Rows keep their order in ``pos``, however they are executed.
    """
    key = lambda df: df.withColumn("__key", urls.canonical_request(F.trim("url"))).withColumn("__verb", F.upper(F.coalesce(F.nullif(F.trim("method"), F.lit("")), F.lit("GET"))))
    newest = key(stored).where("__key is not null").groupBy("__key", "__verb").agg(F.max_by(F.struct("status", "body"), "stored_at").alias("__r"))
    out = key(requests).join(newest, ["__key", "__verb"], "left")
    known = F.col("__verb").isin(*verbs)
    error = F.when(~known, "unsupported method").when(F.col("__r").isNull(), "not stored")
    return out.withColumns({"error": error, "status": F.when(known, F.col("__r.status")), "body": F.when(known, F.col("__r.body"))}).drop("__key", "__verb", "__r")
