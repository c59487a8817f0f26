"""URL functions. The parser keeps what it reads: schemes and hosts are folded, queries are decoded
and written again sorted by key, everything else stays as it is."""

from __future__ import annotations

import hashlib
import ipaddress
import json
import posixpath
import re
from dataclasses import dataclass, replace
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = re.compile(r"^([A-Za-z][A-Za-z0-9+.-]*):")
_KEEP_QUERY = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_.~")
_KEEP_PATH = _KEEP_QUERY | frozenset(b"$&+,/:;=@!'()*[]%")


@dataclass(frozen=True)
class Url:
    """The parts of a URL; ``query`` is none where there is no question mark."""

    scheme: str = ""
    user: str | None = None
    host: str = ""
    port: str = ""
    path: str = ""
    query: str | None = None
    fragment: str = ""
    opaque: str = ""
    slashes: bool = False

    def __str__(self) -> str:
        out = self.scheme + ":" if self.scheme else ""
        if self.opaque:
            out += self.opaque
        else:
            if self.slashes:
                host = f"[{self.host}]" if ":" in self.host else self.host
                out += "//" + ("" if self.user is None else self.user + "@") + host + (":" + self.port if self.port else "")
            path = self.path
            if path and path[0] != "/" and self.host:
                path = "/" + path
            out += path
        return out + ("" if self.query is None else "?" + self.query) + ("#" + self.fragment if self.fragment else "")


def _unescape(text: str, plus: bool = False) -> str | None:
    """Percent-decoded; none if an escape is broken."""
    if re.search(r"%(?![0-9A-Fa-f]{2})", text):
        return None
    data = re.sub(rb"%([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), (text.replace("+", " ") if plus else text).encode("utf-8", "surrogateescape"))
    return data.decode("utf-8", "surrogateescape")


def _escape(text: str, keep: frozenset[int], plus: bool = False) -> str:
    return "".join(chr(b) if b in keep else "+" if plus and b == 32 else f"%{b:02X}" for b in text.encode("utf-8", "surrogateescape"))


def parse_url(text: str | None) -> Url | None:
    """The parts of a URL; none for a null or broken one (control characters, a broken escape in
    path or host, a colon before the first slash without scheme, a port that is no number)."""
    if text is None or re.search(r"[\x00-\x1f\x7f]", text):
        return None
    rest, _, fragment = text.partition("#")
    if _unescape(fragment) is None:
        return None
    scheme = ""
    if m := _SCHEME.match(rest):
        scheme, rest = m[1].lower(), rest[m.end() :]
    elif rest.startswith(":"):
        return None
    query: str | None = None
    if "?" in rest:
        rest, _, query = rest.partition("?")
    if scheme and not rest.startswith("/") and rest:
        return Url(scheme, opaque=rest, query=query, fragment=fragment)
    if not scheme and ":" in rest.partition("/")[0]:
        return None
    user, host, port, slashes = None, "", "", False
    if rest.startswith("//") and not rest.startswith("///"):
        slashes = True
        authority, slash, path = rest[2:].partition("/")
        rest = slash + path
        if "@" in authority:
            user, _, authority = authority.rpartition("@")
        if authority.startswith("["):
            host, _, tail = authority[1:].partition("]")
            port = tail.removeprefix(":")
        else:
            host, _, port = authority.partition(":")
        if port and not port.isdigit() or re.search(r"[\s<>\"\\^`{|}]", host) or _unescape(host) is None:
            return None
    if _unescape(rest) is None:
        return None
    return Url(scheme, user, host, port, _escape(rest, _KEEP_PATH), query, fragment, slashes=slashes)


def sorted_query(query: str) -> str:
    """Pairs sorted by key, values of a key in their order; pairs with a semicolon or a broken escape
    are dropped."""
    pairs: dict[str, list[str]] = {}
    for part in query.split("&"):
        if not part or ";" in part:
            continue
        k, _, v = part.partition("=")
        k, v = _unescape(k, True), _unescape(v, True)
        if k is not None and v is not None:
            pairs.setdefault(k, []).append(v)
    order = sorted(pairs, key=lambda k: k.encode("utf-8", "surrogateescape"))
    return "&".join(f"{_escape(k, _KEEP_QUERY, True)}={_escape(v, _KEEP_QUERY, True)}" for k in order for v in pairs[k])


def _canonical(u: Url, keep_fragment: bool) -> Url:
    query = None if u.query is None else sorted_query(u.query)
    if query == "" and u.query:  # only a bare question mark is kept
        query = None
    return replace(u, host=u.host.lower(), query=query, fragment=u.fragment if keep_fragment else "")


def canonical_request_url(text: str | None, keep_fragment: bool = False) -> str | None:
    """Scheme and host in lower case, query sorted, no fragment; the path is left alone."""
    u = parse_url(text)
    return None if u is None else str(_canonical(u, keep_fragment))


def canonical_link_url(text: str | None, keep_fragment: bool = False) -> str | None:
    """As for requests, with ``.``, ``..`` and repeated slashes of the path resolved; a slash at the
    end stays."""
    u = parse_url(text)
    if u is None:
        return None
    path = u.path
    if path:
        path = posixpath.normpath(path)
        path = "/" + path.lstrip("/") if u.path.startswith("/") else path
        if u.path.endswith("/") and not path.endswith("/"):
            path += "/"
    return str(_canonical(replace(u, path=path), keep_fragment))


def resolve_url(base: str | None, text: str | None) -> str | None:
    """A reference seen from a base; none for a broken one."""
    u = parse_url(text)
    if u is None:
        return None
    if u.scheme:
        return str(u)
    b = parse_url(base)
    if b is None:
        return None
    if u.slashes:
        return str(replace(u, scheme=b.scheme))
    out = urljoin(str(replace(b, scheme="http")) if b.scheme else str(b), str(u))
    return re.sub(r"^http:", b.scheme + ":", out) if b.scheme else out


def fingerprint(url: str | None, method: str | None = None, sid: str | None = None, body: bytes | str | None = None, headers: dict | None = None, keep_fragment: bool = False) -> str | None:
    """SHA-1 of a request's sorted JSON form; none for a broken URL. Headers count if given."""
    canonical = canonical_request_url(url or "", keep_fragment)
    if canonical is None:
        return None
    raw = body.encode("utf-8", "surrogateescape") if isinstance(body, str) else body or b""
    data: dict[str, object] = {"body": raw.hex(), "method": method.upper() if method else "GET", "sid": sid or "", "url": canonical}
    if headers is not None:
        merged: dict[str, list[str]] = {}
        for k, v in headers.items():
            merged.setdefault(k.lower(), []).extend(v)
        data["headers"] = [[k, x] for k in sorted(merged) for x in sorted(merged[k])]
    text = json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for c in "&<>  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return hashlib.sha1(text.encode("utf-8", "surrogateescape")).hexdigest()


def link_extension(path: str) -> str:
    """The extension of the last path segment, parameters cut off; ``tar.gz`` counts as one."""
    last = path.strip("/").rpartition("/")[2].partition(";")[0].lower()
    if last.endswith(".tar.gz"):
        return "tar.gz"
    return last.rpartition(".")[2] if "." in last else ""


#: Networks that count as private (fixed values): RFC 1918, loopback, link-local and their IPv6 kin.
PRIVATE = [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "224.0.0.0/24", "0.0.0.0/32", "fc00::/7", "::1/128", "fe80::/10", "ff02::/16", "::/128")]


def is_private_ip(text: str | None) -> bool | None:
    """Whether an IP address is private; none for what isn't one."""
    try:
        ip = ipaddress.ip_address((text or "").strip("[]"))
    except ValueError:
        return None
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return any(ip in n for n in PRIVATE if n.version == ip.version)


def _udf(f, kind: str, *extra):
    """A function of strings as an Arrow-batched column function."""

    def column(*columns: Column) -> Column:
        @F.pandas_udf(kind)
        def run(*series: pd.Series) -> pd.Series:
            return pd.Series([f(*(None if x is None or x != x else x for x in row), *extra) for row in zip(*series, strict=True)], dtype=object)

        return run(*columns)

    return column


#: URLs whose canonical form needs no decoding: plain characters in all parts. Others go to Python.
PLAIN = r"^[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~$&+,/:;=@!'()*-]*)?(?:\?[A-Za-z0-9._~=&+-]*)?(?:#[A-Za-z0-9._~=&/-]*)?$"


def _plain_canonical(c: Column, keep_fragment: bool) -> Column:
    """Canonical form of a plain URL by built-in functions: scheme and host folded, pairs sorted by key
    (and among equal keys as they came)."""
    head = F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#:]+)", 1)
    rest = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]+([^?#]*)", 1)
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p != "")
    keyed = F.transform(parts, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    joined = F.array_join(F.transform(F.array_sort(keyed), lambda x: x["p"]), "&")
    # an equals sign in a value is written as %3D
    joined = F.when(query.rlike("=[^&]*="), F.lit(None).cast("string")).otherwise(joined)
    mark = F.when(~c.rlike(r"^[^#]*\?"), "").when(query == "", "?").when(F.size(parts) == 0, "").otherwise(F.concat(F.lit("?"), joined))
    out = F.concat(F.lower(head), rest, mark)
    return F.concat(out, F.regexp_extract(c, r"(#.+)$", 1)) if keep_fragment else out


def canonical_request(c: Column, keep_fragment: bool = False) -> Column:
    """``canonical_request_url`` as a column: built-in functions for plain URLs, Python for the rest."""
    plain = F.when(c.rlike(PLAIN), _plain_canonical(c, keep_fragment))
    return F.coalesce(plain, _udf(canonical_request_url, "string", keep_fragment)(F.when(plain.isNull(), c)))


def canonical_link(c: Column, keep_fragment: bool = False) -> Column:
    return _udf(canonical_link_url, "string", keep_fragment)(c)


def resolve(base: Column, c: Column) -> Column:
    return _udf(resolve_url, "string")(base, c)


def request_fingerprint(url: Column, method: Column, sid: Column, body: Column) -> Column:
    """``fingerprint`` of the default options as a column. Plain URLs with plain methods and sessions are
    hashed by built-in functions; only the rest goes to Python."""
    easy = url.rlike(PLAIN) & F.coalesce(method, F.lit("")).rlike("^[A-Za-z]*$") & F.coalesce(sid, F.lit("")).rlike("^[A-Za-z0-9 ._-]*$")
    verb = F.coalesce(F.nullif(F.upper(method), F.lit("")), F.lit("GET"))
    data = F.lower(F.hex(F.encode(F.coalesce(body, F.lit("")), "UTF-8")))
    address = F.replace(_plain_canonical(url, False), F.lit("&"), F.lit("\\u0026"))
    text = F.concat(F.lit('{"body":"'), data, F.lit('","method":"'), verb, F.lit('","sid":"'), F.coalesce(sid, F.lit("")), F.lit('","url":"'), address, F.lit('"}'))
    plain = F.when(easy, F.sha1(text))
    rest = plain.isNull()
    own = lambda x: F.when(rest, x)
    # a null address is an empty one to the function, so rows that are done pass a broken one
    slow = _udf(fingerprint, "string")(F.when(rest, F.coalesce(url, F.lit(""))).otherwise("\x00"), own(method), own(sid), own(body))
    return F.coalesce(plain, slow)


def private_ip(c: Column) -> Column:
    return _udf(is_private_ip, "boolean")(c)


def ip_in(c: Column, nets: list) -> Column:
    """Whether an IP address lies in any of some networks; false for what isn't one."""

    def inside(text: str | None) -> bool:
        try:
            ip = ipaddress.ip_address((text or "").strip("[]"))
        except ValueError:
            return False
        ip = getattr(ip, "ipv4_mapped", None) or ip
        return any(ip in n for n in nets if n.version == ip.version)

    return _udf(inside, "boolean")(c)


def host(c: Column) -> Column:
    """The host of a URL in lower case, without port and userinfo; '' where there is none."""
    return F.lower(F.regexp_extract(F.trim(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)", 1))


def adaptive_domain(c: Column, override: str = "") -> Column:
    """The host, or "default" where there is none; an override replaces both."""
    if override.strip():
        return F.lit(override.strip())
    return F.coalesce(F.nullif(host(c), F.lit("")), F.lit("default"))


def domain_in(h: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or under one; an empty list admits none."""
    out = F.lit(False)
    for d in domains:
        d = d.lower().rstrip(".")
        out = out | (h == d) | h.endswith("." + d)
    return out


def extension(path: Column) -> Column:
    """``link_extension`` as a column."""
    last = F.lower(F.substring_index(F.substring_index(F.regexp_replace(path, "^/+|/+$", ""), "/", -1), ";", 1))
    return F.when(last.endswith(".tar.gz"), "tar.gz").when(last.contains("."), F.substring_index(last, ".", -1)).otherwise("")


def media_type(c: Column) -> Column:
    """A Content-Type without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(c, ";", 1)))


def append_params(c: Column, params: dict[str, list[str]]) -> Column:
    """A URL with parameters added and its query sorted; unchanged without any."""
    if not params:
        return c
    extra = "&".join(f"{_escape(k, _KEEP_QUERY, True)}={_escape(v, _KEEP_QUERY, True)}" for k, vs in params.items() for v in vs)

    def add(url: str | None) -> str | None:
        u = parse_url(url)
        return None if u is None else str(replace(u, query=sorted_query((u.query + "&" if u.query else "") + extra)))

    return _udf(add, "string")(c)
