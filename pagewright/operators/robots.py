"""robots.txt: policies as rows, and requests checked against them by a join on the origin."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls


def groups(body: str | None) -> list[dict]:
    """Groups of a file: agents, rules (pattern, allow), delay and rate (requests, seconds).

    A blank line, or a user-agent after directives, ends a group; directives before any agent count
    for nothing; what follows # is a comment."""
    out: list[dict] = []
    own: dict | None = None
    begun = False
    for line in (body or "").splitlines():
        line = line.partition("#")[0].strip()
        if not line:
            own, begun = None, False
            continue
        key, colon, value = line.partition(":")
        if not colon:
            continue
        key, value = key.strip().lower(), value.strip()
        if key == "user-agent":
            if own is None or begun:
                own, begun = {"agents": [], "rules": [], "delay": 0.0, "rate": None}, False
                out.append(own)
            own["agents"].append(value.lower())
        elif own is None:
            continue
        elif key in ("allow", "disallow"):
            begun = True
            if value:
                own["rules"].append((value, key == "allow"))
        elif key == "crawl-delay":
            begun = True
            if re.fullmatch(r"\d+(\.\d*)?|\.\d+", value):
                own["delay"] = float(value)
        elif key == "request-rate":
            begun = True
            m = re.fullmatch(r"(\d+)\s*/\s*(\d+(?:\.\d*)?)", value)
            if m and int(m[1]):
                own["rate"] = (int(m[1]), float(m[2]))
    return out


def agent_score(agent: str, user_agent: str) -> int:
    """How well an agent name fits a user agent: its length if it begins one of the products, 1 for
    ``*``, else -1."""
    agent = agent.strip().lower()
    if agent == "*":
        return 1
    products = (f.partition("/")[0].strip("();,") for f in user_agent.lower().split())
    return len(agent) + 1 if agent and any(p and p.startswith(agent) for p in products) else -1


def policy(body: str | None, user_agent: str | None) -> dict:
    """The best-fitting groups as one: rules together, the longest delay, the slowest rate."""
    ua = (user_agent or "").strip() or "*"
    found = [(max((agent_score(a, ua) for a in g["agents"]), default=-1), g) for g in groups(body)]
    best = max((s for s, _ in found), default=-1)
    own = [g for s, g in found if s == best and s >= 0]
    rates = [g["rate"] for g in own if g["rate"]]
    return {"rules": [r for g in own for r in g["rules"]], "delay": max((g["delay"] for g in own), default=0.0), "rate": max(rates, key=lambda r: r[1] / r[0], default=None)}


def pattern_matches(pattern: str, path: str) -> bool:
    """``*`` stands for anything, ``$`` at the end for the end; else the pattern is a prefix."""
    end = pattern.endswith("$")
    body = ".*".join(map(re.escape, pattern.removesuffix("$").split("*")))
    return re.match(body + (r"\Z" if end else ""), path, re.S) is not None


def can_fetch(rules: list[tuple[str, bool]], url: str | None) -> bool:
    """The longest matching rule decides (wildcards don't count), allow among equals; none allows."""
    u = urls.parse_url(url)
    path = (url or "") if u is None else (u.path or "/") + ("?" + u.query if u.query else "")
    fits = [(len(p.replace("*", "").removesuffix("$")), allow) for p, allow in rules if pattern_matches(p, path)]
    return max(fits)[1] if fits else True


def origin(c):
    """Scheme and authority of a URL."""
    return F.lower(F.regexp_extract(F.trim(c), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def check(requests: DataFrame, policies: DataFrame, user_agent: str) -> DataFrame:
    """``requests`` (with url) with allowed, delay and origin; ``policies`` is (origin, status, body).

    An origin without a policy, or whose file didn't come with status 200, allows all. The effective
    delay is the longer of crawl delay and seconds per request.
    """
    body = F.when(F.col("status") == 200, F.col("body"))
    known = policies.select("origin", body.alias("__robots")).dropDuplicates(["origin"])

    @F.pandas_udf("allowed boolean, delay double")
    def judge(url: pd.Series, robots: pd.Series) -> pd.DataFrame:
        seen: dict[str | None, dict] = {}
        rows = []
        for u, r in zip(url, robots, strict=True):
            p = seen.get(r)
            if p is None:
                p = seen[r] = policy(r, user_agent)
            rate = p["rate"][1] / p["rate"][0] if p["rate"] else 0.0
            rows.append((can_fetch(p["rules"], u), max(p["delay"], rate)))
        return pd.DataFrame(rows, columns=["allowed", "delay"])

    out = requests.withColumn("origin", origin(F.col("url"))).join(known, "origin", "left")
    return out.withColumn("__v", judge("url", "__robots")).withColumns({"allowed": F.col("__v.allowed"), "delay": F.col("__v.delay")}).drop("__v", "__robots")


def robots_rules(policies: DataFrame) -> DataFrame:
    """(origin, grp, agent, pattern, allow): the rules of all groups as rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(o, i, a, p, allow) for o, b in zip(f["origin"], f["body"], strict=True) for i, g in enumerate(groups(b)) for a in g["agents"] for p, allow in g["rules"]]
            yield pd.DataFrame(rows, columns=["origin", "grp", "agent", "pattern", "allow"])

    return policies.select("origin", "body").mapInPandas(run, "origin string, grp int, agent string, pattern string, allow boolean")


def sitemap_lines(policies: DataFrame) -> DataFrame:
    """(origin, url): the Sitemap lines, whatever group they stand in."""
    lines = policies.select("origin", F.explode(F.split("body", r"\r?\n")).alias("line"))
    return lines.where(F.lower(F.trim("line")).startswith("sitemap:")).select("origin", F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("url")).where("url <> ''")


def _path(url: str | None) -> str:
    """The escaped path of a URL, "/" where there is none."""
    u = urls.parse_url(url)
    return (u.path if u is not None else "") or "/"


def literal_rules(body: str | None, agent: str = "") -> list[tuple[str, bool]]:
    """(pattern, allow) of the groups of ``*`` or of the agent itself. The last user-agent line before a
    rule decides whose it is, and a blank line ends it."""
    out: list[tuple[str, bool]] = []
    mine = False
    for line in (body or "").splitlines():
        line = line.partition("#")[0].strip()
        key, colon, value = line.partition(":")
        key, value = key.strip().lower(), value.strip()
        if not line:
            mine = False
        elif colon and key == "user-agent":
            mine = value == "*" or bool(agent) and value.lower() == agent.lower()
        elif colon and mine and value and key in ("allow", "disallow"):
            out.append((value, key == "allow"))
    return out


def literal_check(requests: DataFrame, policies: DataFrame, agent: str = "") -> DataFrame:
    """``requests`` (with url) with origin and allowed: rules are prefixes of the path, wildcards mean
    nothing, the longest decides, allow among equals. Files that didn't come with a status of 200 to 299
    allow all, as do addresses without scheme or host."""
    known = policies.select("origin", F.when(F.col("status").between(200, 299), F.col("body")).alias("__robots")).dropDuplicates(["origin"])

    @F.pandas_udf("boolean")
    def judge(url: pd.Series, robots: pd.Series) -> pd.Series:
        seen: dict[str | None, list] = {}
        out = []
        for u, r in zip(url, robots, strict=True):
            own = seen.setdefault(r, literal_rules(r, agent)) if r not in seen else seen[r]
            path = _path(u)
            fits = [(len(p), allow) for p, allow in own if path.startswith(p)]
            out.append(max(fits)[1] if fits else True)
        return pd.Series(out, dtype=object)

    out = requests.withColumn("origin", origin(F.col("url"))).join(known, "origin", "left")
    return out.withColumn("allowed", judge("url", "__robots")).drop("__robots")


# Reasons of decisions.
NO_HOST = "target URL must include scheme and host"
NO_FILE = "robots.txt unavailable"
EMPTY_FILE = "empty robots.txt"
NOT_A_FILE = "not a usable robots.txt"
NO_GROUP = "no matching robots rules"
NO_RULE = "robots group has no matching path rule"
BY_RULE = "by robots rule"


def strict_decision(status: int | None, body: str | None, url: str | None, token: str) -> tuple[bool, str, float]:
    """(allowed, reason, delay) of a check that refuses where it can't know: without a file, with another
    status than 200, with an empty file or a page of markup."""
    u = urls.parse_url(url)
    if u is None or not u.scheme or not u.host:
        return False, NO_HOST, 0.0
    if status != 200:
        return False, NO_FILE + ("" if status is None else f": status {status}"), 0.0
    text = (body or "").strip()
    head = text[:256].lower()
    if not text:
        return False, EMPTY_FILE, 0.0
    if head.startswith(("<!doctype html", "<html")) or "<title>" in head:
        return False, NOT_A_FILE, 0.0
    found = groups(re.sub(r"\n\s*(?=\n)", "", "\n" + body) if body else body)  # blank lines end nothing here
    name = token.lower()
    own = [g for g in found if any(a and a != "*" and a in name for a in g["agents"])]
    scope = "specific" if own else "wildcard"
    own = own or [g for g in found if "*" in g["agents"]]
    if not own:
        return True, NO_GROUP, 0.0
    delay = max(g["delay"] for g in own)
    fits = [(len(p), allow, p) for g in own for p, allow in g["rules"] if strict_match(p, _path(url))]
    if not fits:
        return True, f"{scope} {NO_RULE}", delay
    best = max(fits, key=lambda x: x[:2])
    return best[1], f"{'allowed' if best[1] else 'disallowed'} {BY_RULE} {best[2]}", delay


def strict_match(pattern: str, path: str) -> bool:
    """``$`` at the end asks for an equal path; with ``*`` the parts must follow each other, the last at the
    end; else the pattern is a prefix."""
    if pattern.endswith("$"):
        return path == pattern.removesuffix("$")
    if "*" not in pattern:
        return path.startswith(pattern)
    return re.fullmatch(".*".join(map(re.escape, pattern.split("*"))), path, re.S) is not None


def strict_check(requests: DataFrame, policies: DataFrame, token: str) -> DataFrame:
    """``requests`` with origin, allowed, reason and delay by ``strict_decision``."""
    known = policies.select("origin", F.col("status").alias("__status"), F.col("body").alias("__robots")).dropDuplicates(["origin"])

    @F.pandas_udf("allowed boolean, reason string, delay double")
    def judge(url: pd.Series, status: pd.Series, robots: pd.Series) -> pd.DataFrame:
        rows = [strict_decision(None if s != s or s is None else int(s), r, u, token) for u, s, r in zip(url, status, robots, strict=True)]
        return pd.DataFrame(rows, columns=["allowed", "reason", "delay"])

    out = requests.withColumn("origin", origin(F.col("url"))).join(known, "origin", "left")
    return out.withColumn("__v", judge("url", "__status", "__robots")).withColumns({c: F.col(f"__v.{c}") for c in ("allowed", "reason", "delay")}).drop("__v", "__status", "__robots")
