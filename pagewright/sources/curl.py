"""curl command lines as requests."""

from __future__ import annotations

import shlex
from collections.abc import Iterator
from urllib.parse import parse_qsl, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame

#: Flags that say nothing about the request, those of the body, and those with a value (fixed values).
IGNORED = frozenset("-s --silent -S --show-error -v --verbose -i --include -L --location -k --insecure --compressed -f --fail --globoff -g".split())
DATA = frozenset("-d --data --data-raw --data-binary --data-ascii --data-urlencode".split())


class CurlError(ValueError):
    """A command that can't be read."""


def words(command: str) -> list[str]:
    """Shell words; line continuations are joined and ``$'...'`` is read with its escapes."""
    text = command.replace("\\\r\n", " ").replace("\\\n", " ").replace("^\n", " ")
    out, i = "", 0
    while (j := text.find("$'", i)) >= 0:
        k = j + 2
        while k < len(text) and text[k] != "'":
            k += 2 if text[k] == "\\" else 1
        inner = text[j + 2 : k].encode("latin-1", "backslashreplace").decode("unicode_escape")
        out += text[i:j] + shlex.quote(inner)
        i = k + 1
    try:
        return shlex.split(out + text[i:])
    except ValueError as e:
        raise CurlError(str(e)) from e


def parse(command: str) -> dict:
    """method, url, headers, cookies, params and body of a command.

    Data are joined by &; -G moves them to the parameters; a body without a method makes it POST.
    Unknown flags and a second URL are errors."""
    args = words(command)
    if args[:1] == ["curl"]:
        args = args[1:]
    url = method = ""
    headers: dict[str, str] = {}
    cookies: dict[str, str] = {}
    data: list[str] = []
    get = head = False
    it: Iterator[str] = iter(args)

    def value(flag: str) -> str:
        got = next(it, None)
        if got is None:
            raise CurlError(f"{flag} needs a value")
        return got

    def cookie(text: str) -> None:
        cookies.update((k.strip(), v.strip()) for k, _, v in (p.partition("=") for p in text.split(";")) if k.strip())

    for a in it:
        flag, eq, given = a.partition("=") if a.startswith("--") else (a, "", "")
        take = lambda f=flag, e=eq, g=given: g if e else value(f)
        if flag in DATA:
            data.append(take())
        elif flag in ("-X", "--request"):
            method = take().upper()
        elif flag in ("-H", "--header"):
            name, _, text = take().partition(":")
            if name.strip().lower() == "cookie":
                cookie(text)
            else:
                headers[name.strip()] = text.strip()
        elif flag in ("-b", "--cookie"):
            cookie(take())
        elif flag in ("-A", "--user-agent"):
            headers["User-Agent"] = take()
        elif flag in ("-e", "--referer"):
            headers["Referer"] = take()
        elif flag in ("-G", "--get"):
            get = True
        elif flag in ("-I", "--head"):
            head = True
        elif flag == "--url" or not a.startswith("-"):
            if url:
                raise CurlError("more than one URL")
            url = take() if flag == "--url" else a
        elif flag not in IGNORED:
            raise CurlError(f"unknown flag {flag}")
    if not url:
        raise CurlError("no URL")
    body = "&".join(data)
    parts = urlsplit(url)
    params = parse_qsl(parts.query, keep_blank_values=True) + (parse_qsl(body, keep_blank_values=True) if get else [])
    body = "" if get else body
    return {"method": method or ("HEAD" if head else "POST" if body else "GET"), "url": urlunsplit(parts._replace(query="")), "headers": headers, "cookies": cookies, "params": params, "body": body}


def curl_requests(commands: DataFrame, column: str = "command") -> DataFrame:
    """(command, method, url, headers, cookies, params, body, error) of command lines; a null one is
    an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for c in f[column]:
                try:
                    r = parse(c or "")
                    rows.append((c, r["method"], r["url"], r["headers"], r["cookies"], [{"name": k, "value": v} for k, v in r["params"]], r["body"], None))
                except CurlError as e:
                    rows.append((c, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["command", "method", "url", "headers", "cookies", "params", "body", "error"])

    return commands.select(column).mapInPandas(run, "command string, method string, url string, headers map<string,string>, cookies map<string,string>, params array<struct<name:string,value:string>>, body string, error string")
