"""Slash paths into JSON: ``a/b/0`` walks objects by key and lists by index; a key on a list is
looked up in each of its items."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def walk(value: Any, parts: list[str]) -> Iterator[Any]:
    if not parts:
        yield value
        return
    if isinstance(value, dict):
        if parts[0] in value:
            yield from walk(value[parts[0]], parts[1:])
    elif isinstance(value, list):
        if parts[0].lstrip("-").isdigit():
            i = int(parts[0])
            if 0 <= i < len(value):
                yield from walk(value[i], parts[1:])
        else:
            for x in value:
                yield from walk(x, parts)


def text_of(value: Any) -> str | None:
    """A JSON value as text: null has none, strings are normalised, numbers are written shortest,
    containers compactly."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return " ".join(value.split())
    if isinstance(value, (int, float)):
        v = float(value)
        return str(int(v)) if v == int(v) and abs(v) < 1e21 else format(v, "f").rstrip("0") if abs(v) < 1e-6 else repr(v)
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)


def values_at(text: str | None, path: str, multiple: bool = False) -> list[str]:
    """Texts of the values at a path; none for null or broken JSON. ``multiple`` opens one list."""
    try:
        value = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return []
    found = list(walk(value, [p.strip() for p in path.split("/") if p.strip()])) if text else []
    if multiple:
        found = [y for x in found for y in (x if isinstance(x, list) else [x])]
    return [t for t in map(text_of, found) if t is not None]


def json_values(c: Column, path: str, multiple: bool = False) -> Column:
    """``values_at`` as a column of lists."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: values_at(t, path, multiple))

    return run(c)
