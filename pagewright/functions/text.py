"""Text functions as columns; an Arrow UDF only where no built-in function has the semantics."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: White space: Unicode's, as Go's and Python's ``split`` see it.
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normalize_space(c: Column) -> Column:
    """White space runs to one blank, trimmed; null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def tighten_punctuation(c: Column) -> Column:
    """Normalised space without blanks before . , ! ? ; :"""
    return F.regexp_replace(normalize_space(c), r" ([.,!?;:])", "$1")


def strip_zero_width(c: Column) -> Column:
    """Without U+200B, U+200C, U+200D, U+2060 and U+FEFF."""
    return F.translate(c, "​‌‍⁠﻿", "")


@F.pandas_udf(StringType())
def html_unescape(c: pd.Series) -> pd.Series:
    """Entities decoded; null stays null."""
    return c.map(lambda s: s if s is None or "&" not in s else html.unescape(s))


@F.pandas_udf(ArrayType(StringType()))
def unescape_each(c: pd.Series) -> pd.Series:
    """Entities decoded in each text of a list."""
    return c.map(lambda xs: None if xs is None else [x if x is None or "&" not in x else html.unescape(x) for x in xs])


def regex_all(c: Column, pattern: str, groups: int) -> Column:
    """All matches of a pattern, or all its groups of all matches in order (an unmatched group is
    ''). ``groups`` is the number of groups. Null and no match give an empty list."""
    if groups == 0:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    elif groups == 1:
        found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    else:
        each = [F.regexp_extract_all(c, F.lit(pattern), F.lit(g)) for g in range(1, groups + 1)]
        found = F.flatten(F.transform(F.arrays_zip(*[e.alias(f"g{i}") for i, e in enumerate(each)]), lambda z: F.array(*[z[f"g{i}"] for i in range(groups)])))
    found = F.coalesce(found, F.array().cast("array<string>"))
    return F.when(F.exists(found, lambda x: x.contains("&")), unescape_each(found)).otherwise(found)


def regex_first(c: Column, pattern: str, groups: int, default: str = "") -> Column:
    """The first of ``regex_all``, or the default."""
    return F.coalesce(F.try_element_at(regex_all(c, pattern, groups), F.lit(1)), F.lit(default))


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets: both empty 1, one empty 0."""
    common = F.size(F.array_intersect(a, b))
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(common / F.when(every == 0, 1).otherwise(every))


def string_similarity(a: Column, b: Column) -> Column:
    """Of normalised lower-case texts: equal ones 1, one empty 0, else the Jaccard similarity of
    their tokens. Null counts as empty."""
    a, b = (normalize_space(F.lower(F.coalesce(x, F.lit("")))) for x in (a, b))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(jaccard(tokens(a), tokens(b)))


def render_template(template: str, values: dict[str, Column], escape: bool = False) -> Column:
    """``{name}`` placeholders filled from columns; unknown names are an error that lists them."""
    import re

    parts = re.split(r"\{(\w+)\}", template)
    missing = sorted({n for n in parts[1::2] if n not in values})
    if missing:
        raise ValueError("missing template values: " + ", ".join(missing))
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            out.append(F.lit(p))
        else:
            v = F.coalesce(values[p].cast("string"), F.lit(""))
            out.append(F.when(v.rlike("^[&?]"), v).otherwise(F.replace(F.url_encode(v), F.lit("+"), F.lit("%20"))) if escape else v)
    return F.concat(*out)
