"""Queries of the training-data operators and their SQL, collected for the entry module.

All modules are imported with this one, so a missing or broken one is known where the subpackage is
imported and not when queries are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.llm import boilerplate, leaks, markup, mojibake, near_duplicates, repetition, residue, seen, tokens

MODULES = [near_duplicates, markup, seen, boilerplate, residue, mojibake, tokens, leaks, repetition]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in vars(m).items() if k.startswith("p") and k[1:2].isdigit() and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
