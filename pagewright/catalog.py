"""Queries of the core operators and the SQL that gives the same rows, collected for the entry module."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES: list[str] = ["web", "tools", "more", "nested"]


def _modules() -> list:
    return [import_module(f"pagewright.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.SQL.items()}
