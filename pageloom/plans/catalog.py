"""Registry of named queries over the reference tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "audit_chain_status"
#: Modules that hold QUERIES and ORACLES dictionaries.
MODULES = ("audit_queries", "review_queries", "text_queries", "layout_queries", "sequential_queries", "rendering_queries", "display_queries", "publication_queries", "structure_queries", "edit_queries", "outline_queries")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"pageloom.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"pageloom.plans.{name}").ORACLES
    return found
