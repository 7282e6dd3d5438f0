"""The queries of the training-data operators, their SQL, and the parameters they run with."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that each hold QUERIES and ORACLES.
MODULES = ("op1_query", "op2_query", "op3_query", "op4_query", "op5_query", "op6_query", "op7_query", "op8_query", "op9_query", "op10_query", "op11_query", "op12_query", "op13_query")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        found |= import_module(f"pageloom.llm.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found |= import_module(f"pageloom.llm.{name}").ORACLES
    return found
