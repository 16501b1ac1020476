"""Registered queries over the driver tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

from finsheet.plans import award_queries, choice_queries, document_queries, market_queries, registry_queries, report_queries, sheet_queries, state_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(module: ModuleType) -> None:
    """Every public function of two parameters is a query; a constant of its name in capitals is its SQL."""
    for name, function in vars(module).items():
        if callable(function) and not name.startswith("_") and getattr(function, "__module__", "") == module.__name__:
            QUERIES[name] = function
            if sql := getattr(module, name.upper(), None):
                ORACLE_SQL[name] = sql


for _module in (award_queries, sheet_queries, registry_queries, document_queries, choice_queries, state_queries, market_queries, report_queries):
    _register(_module)
