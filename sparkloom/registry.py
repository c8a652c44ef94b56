"""All queries of the library's own operators, with the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .queries.base import Registry

#: Modules of queries.
MODULES = ("graph", "edges", "search", "audit", "logs", "policy", "sources", "plans", "extract", "faults")

_registries: list[Registry] = [import_module(f".queries.{name}", __package__).query for name in MODULES]
QUERIES = {name: q for r in _registries for name, q in r.queries.items()}
ORACLE_SQL = {name: sql for r in _registries for name, sql in r.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What one nation's customers, suppliers and orders are, level by level."""
    return QUERIES["g2_bfs_up"](spark, sf_dir)
