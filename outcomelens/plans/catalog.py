"""Registry of runnable queries: key -> (spark, sf_dir) -> DataFrame, plus SQL oracles.

Keys follow the operator inventory (SURVEY §2).  Each query reads the driver
tables through ``sources.fixtures`` and runs the library operator on the whole
input; the oracle SQL computes the same result in DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    import importlib
    import pkgutil
    from pathlib import Path
    here = Path(__file__).parent
    for m in sorted(pkgutil.iter_modules([str(here)]), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"{__package__}.{m.name}")
