"""The table of named queries and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticegrid.plans.views import VIEWS, Inputs, referenced, view_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, str] = {}  # DuckDB-only relations that several oracle texts use


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with its DuckDB text."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"Duplicate query name {name}")
        QUERIES[name] = lambda spark, path: fn(Inputs(spark, path))
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix the CTEs that ``sql`` refers to."""
    known = {**{n: view_sql(n, "duckdb") for n in VIEWS}, **SHARED}
    names = referenced(sql, known)
    if not names:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({known[n].strip()})" for n in names)
    body = sql.strip()
    if body[:14].upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[14:].strip()}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:].strip()}"
    return f"WITH {ctes}\n{body}"


def oracles() -> dict[str, str]:
    """Complete oracle texts; shared relations may be registered in any order."""
    return {name: with_views(sql) for name, sql in ORACLES.items()}
