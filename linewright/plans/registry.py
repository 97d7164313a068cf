"""Registry of queries and of the SQL each of them is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linewright.sources.corpus import view_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``oracle`` is its DuckDB text, if one is practical."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle
        return function

    return register


def over(views: str, body: str, *steps: str, recursive: bool = False) -> str:
    """Oracle text: the named views, then named steps ``name AS (...)``, then the body."""
    parts = [f"{name} AS ({view_sql(name, 'duckdb')})" for name in views.split()]
    parts += list(steps)
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body


def sql_text(value: str) -> str:
    """A string as a DuckDB literal."""
    quoted = "'" + value.replace("'", "''") + "'"
    return quoted.replace("\n", "'||chr(10)||'")


def sql_list(values) -> str:
    return "(" + ", ".join(sql_text(v) for v in values) + ")"


def sql_case(values: dict, key: str) -> str:
    """A fixed table as a CASE expression over ``key``."""
    arms = " ".join(
        f"WHEN {sql_text(k)} THEN {sql_text(v) if isinstance(v, str) else v}" for k, v in values.items()
    )
    return f"CASE {key} {arms} END"


def utf16(expr: str) -> str:
    return f"(length({expr}) + length(regexp_replace({expr}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


def tokens(expr: str) -> str:
    return f"CAST(ceil({utf16(f'coalesce({expr}, {sql_text(chr(32)[:0])})')} / 4.0) AS INT)"
