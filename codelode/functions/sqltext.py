"""Pieces of Spark SQL expression text.

Expressions with hundreds of parts are written as SQL text and parsed once:
building them call by call through the Python API took seconds per query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EMPTY_LIST = "cast(array() AS array<string>)"


def literal(value: str | int | float | bool) -> str:
    """A Python value as a SQL literal."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> str:
    return ".".join(f"`{part}`" for part in column.split("."))


def one_of(column: str, values) -> str:
    return f"{column} IN ({', '.join(literal(v) for v in values)})"


def constant_map(values: dict) -> str:
    return "map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in values.items()) + ")"


def case(branches: list[tuple[str, str]], otherwise: str) -> str:
    if not branches:
        return otherwise
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {otherwise} END"


def columns(parts: dict[str, str]) -> dict[str, Column]:
    return {n: F.expr(sql) for n, sql in parts.items()}
