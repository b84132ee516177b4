"""Keep Spark from computing an expression more than once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    Inside a lambda Spark evaluates an outer expression again for every array
    element; binding it as the element of a one-element array avoids that.
    """
    return F.transform(F.array(value), body)[0]


def unnest(df: DataFrame, keep: list[str], array: Column | str) -> DataFrame:
    """One row per struct of an array column: ``keep`` and the struct's fields.

    The outer form keeps Spark from adding a "not empty" filter below, which
    would compute the array a second time; the filter after it does the same.
    """
    rows = df.select(*keep, F.explode_outer(array).alias("_item"))
    return rows.filter(F.col("_item").isNotNull()).select(*keep, "_item.*")
