"""Numbering and running values within a key, safe for a hot key.

A plain window puts all rows of a key into one task.  Here the key is split by
ranges of its (numeric) position; only one small row per range is then ordered
per key to carry counts or maxima across ranges.  Results are exact.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 100_000


def _split(df: DataFrame, keys: list[str], position: str, span: int) -> DataFrame:
    # One struct as key: NULL fields compare equal in it, and the join and the
    # window below then share one shuffle.  NULL positions sort first, so they
    # get the lowest range.
    place = f"coalesce(cast(`{position}` AS bigint) div {span}, {-(2**63 - 1)}L)"
    return df.withColumns({"_key": F.struct(*keys), "_range": F.expr(place)})


def _with_carry(split: DataFrame, summary: Column, fold) -> DataFrame:
    """Add ``_before``: the summary of the key's earlier ranges."""
    small = split.groupBy("_key", "_range").agg(summary.alias("_own"))
    earlier = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = small.select(
        F.col("_key").alias("_k"), F.col("_range").alias("_r"), fold("_own").over(earlier).alias("_before")
    )
    on = (F.col("_key") == F.col("_k")) & (F.col("_range") == F.col("_r"))
    return split.join(carried, on).drop("_k", "_r")


def number_rows(
    df: DataFrame, keys: list[str], position: str, out: str, ties: list[str] | None = None, span: int = SPAN
) -> DataFrame:
    """``row_number`` per key by ``position`` (then ``ties``)."""
    carried = _with_carry(_split(df, keys, position, span), F.count(F.lit(1)), F.sum)
    within = Window.partitionBy("_key", "_range").orderBy(position, *(ties or []))
    return carried.withColumn(
        out, F.row_number().over(within) + F.coalesce("_before", F.lit(0))
    ).drop("_key", "_range", "_before")


def max_before(
    df: DataFrame, keys: list[str], position: str, value: str, out: str, ties: list[str] | None = None, span: int = SPAN
) -> DataFrame:
    """Largest ``value`` among the earlier rows of the key, NULL for the first."""
    carried = _with_carry(_split(df, keys, position, span), F.max(value), F.max)
    within = (
        Window.partitionBy("_key", "_range")
        .orderBy(position, *(ties or []))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return carried.withColumn(
        out, F.greatest(F.max(value).over(within), F.col("_before"))
    ).drop("_key", "_range", "_before")


def unique_locations(
    df: DataFrame, keys: list[str], location: str, position: str, joiner: str = "#", span: int = SPAN
) -> DataFrame:
    """Locations made unique within ``keys``: the first row keeps its location,
    repetitions get ``location#n``, with numbers that no row of the key has yet.

    A made name can meet one that is there (``x, x, x#1``).  Names that are there
    win: of the numbers 1, 2, ... a repetition takes the first ones that are free.
    """
    numbered = number_rows(df, [*keys, location], position, "_n", span=span)
    # Names of the form base#number whose base occurs: the numbers that are taken.
    ending = F.regexp_extract(F.col(location), f"^(.*){re.escape(joiner)}([1-9][0-9]*)$", 2)
    base = F.regexp_extract(F.col(location), f"^(.*){re.escape(joiner)}([1-9][0-9]*)$", 1)
    repeated = numbered.filter(F.col("_n") > 1).groupBy(*keys, location).agg(F.max("_n").alias("_most"))
    wanted = repeated.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(location).alias("_base"), "_most")
    names = df.filter(ending != "").select(*keys, base.alias("_name"), ending.cast("decimal(38,0)").alias("_number")).distinct()
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_name") == F.col("_base"))
    # Only numbers up to repetitions plus taken names matter; one row per base and key.
    taken = names.join(wanted, same).groupBy(*[f"_k{i}" for i in range(len(keys))], "_base").agg(F.sort_array(F.collect_set("_number")).alias("_taken"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col(location) == F.col("_base"))
    joined = numbered.join(taken, on, "left")
    # The m-th free number is m plus the taken ones below it; they are sorted.
    m = (F.col("_n") - 1).cast("decimal(38,0)")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<decimal(38,0)>")), m, lambda n, t: F.when(t <= n, (n + 1).cast("decimal(38,0)")).otherwise(n))
    renamed = F.when(F.col("_n") == 1, F.col(location)).otherwise(F.concat(F.col(location), F.lit(joiner), free.cast("string")))
    return joined.withColumn(location, renamed).select(*df.columns)


def uncovered_ranges(
    ranges: DataFrame, bounds: DataFrame, keys: list[str], start: str = "start", end: str = "end", span: int = SPAN
) -> DataFrame:
    """The parts of each bound that no range covers: ``keys, gap_start, gap_end``.

    ``ranges`` may overlap and lie inside the bound of their key; ``bounds`` has
    one row per key.  Each bound joins the ranges as two empty ranges at its
    ends, so no join is needed.
    """
    columns = [F.col(k) for k in keys]
    edges = [
        bounds.select(*columns, F.col(edge).alias("_s"), F.col(edge).alias("_e"), F.lit(rank).alias("_o"))
        for edge, rank in ((start, 0), (end, 2))
    ]
    inside = ranges.select(*columns, F.col(start).alias("_s"), F.col(end).alias("_e"), F.lit(1).alias("_o"))
    both = inside.unionByName(edges[0]).unionByName(edges[1])
    reach = max_before(both, keys, "_s", "_e", "_reach", ties=["_o", "_e"], span=span)
    return reach.filter(F.col("_reach") < F.col("_s")).select(
        *columns, F.col("_reach").alias("gap_start"), F.col("_s").alias("gap_end")
    )
