"""Small helpers for jobs of several steps."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import work_folder

BITMAP_BITS = 26
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(frame: DataFrame, purpose: str, options: dict[str, str] | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: lost executors lose nothing.

    The shuffle files that led to them go as soon as they are written, and what Spark sent
    to tasks for jobs that are over with the next collection of the JVM's garbage."""
    folder = work_folder(frame.sparkSession, purpose)
    conf = frame.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        frame.write.options(**(options or {})).parquet(folder)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    gc.collect()
    frame.sparkSession._jvm.System.gc()
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go as soon as each is done."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def bitmap(keys: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit for the top ``bits`` bits of every 64-bit key: 8 MB for 26 bits, whatever the data.

    A set bit may belong to another key, a missing bit is certain.
    """
    top = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = keys.select(F.shiftright(top, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned({column}, {64 - bits}) & 63 AS INT))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    found = np.zeros(1 << (bits - 6), np.uint64)
    found[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return found


def has_bit(words: np.ndarray, keys: np.ndarray, bits: int = BITMAP_BITS) -> np.ndarray:
    top = keys.astype(np.uint64) >> np.uint64(64 - bits)
    return (words[top >> np.uint64(6)] >> (top & np.uint64(63)) & np.uint64(1)).astype(bool)


def in_groups(frame: DataFrame, keys: list[str], work: Callable[[list[dict]], Iterator[dict]], schema: pa.Schema, ddl: str, rows_at_once: int = 20_000) -> DataFrame:
    """Applies ``work`` to the rows of each key, one key after the other in sorted order."""
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, made = [], None, []

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(made, schema=schema)
            made.clear()
            return batch

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                key = tuple(row[k] for k in keys)
                if key != last and held:
                    made.extend(work(held))
                    held = []
                    if len(made) >= rows_at_once:
                        yield out()
                last = key
                held.append(row)
        if held:
            made.extend(work(held))
        yield out()

    return frame.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


