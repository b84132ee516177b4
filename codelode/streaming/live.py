"""Keeping a chunk store up to date: one-shot, polling and streaming."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codelode.plans.index_flow import IndexConfig, index_files
from codelode.sources.files import full_path, list_files, scan
from codelode.sources.listing import can_open, with_content
from codelode.sources.store import FILE_KEY, ChunkStore, changes, snapshot


def update(
    store: ChunkStore,
    files: DataFrame,
    config: IndexConfig = IndexConfig(),
    load: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Bring the store to the state of ``files``; returns the number of the last run.

    Only added and changed files are chunked and embedded; removed files lose
    their rows.  The list of changes is stored first, because chunk rows and
    file states must follow the same decision.  ``files`` may be a listing without
    content: then ``load`` adds it to the rows of added and changed files.
    """
    spark = store.spark
    if config.rescan:
        store.clear()
    known = store.manifest().filter(~F.col("removed"))
    diff = changes(known, snapshot(files)).filter(F.col("state") != "unchanged")
    decided = f"{store.folder}/pending/{uuid.uuid4().hex}"
    diff.write.parquet(decided)
    diff = spark.read.schema(diff.schema).parquet(decided)
    run = store.next_run()
    if diff.isEmpty():
        store.drop_work(decided)
        return run - 1
    new = diff.filter(F.col("state").isin("added", "changed"))
    fresh = files.join(new, FILE_KEY, "left_semi")
    if load is None and "modified" in files.columns:
        # A file scan skips the content of files older than every change.
        oldest = files.select(*FILE_KEY, "modified").join(new, FILE_KEY, "left_semi").agg(F.min("modified")).first()[0]
        if oldest is not None:
            fresh = files.filter(F.col("modified") >= F.lit(oldest)).join(new, FILE_KEY, "left_semi")
    store.write_run(run, index_files(load(fresh) if load else fresh, config), snapshot(fresh), diff.filter(F.col("state") == "removed"), replaced=diff.filter("stale_run IS NOT NULL").select(*FILE_KEY, "stale_run"))
    store.drop_work(decided)
    return run


def update_paths(spark: SparkSession, store: ChunkStore, config: IndexConfig) -> int:
    """One update from the configured folders; only new and changed files are opened."""
    asked = config.paths, config.include, config.exclude, config.use_gitignore
    if all(can_open(full_path(spark, p)) for p in config.paths):
        return update(store, list_files(spark, *asked), config, with_content)
    return update(store, scan(spark, *asked), config)


def follow(
    spark: SparkSession,
    store: ChunkStore,
    config: IndexConfig,
    stop: Callable[[], bool],
    error_pause: float = 10.0,
    wait: Callable[[float], None] = time.sleep,
) -> int:
    """Update, wait, repeat until ``stop()``; after an error wait and retry.

    Returns the number of finished updates.  Unlike a file stream it sees
    removed and rewritten files.
    """
    done = 0
    while not stop():
        try:
            update_paths(spark, store, config)
            done += 1
            pause = config.poll_seconds
        except Exception as error:  # the next round may succeed
            print(f"update failed, retrying: {error}")
            pause = error_pause
        if stop():
            break
        wait(pause)
    return done


def index_stream(
    files: DataFrame,
    store: ChunkStore,
    checkpoint: str,
    config: IndexConfig = IndexConfig(),
    available_now: bool = True,
) -> StreamingQuery:
    """Index a stream of file rows into the store, one run per micro-batch.

    A run carries the identity of the query (kept in its checkpoint) and of the
    batch, so a batch replayed after a failure is written once, and a stream with
    another checkpoint adds to what is there.  Within a batch the latest version of
    a file counts where the stream carries a ``modified`` time.
    """
    spark = store.spark

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]
        token = f"{query}-{number}"
        if store.has(token):
            return
        if "modified" in batch.columns:
            newest = batch.groupBy(*FILE_KEY).agg(F.max("modified").alias("modified"))
            batch = batch.join(newest, [*FILE_KEY, "modified"], "left_semi")
        store.write_run(store.next_run(), index_files(batch, config), snapshot(batch), token=token)

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{config.poll_seconds} seconds").start()
