"""Many query vectors against a table: blocks of requests meet blocks of rows.

Requests and rows are both tables.  Each row goes once to every block of requests, each
request once to every block of rows; a task gets the requests of a pair of blocks first,
holds them as one matrix and streams the rows of the pair past it, so its memory follows
the block sizes.  What leaves it are the k best rows of each request in the pair, which
a window over the request merges.  Vectors of another length never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUESTS_PER_BLOCK = 2048
ROWS_PER_BLOCK = 16_384
ROWS_AT_ONCE = 1024
_PAIR = ["_size", "_requests", "_rows"]


def _units(batch: pa.RecordBatch, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1, and which of the rows low .. high have a direction at all."""
    column = batch.column("_vector").slice(low, high - low)
    vectors = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(high - low, -1)
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        lengths = np.sqrt((vectors**2).sum(axis=1))
        usable = np.isfinite(lengths) & (lengths > 0)
        return vectors[usable] / lengths[usable, None], np.flatnonzero(usable) + low


def _k_of_each(rows: pa.Table, k: int, keys: list[str]) -> pa.Table:
    order = [("query_id", "ascending"), ("score", "descending"), *((n, "ascending") for n in keys)]
    rows = rows.sort_by(order)
    query = rows["query_id"].to_numpy()
    first = np.searchsorted(query, query, "left")
    return rows.filter(pa.array(np.arange(len(query)) - first < k))


class _Pair:
    """The requests of one pair of blocks and the best rows so far."""

    def __init__(self, k: int, keys: list[str]):
        self.k, self.keys = k, keys
        self.parts: list[np.ndarray] = []
        self.ids = np.zeros(0, np.int64)
        self.matrix: np.ndarray | None = None
        self.found: list[pa.Table] = []
        self.held = 0

    def ask(self, batch: pa.RecordBatch, low: int, high: int) -> None:
        vectors, at = _units(batch, low, high)
        self.parts.append(vectors)
        self.ids = np.concatenate([self.ids, batch.column("query_id").to_numpy(zero_copy_only=False)[at].astype(np.int64)])

    def meet(self, batch: pa.RecordBatch, low: int, high: int) -> None:
        if not len(self.ids):
            return
        if self.matrix is None:
            order = np.argsort(self.ids, kind="stable")
            self.matrix, self.ids = np.concatenate(self.parts)[order], self.ids[order]
            self.bar = np.full(len(self.ids), -np.inf)
        for first in range(low, high, ROWS_AT_ONCE):
            vectors, at = _units(batch, first, min(high, first + ROWS_AT_ONCE))
            scores, bar = self.matrix @ vectors.T, self.bar
            if len(at) > self.k and np.isneginf(bar).any():  # before the first pruning: the k best of these rows
                bar = np.maximum(bar, np.partition(scores, -self.k, axis=1)[:, -self.k])
            query, row = np.nonzero(scores >= bar[:, None])  # ties stay in
            self.found.append(pa.table({"query_id": pa.array(self.ids[query]), **{k: batch.column(k).take(pa.array(at[row])) for k in self.keys}, "score": pa.array(scores[query, row])}))
            self.held += len(query)
            if self.held > 4 * self.k * len(self.ids) + 65_536:
                self.prune()

    def prune(self) -> pa.Table:
        best = _k_of_each(pa.concat_tables(self.found), self.k, self.keys)
        self.found, self.held = [best], best.num_rows
        ids, score = best["query_id"].to_numpy(), best["score"].to_numpy()
        last = np.searchsorted(ids, self.ids, "right") - 1
        full = last + 1 - np.searchsorted(ids, self.ids, "left") >= self.k
        self.bar[full] = score[last[full]]
        return best


def multi_query_search(rows: DataFrame, requests: DataFrame, top_k: int, keys: list[str], ties: list[Column], requests_per_block: int = REQUESTS_PER_BLOCK, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """query_id, rank, the key columns and the cosine score of the ``top_k`` nearest rows.

    ``requests`` has query_id (each id once) and embedding, ``rows`` the keys and
    embedding.  Vectors that are NULL, hold NULL or have no finite direction take no part;
    a request with none of them, or of a length no row has, has no result.
    """
    plain = F.expr("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")
    size = F.size("embedding").alias("_size")
    rows, requests = rows.filter(plain), requests.filter(plain)
    request_blocks = max(1, -(-requests.count() // requests_per_block))
    row_blocks = max(1, -(-rows.count() // rows_per_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    vector = F.col("embedding").cast("array<double>").alias("_vector")
    none = [F.lit(None).cast(kind).alias(n) for n, kind in rows.select(*keys).dtypes]
    asked = requests.select(size, F.pmod(F.xxhash64("query_id"), F.lit(request_blocks)).cast("int").alias("_requests"), each(row_blocks).alias("_rows"), F.lit(0).alias("_kind"), F.col("query_id").cast("long"), vector, *none)
    dealt = rows.select(size, each(request_blocks).alias("_requests"), F.pmod(F.xxhash64(*keys), F.lit(row_blocks)).cast("int").alias("_rows"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("query_id"), vector, *keys)
    # an empty vector has no direction
    pairs = asked.unionByName(dealt).filter("_size > 0").repartition(*_PAIR).sortWithinPartitions(*_PAIR, "_kind")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, last = _Pair(top_k, keys), None
        for batch in batches:
            where = np.stack([batch.column(n).to_numpy() for n in (*_PAIR, "_kind")], axis=1)
            cuts = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for low, high in zip([0, *cuts], [*cuts, len(where)]):
                if low == high:
                    continue
                if (own := tuple(where[low, :3])) != last:
                    if pair.found:
                        yield from pair.prune().to_batches()
                    pair, last = _Pair(top_k, keys), own
                (pair.meet if where[low, 3] else pair.ask)(batch, int(low), int(high))
        if pair.found:
            yield from pair.prune().to_batches()

    kinds = ", ".join(f"`{n}` {kind}" for n, kind in rows.select(*keys).dtypes)
    found = pairs.mapInArrow(best, f"query_id long, {kinds}, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *ties)
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", *keys, "score")
