"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes least distance by one more coordinate,
``sqrt(M^2 - |v|^2)`` with the largest norm M (0 for a query scaled to norm M).  Each of
``TABLES`` tables cuts ``hashes`` Gaussian projections into cells of equal width.

A query visits buckets in the order of their estimated success.  A neighbour's
projection differs from the query's by a normal variable whose spread is the distance
``r`` of a k-th neighbour, so each cell of each projection has a probability, and a
bucket their product.  Visiting ends when the visited buckets hold ``success`` of it.
Close neighbours thus need few buckets, and no bucket count is fixed.

``r`` is the query's own.  The first round takes the median of a sample; a query whose
k-th neighbour found is farther away than that is asked again with the distance found, so
in the end every query's visits hold ``success`` for its own k-th neighbour.  The candidates of
all tables are merged and ranked by the exact inner product.

``r`` and the cell width are fitted on ``SAMPLE`` vectors (those with the least hash of
their id); every vector is indexed.  Equal vectors are one index entry with its smallest
ids: of equal scores no more than k + 1 of them can ever be in a result.  Buckets above
``heavy`` entries are cut by a hash of the vector and queried in all parts, so no task
gets a whole hot bucket; at most ``HEAVY_BUCKETS`` can exist, which bounds their list.
A query with fewer than k results is asked again with the distance its k-th neighbour
should have by the sample, and if they are still fewer, in every bucket.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm import tables

TABLES = 2
SUCCESS = 0.78
CELL = 1.5
BUCKET_ROWS = 64
SHARD_ROWS = 16_384
HEAVY_BUCKETS = 100_000
SAMPLE = 4096
QUERIES_AT_ONCE = 512
QUERIES_PER_TASK = 64


@dataclass
class Index:
    """Everything a task needs to hash a vector and to order its probes."""

    projections: np.ndarray  # tables x (dimension + 1) x hashes
    shifts: np.ndarray
    width: float
    spread: float
    norm: float
    shards: int
    heavy: int
    sample: np.ndarray  # some vectors
    near: int  # the place among them that a k-th neighbour of all would have

    def positions(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of cells: tables x rows x hashes."""
        norms = np.sqrt((vectors**2).sum(axis=1))
        if query:
            longer = np.column_stack([vectors * (self.norm / norms)[:, None], np.zeros(len(vectors))])
        else:
            longer = np.column_stack([vectors, np.sqrt(np.maximum(0.0, self.norm**2 - norms**2))])
        return np.einsum("rd,tdh->trh", longer, self.projections) / self.width + self.shifts[:, None, :]

    def estimate(self, vectors: np.ndarray) -> np.ndarray:
        """How far the k-th neighbour of each query may be, judged by the sample."""
        longer = vectors * (self.norm / np.sqrt((vectors**2).sum(axis=1)))[:, None]
        apart = np.maximum(0.0, 2 * self.norm**2 - 2 * longer @ self.sample.T)
        apart[apart <= 1e-12 * self.norm**2] = np.inf  # the query itself, and its copies
        nearest = np.partition(apart, min(self.near, apart.shape[1] - 1), axis=1)[:, min(self.near, apart.shape[1] - 1)]
        return np.sqrt(np.where(np.isfinite(nearest), nearest, 2 * self.norm**2))

    def probes(self, position: np.ndarray, success: float, spread: float) -> list[tuple[int, ...]]:
        """Cells of the buckets to visit, most probable first, for neighbours ``spread`` away."""
        unit = spread / self.width * math.sqrt(2)
        options = []
        for x in position.tolist():
            reach = max(2, math.ceil(4 * spread / self.width))
            cells = range(math.floor(x) - reach, math.floor(x) + reach + 1)
            chance = [(0.5 * (math.erf((c + 1 - x) / unit) - math.erf((c - x) / unit)), c) for c in cells]
            options.append([(math.log(max(p, 1e-12)), c) for p, c in sorted(chance, reverse=True)])
        first = (0,) * len(options)
        heap, seen, visited = [(-sum(o[0][0] for o in options), first, 0)], 0.0, []
        while heap and seen < success:
            loss, pick, start = heapq.heappop(heap)
            seen += math.exp(-loss)
            visited.append(tuple(o[k][1] for o, k in zip(options, pick, strict=True)))
            for j in range(start, len(options)):
                if pick[j] + 1 < len(options[j]):
                    step = options[j][pick[j]][0] - options[j][pick[j] + 1][0]
                    heapq.heappush(heap, (loss + step, (*pick[:j], pick[j] + 1, *pick[j + 1 :]), j))
        return visited


_MIX = np.array([pow(0xD1342543DE82EF95, k + 1, 2**64) for k in range(64)], np.uint64)


def _bucket(table: int, cells: np.ndarray) -> np.ndarray:
    """A 63-bit name of a bucket; buckets that happened to share one would only add candidates."""
    names = np.full(len(cells), (table + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for k in range(cells.shape[1]):
        names = (names ^ (cells[:, k].astype(np.int64).view(np.uint64) + _MIX[k % 64])) * np.uint64(0xBF58476D1CE4E5B9)
        names ^= names >> np.uint64(29)
    return (names >> np.uint64(1)).astype(np.int64)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the rows that take part: no NULLs, finite, not zero, of the usual length."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"))
    fine = rows.where(
        F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    )
    usual = fine.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return fine.where(F.size("vector") == (usual["n"] if usual else 0))


def _entries(fine: DataFrame, k: int) -> DataFrame:
    """One entry per distinct vector with its k + 1 smallest ids."""
    order = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    least = fine.distinct().withColumn("place", order).where(F.col("place") <= k + 1)
    return least.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("gid", F.col("ids")[0])


def _fit(entries: DataFrame, rows: int, k: int, count_tables: int, seed: int = 7) -> Index | None:
    norm = entries.select(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()[0]
    sample = entries.select("vector").orderBy(F.xxhash64("gid"), "gid").limit(SAMPLE).toPandas()["vector"]
    if norm is None or not len(sample):
        return None
    some = np.stack([np.asarray(v, np.float64) for v in sample])
    norms = np.sqrt((some**2).sum(axis=1))
    stored = np.column_stack([some, np.sqrt(np.maximum(0, norm**2 - norms**2))])
    asked = np.column_stack([some * (norm / norms)[:, None], np.zeros(len(some))])[:256]
    apart = np.sqrt(np.maximum(0, (asked**2).sum(axis=1)[:, None] + (stored**2).sum(axis=1)[None] - 2 * asked @ stored.T))
    apart[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    apart.sort(axis=1)
    near = max(0, min(len(some) - 2, round(k * len(some) / rows) - 1))
    spread = float(np.median(apart[:, near])) if len(some) > 1 else norm
    spread = max(spread, 1e-6 * norm)
    hashes = max(0, round(math.log(max(1.0, rows / BUCKET_ROWS), 3)))
    rng = np.random.default_rng(seed)
    width = CELL * max(float((stored @ rng.normal(size=(stored.shape[1], 16))).std()), spread)
    return Index(
        rng.normal(size=(count_tables, stored.shape[1], hashes)), rng.uniform(0, 1, (count_tables, hashes)), width, spread, float(norm),
        max(1, math.ceil(rows * count_tables / SHARD_ROWS)), max(SHARD_ROWS // 2, math.ceil(rows * count_tables / HEAVY_BUCKETS)), some, near,
    )


_HITS = "query_id long, gid long, score double"


def _shard_hits(dimension: int, most: int):
    """The best entries of each query in the probed buckets of each shard."""

    def best(index: list[pa.RecordBatch], asked: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = pa.Table.from_batches(index)
        vectors = np.concatenate([_matrix(b.column("vector"), dimension) for b in index])
        names, place = np.unique(stored["bucket"].to_numpy(), return_inverse=True)
        # An entry may lie in the shard once for each table; it is scored once.
        order = np.argsort(stored["gid"].to_numpy(), kind="stable")
        gids, first = np.unique(stored["gid"].to_numpy()[order], return_index=True)
        vectors, place = vectors[order[first]], place[order]
        for batch in asked:
            for low in range(0, batch.num_rows, QUERIES_AT_ONCE):
                part = batch.slice(low, QUERIES_AT_ONCE)
                queries, lists = _matrix(part.column("vector"), dimension), part.column("probes")
                owner = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
                wanted = lists.flatten().to_numpy()
                at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                visit = np.zeros((part.num_rows, len(names)), bool)
                visit[lists.is_null().to_numpy(zero_copy_only=False)] = True  # the second round
                there = names[at] == wanted
                visit[owner[there], at[there]] = True
                scores = queries @ vectors.T
                scores[~np.logical_or.reduceat(visit[:, place], first, axis=1)] = -np.inf
                take = min(most + 3, scores.shape[1])
                picked = np.argpartition(-scores, take - 1, axis=1)[:, :take]
                found = np.isfinite(np.take_along_axis(scores, picked, 1))
                asker, entry = np.nonzero(found)[0], picked[found]
                exact = (queries[asker] * vectors[entry]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(part.column("gid").to_numpy()[asker]), pa.array(gids[entry]), pa.array(exact)], ["query_id", "gid", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, index = None, []
        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False).astype(int)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds) != 0)) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(shards)], strict=True):
                if high == low:
                    continue
                if shards[low] != shard:
                    shard, index = shards[low], []
                part = batch.slice(low, high - low)
                if not kinds[low]:
                    index.append(part)
                elif index:
                    yield from best(index, [part])

    return run


def _round(entries: DataFrame, queries: DataFrame, index: Index, heavy: dict[int, int], k: int, dimension: int, success: float) -> DataFrame:
    shared = entries.sparkSession.sparkContext.broadcast((index, heavy))
    vector = entries.schema["vector"].dataType.simpleString()

    def shard_of(names: np.ndarray, parts: np.ndarray, index: Index) -> np.ndarray:
        return (names % 2_147_483_629 + parts) % index.shards

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, heavy = shared.value
        for batch in batches:
            gids = batch.column("gid").to_numpy()
            for table, position in enumerate(index.positions(_matrix(batch.column("vector"), dimension), False)):
                names = _bucket(table, np.floor(position))
                parts = np.array([heavy.get(n, 1) for n in names.tolist()], np.int64)
                part = (gids * 2654435761 % 4294967291) % np.maximum(parts, 1)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(names, part, index)), pa.array(np.zeros(len(names), bool)), batch.column("gid"), batch.column("vector"), pa.array(names), pa.array([None] * len(names), pa.list_(pa.int64()))], ["shard", "query", "gid", "vector", "bucket", "probes"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, heavy = shared.value
        for batch in batches:
            rows, shards, probes = [], [], []
            asking = _matrix(batch.column("vector"), dimension)
            positions = index.positions(asking, True)
            spread = batch.column("reach").to_numpy(zero_copy_only=False)
            spread = np.maximum(np.where(spread < 0, index.estimate(asking), spread), index.spread) if batch.num_rows else spread
            for row in range(batch.num_rows):
                if success >= 1:
                    visits: dict[int, list[int] | None] = dict.fromkeys(range(index.shards))
                else:
                    visits = {}
                    for table in range(len(positions)):
                        cells = index.probes(positions[table, row], success, float(spread[row]))
                        names = _bucket(table, np.array(cells, np.int64).reshape(len(cells), positions.shape[2]))
                        for name in names.tolist():
                            for part in range(heavy.get(name, 1)):
                                visits.setdefault(int((name % 2_147_483_629 + part) % index.shards), []).append(name)
                for shard, names in visits.items():
                    rows.append(row)
                    shards.append(shard)
                    probes.append(names)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(np.ones(len(rows), bool)), batch.column("gid").take(take), batch.column("vector").take(take), pa.array(np.zeros(len(rows), np.int64)), pa.array(probes, pa.list_(pa.int64()))], ["shard", "query", "gid", "vector", "bucket", "probes"])

    schema = f"shard long, query boolean, gid long, vector {vector}, bucket long, probes array<long>"
    stored = entries.select("gid", "vector").mapInArrow(store, schema)
    # ordering the probes is the work of a query: queries are dealt out first
    dealt_out = queries.repartition(max(1, -(-queries.count() // QUERIES_PER_TASK)), "id")
    asked = dealt_out.select(F.col("id").alias("gid"), "vector", "reach").mapInArrow(ask, schema)
    dealt = stored.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "query")
    return dealt.mapInArrow(_shard_hits(dimension, k + 1), _HITS)


def _ranked(hits: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    groups = Window.partitionBy("query_id").orderBy(F.desc("score"), "gid")
    best = hits.distinct().withColumn("place", F.row_number().over(groups)).where(F.col("place") <= k + 1).drop("place")
    single = best.join(entries.select("gid", "ids"), "gid").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, success: float = SUCCESS, count_tables: int = TABLES, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k vectors of largest inner product with each query, its own row left out.

    Result: query_id, rank (from 1), vec_id, score; ties go to the smaller id.  Rows with
    a NULL id, and vectors that are NULL, zero, of an unusual length or hold NULL or
    non-finite components take no part on either side.  A repeated id is one vector id
    with several vectors.
    """
    spark = vectors.sparkSession
    fine = usable(vectors, id_column, vector_column)
    asked = queries.select(F.col(id_column).cast("long").alias("id")).distinct()
    entries = tables.kept(_entries(fine, k), "entries")
    rows = entries.count()
    index = _fit(entries, rows, k, count_tables)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension = index.projections.shape[1] - 1
    asked = tables.kept(fine.join(asked, "id", "left_semi"), "queries")

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for table, position in enumerate(index.positions(_matrix(batch.column(0), dimension), False)):
                name, n = np.unique(_bucket(table, np.floor(position)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(n, pa.int64())], ["bucket", "n"])

    counts = entries.select("vector").mapInArrow(names, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    heavy = {r["bucket"]: -(-r["n"] // index.heavy) for r in counts.where(F.col("n") > index.heavy).collect()}
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    waiting = asked.withColumn("reach", F.lit(index.spread))
    hits, done = None, []
    while True:  # at most with the fitted distance, then the one found or estimated, then the one found
        new = tables.kept(_round(entries, waiting, index, heavy, k, dimension, success), "hits")
        ids = waiting.select(F.col("id").alias("query_id")).distinct()
        hits = new if hits is None else tables.kept(new.unionByName(hits.join(ids, "query_id", "left_semi")), "hits")
        found = tables.kept(_ranked(hits, entries, k), "found")
        # the visits must suffice for the distance of the k-th neighbour found so far
        last = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "score")
        apart = F.sqrt(F.greatest(F.lit(0.0), 2 * index.norm**2 - 2 * index.norm * F.col("score") / length))
        judged = waiting.join(last, "id", "left").where(F.col("score").isNull() | (apart > F.col("reach") * (1 + 1e-9)))
        again = judged.select("id", "vector", F.coalesce(apart, F.lit(-1.0)).alias("reach"), (F.col("score").isNull() & (F.col("reach") < 0)).alias("lost"))
        again = tables.kept(again, "again")
        done.append(found.join(again.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti"))
        lost, waiting = again.where("lost").drop("lost"), again.where("NOT lost").drop("lost")
        if not lost.isEmpty():  # fewer than k in reach of the sample's estimate: every bucket is visited
            done.append(_ranked(_round(entries, lost, index, heavy, k, dimension, 1.0), entries, k))
        if waiting.isEmpty():
            return reduce(DataFrame.unionByName, done)
