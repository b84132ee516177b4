"""Connected components of links between 64-bit nodes.

Tasks first replace their links by stars with a union-find of their own.  Then large
and small stars alternate until nothing changes (Kiveris et al., "Connected Components
in MapReduce and Beyond"); each round is written to the shared folder.  No group is
ever collected: a node's neighbours only meet in a minimum.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.tables import kept

LINKS_AT_ONCE = 500_000
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


class UnionFind:
    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, node: int) -> int:
        up, root = self.up, node
        while (over := up.get(root, root)) != root:
            root = over
        while up.get(node, node) != root:
            up[node], node = root, up[node]
        return root

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        nodes = [n for n in union.up if n != union.find(n)]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([union.find(n) for n in nodes], pa.int64())], schema=_PAIR)

    union = UnionFind()
    for batch in batches:
        for a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True):
            union.join(a, b)
        if len(union.up) > LINKS_AT_ONCE:
            yield out()
            union = UnionFind()
    yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's smallest node."""
    pairs = kept(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(_stars, "a long, b long").distinct(), "stars")
    before = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        below = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        pairs = kept(below.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "stars")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
