"""Chunk rows laid out by vector direction, for exact search of few folders.

Rows are written into cells, one Parquet folder per cell, by their nearest
centre.  Each cell keeps its centre and the widest angle of its rows to it.  A
row of a cell cannot be closer to a query than the centre's angle minus that
width, so cells that cannot hold one of the k nearest rows are never read.  The
result equals the full scan's; only the amount read depends on the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog
from codelode.operators.keyword import keyword_filter
from codelode.operators.search import vector_search

_MARGIN = 1e-6                    # radians; above the rounding of acos near 0


def _nearest(embedding: Column, centres: np.ndarray) -> Column:
    """Cell number and angle to its centre, NULL for NULL or zero vectors."""

    def place(vectors: pa.Array) -> pa.Array:
        present = vectors.drop_null()
        rows = np.asarray(present.flatten(), dtype=np.float64).reshape(len(present), centres.shape[1])
        norms = np.linalg.norm(rows, axis=1)
        cosines = rows @ centres.T / np.where(norms, norms, 1.0)[:, None]
        cell = cosines.argmax(axis=1)
        angle = np.arccos(np.clip(cosines[np.arange(len(rows)), cell], -1.0, 1.0))
        found = iter(zip(cell.tolist(), angle.tolist(), norms.tolist()))
        out = []
        for there in vectors.is_valid().to_pylist():
            c, a, n = next(found) if there else (0, 0.0, 0.0)
            out.append({"cell": c, "angle": a} if n else None)
        return pa.array(out, pa.struct([("cell", pa.int32()), ("angle", pa.float64())]))

    return F.arrow_udf(place, "struct<cell:int,angle:double>")(embedding)


class VectorIndex:
    """A chunk table arranged for cosine search, in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, table: DataFrame, cells: int | None = None, seed: int = 1) -> None:
        """Write ``table`` by cell.  The centres come from all rows; they steer the
        layout, never the results.  Without ``cells`` their number is the square root
        of the number of rows, so cells and the list of cells grow alike."""
        points = table.filter(F.expr("exists(embedding, x -> x != 0)")).select(
            array_to_vector(F.col("embedding").cast("array<double>")).alias("features")
        )
        wanted = cells or max(16, math.isqrt(points.count()))
        model = KMeans(k=wanted, seed=seed, distanceMeasure="cosine", maxIter=10).fit(points)
        centres = np.array(model.clusterCenters())
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)

        placed = (
            table.withColumn("_at", _nearest(F.col("embedding"), centres))
            .withColumns({"cell": F.coalesce("_at.cell", F.lit(-1)), "angle": F.col("_at.angle")})
            .drop("_at")
        )
        # Rebalancing splits a cell with many rows over several tasks and files.
        placed.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{self.folder}/rows")
        kept = self.spark.read.parquet(f"{self.folder}/rows").filter("cell >= 0")
        summary = kept.groupBy("cell", "embedding_model").agg(
            F.count(F.lit(1)).alias("n"), F.max("angle").alias("width")
        )
        where = self.spark.createDataFrame(
            [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>"
        )
        summary.join(F.broadcast(where), "cell").write.mode("overwrite").parquet(f"{self.folder}/cells")

    def _cells(self, query: np.ndarray, model: str | None) -> list[dict]:
        """Cells by the angle of their centre; one small row per cell and model."""
        rows = self.spark.read.parquet(f"{self.folder}/cells")
        if model:
            rows = rows.filter(F.col("embedding_model") == model)
        per_cell = rows.groupBy("cell").agg(F.sum("n").alias("n"), F.max("width").alias("width"), F.first("centre").alias("centre"))
        found = [r.asDict() for r in per_cell.collect()]
        for cell in found:
            cell["angle"] = math.acos(min(1.0, max(-1.0, float(np.dot(cell["centre"], query)))))
        return sorted(found, key=lambda c: (c["angle"], c["cell"]))

    def cells_to_read(
        self, query_vector: list[float], top_k: int, embedding_model: str | None = None, keywords: str | None = None
    ) -> list[int]:
        """Every cell that can hold one of the k nearest rows.

        Nearest cells are searched until k rows are found, twice as many cells each
        time; the k-th distance then rules out the cells that lie too far away.
        """
        query = np.asarray(query_vector, dtype=np.float64)
        cells = self._cells(query / np.linalg.norm(query), embedding_model)
        first, seen = 0, 0
        while first < len(cells) and seen < top_k:
            seen += cells[first]["n"]
            first += 1
        while True:
            near = [c["cell"] for c in cells[:first]]
            found = self._search(near, query_vector, top_k, embedding_model, keywords).select("distance").collect()
            if len(found) == top_k or first >= len(cells):
                break
            first = min(len(cells), 2 * max(1, first))
        reach = math.pi
        if len(found) == top_k:
            reach = math.acos(min(1.0, max(-1.0, 1.0 - max(r.distance for r in found))))
        return near + [c["cell"] for c in cells[first:] if c["angle"] - c["width"] <= reach + _MARGIN]

    def _search(self, cells, query_vector, top_k, embedding_model, keywords) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.folder}/rows").filter(F.col("cell").isin(cells)).drop("cell", "angle")
        return vector_search(keyword_filter(rows, keywords), query_vector, top_k, embedding_model)

    def search(
        self,
        query_vector: list[float],
        top_k: int = catalog.DEFAULT_TOP_K,
        embedding_model: str | None = None,
        keywords: str | None = None,
    ) -> DataFrame:
        """The same rows as ``vector_search`` over the whole table."""
        cells = self.cells_to_read(query_vector, top_k, embedding_model, keywords)
        return self._search(cells, query_vector, top_k, embedding_model, keywords)
