"""Many requests against a table in blocks, against a plain search."""

import pyarrow as pa
import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.operators import block_search
from codelode.operators import search
from codelode.operators.block_search import multi_query_search


@pytest.mark.parametrize("requests_per_block, rows_per_block", [(2048, 16_384), (7, 50)])
def test_blocks(spark, requests_per_block, rows_per_block):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 8))
    vectors[100:130] = vectors[99]  # ties
    rows = [(f"f{k:04d}", v.tolist()) for k, v in enumerate(vectors)]
    odd = [("none", None), ("zero", [0.0] * 8), ("nan", [float("nan")] * 8), ("null", [None] * 8), ("short", [1.0, 2.0]), ("empty", [])]
    asked = [(k, vectors[k].tolist()) for k in range(0, 700, 20)] + [(5001, None), (5002, [0.0] * 8), (5003, [3.0] * 5), (5004, [2.0, 4.0])]
    table = spark.createDataFrame(rows + odd, "filename string, embedding array<double>")
    requests = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    found = multi_query_search(table, requests, 12, ["filename"], [F.col("filename")], requests_per_block, rows_per_block).toPandas()
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q, own in found.groupby("query_id"):
        own = own.sort_values("rank")
        if q == 5004:
            assert list(own.filename) == ["short"]
            continue
        scores = np.round(units @ units[q], 9)
        best = np.lexsort((np.arange(700), -scores))[:12]
        assert list(own["rank"]) == list(range(1, 13)) and list(own.filename) == [f"f{k:04d}" for k in best]
    assert set(found.query_id) == {k for k, _ in asked[:35]} | {5004}


def test_no_rows_or_requests(spark):
    table = spark.createDataFrame([("a", [1.0])], "filename string, embedding array<float>")
    requests = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<float>")
    assert search.multi_query_search(table, requests.limit(0)).count() == 0
    assert search.multi_query_search(table.limit(0), requests).count() == 0
    assert [tuple(r) for r in search.multi_query_search(table, requests).collect()] == [(1, 1, "a", 1.0)]


def test_first_rows_are_not_held_whole():
    vectors = np.random.default_rng(5).normal(size=(1300, 8))
    batch = pa.record_batch({"query_id": pa.array(range(1300)), "name": pa.array(range(1300)), "_vector": pa.array(vectors.tolist(), pa.list_(pa.float64()))})
    pair = block_search._Pair(3, ["name"])
    pair.ask(batch, 0, 50)
    pair.meet(batch, 0, 1300)
    assert pair.held == 2 * 3 * 50  # two slabs, three of each for a request
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    best = np.argsort(-(units[:50] @ units.T), axis=1, kind="stable")[:, :3]
    assert pair.prune()["name"].to_numpy().reshape(50, 3).tolist() == best.tolist()
