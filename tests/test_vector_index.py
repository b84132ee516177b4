import numpy as np
import pytest

from codelode.operators import search
from codelode.operators.keyword import keyword_filter
from codelode.sources.vector_index import VectorIndex


@pytest.fixture(scope="module")
def table(spark):
    pick = np.random.default_rng(5)
    centres = pick.normal(size=(12, 24)) * 4
    rows = []
    for i in range(3000):
        cluster = 0 if i % 3 == 0 else int(pick.integers(1, 12))  # one cluster holds a third
        vector = centres[cluster] + pick.normal(size=24) * 0.3
        rows.append((f"f{i}", "line:1#0", "s", f"word{i % 7}", [float(x) for x in vector], f"m{i % 2}"))
    rows += [("none", "line:1#0", "s", "x", None, "m0"), ("zero", "line:1#0", "s", "x", [0.0] * 24, "m0")]
    return spark.createDataFrame(
        rows, "filename string, location string, source_name string, code string, embedding array<float>, embedding_model string"
    ).cache()


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    made = VectorIndex(spark, str(tmp_path_factory.mktemp("index")))
    made.build(table, cells=16)
    return made


def _rows(df):
    return [(r.filename, round(r.distance, 9)) for r in df.collect()]


@pytest.mark.parametrize("model, keywords", [(None, None), ("m1", None), ("m0", "code:word3"), (None, "code:nothing")])
def test_same_rows_as_full_scan(table, index, model, keywords):
    pick = np.random.default_rng(9)
    for case in range(3):
        # near a stored vector, and anywhere
        query = [float(x) for x in (pick.normal(size=24) if case == 2 else np.array(table.take(40)[case * 17].embedding) + 0.1)]
        full = search.vector_search(keyword_filter(table, keywords), query, 10, model)
        assert _rows(index.search(query, 10, model, keywords)) == _rows(full)


def test_few_cells_are_read(table, index, spark):
    query = list(table.first().embedding)
    read = index.cells_to_read(query, 10)
    assert 0 < len(read) < 8
    plan = index.search(query, 10)._jdf.queryExecution().executedPlan().toString()
    assert "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert spark.read.parquet(f"{index.folder}/rows").count() == table.count()  # nothing is lost
