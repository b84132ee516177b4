import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode import catalog, report, service
from codelode.functions import embedding
from codelode.functions.vectors import cosine_similarity
from codelode.operators import search
from codelode.plans import builder
from codelode.plans.index_flow import IndexConfig, index_files
from codelode.service import SearchSession

FILES = [
    ("src/calc.py", "class MathUtils:\n    def is_prime(self, n: int) -> bool:\n        return n > 1\n\ndef fibonacci(n):\n    return n\n"),
    ("src/calc.rs", "fn fibonacci(n: u64) -> u64 { n }\nasync fn main() {}\n"),
    ("src/calc.c", "int add(int a, int b) {\n    return a + b;\n}\n"),
    ("target/gen.py", "def fibonacci_generated():\n    pass\n"),
    ("docs/readme.md", "# Numbers\n\nHow to add numbers.\n"),
]


@pytest.fixture(scope="module")
def table(spark):
    files = spark.createDataFrame([(f, c, "files") for f, c in FILES], "filename string, content string, source_name string")
    return index_files(files).cache()


@pytest.fixture(scope="module")
def session(table):
    return SearchSession(table)


def names(df):
    return [r.filename for r in df.collect()]


def test_index_has_all_columns(table):
    assert [(f.name, f.dataType.simpleString()) for f in table.schema] == catalog.CHUNK_COLUMNS
    assert table.filter("embedding IS NULL OR size(embedding) != 768").count() == 0
    assert search.missing_columns(table) == []
    key = table.select(*catalog.CHUNK_KEY)
    assert key.count() == key.distinct().count()


def test_similarity_matches_numpy(spark):
    pick = np.random.default_rng(1)
    vectors = pick.normal(size=(500, 16)).astype("float32")
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(500, None), (501, [0.0] * 16)]
    query = [float(x) for x in pick.normal(size=16)]
    df = spark.createDataFrame(rows, "i int, v array<float>").repartition(5)
    got = dict(df.select("i", cosine_similarity(F.col("v"), query)).collect())
    assert got[500] is None and got[501] is None
    q = np.array(query)
    exact = vectors.astype(float) @ q / np.linalg.norm(vectors.astype(float), axis=1) / np.linalg.norm(q)
    assert np.allclose([got[i] for i in range(500)], exact)
    with pytest.raises(Exception, match="16 dimensions|must have 3"):
        df.filter("i < 3").select(cosine_similarity(F.col("v"), [1.0, 0.0, 0.0])).collect()
    with pytest.raises(ValueError):
        cosine_similarity(F.col("v"), [0.0, 0.0])


def test_dispatch(session):
    assert names(session.search()) == []
    assert names(session.search(keyword_query="language:c")) == ["src/calc.c"]
    assert session.search("add numbers", language="markdown").first().score_type == "vector_similarity"
    both = session.search("fibonacci", "exists(code)", language="Rust")
    assert names(both) == ["src/calc.rs"]  # the only row of that model
    row = both.first()
    assert row.score_type == "hybrid_combined" and 0.3 < row.score <= 1.0
    with pytest.raises(ValueError, match="language or embedding_model"):
        session.search("fibonacci")
    by_model = session.search("fibonacci", embedding_model="microsoft/graphcodebert-base", language="Rust")
    assert "src/calc.py" in names(by_model) and "src/calc.rs" not in names(by_model)


def test_or_reaches_the_search(session):
    assert names(session.keyword("language:rust OR language:c")) == ["src/calc.c", "src/calc.rs"]


def test_hybrid_rows_are_keyword_rows(session):
    words = "functions:fibonacci"
    assert set(names(session.hybrid("fibonacci", words, language="python"))) <= set(names(session.keyword(words)))


def test_tool_weights(session):
    best = session.vector("fibonacci of n", language="python").first()
    assert best.filename == "src/calc.py" and best.score == pytest.approx(1 - best.distance)
    assert {r.score for r in session.keyword("exists(code)").collect()} == {1.0}


def test_path_filter_before_and_after(table):
    asked = dict(includes=["**/*.py"], excludes=["**/target/**"])
    before = SearchSession(table, **asked).keyword("functions:fibonacci", top_k=1)
    after = SearchSession(table, **asked, post_filter=True).keyword("value_contains(code, fibonacci)", top_k=3)
    assert names(before) == ["src/calc.py"]
    assert set(names(after)) == {"src/calc.py"}


def test_builder(table):
    q = builder.create_query()
    assert names(q.keyword_search().where_language("Python").where_has_functions().run(table)) == ["src/calc.py", "target/gen.py"]
    assert names(q.keyword_search().with_type_hints().where_filename_like("calc").run(table)) == ["src/calc.py", "src/calc.rs"]
    assert names(q.keyword_search().with_async_code().run(table)) == ["src/calc.rs"]
    assert names(q.keyword_search().where_language("C").where_language("Rust").filter_logic_or().run(table)) == ["src/calc.c", "src/calc.rs"]
    assert names(builder.find_functions_in_language("C").run(table)) == ["src/calc.c"]
    assert names(builder.find_complex_code(5).run(table)) == ["src/calc.py"]
    assert names(builder.find_async_python_code().run(table)) == []
    semantic = builder.semantic_search_with_filters("fibonacci", "Python", 0).with_model("microsoft/graphcodebert-base")
    assert set(names(semantic.run(table))) == {"src/calc.py", "target/gen.py"}
    assert names(builder.simple_search("numbers").run(table)) == ["docs/readme.md"]  # default model
    assert names(q.keyword_search().contains_decorator("x").run(table)) == []
    assert q.keyword_search().where_has_docstrings().run(table).count() == 0
    with pytest.raises(ValueError):
        q.vector_search().run(table)


def test_weight_shift():
    q = builder.create_query().hybrid_search(0.7, 0.3)
    shifted = [(builder.adjust_weights(q, f).vector_weight, builder.adjust_weights(q, f).keyword_weight) for f in ("keyword", "vector", "x")]
    assert [tuple(round(w, 6) for w in s) for s in shifted] == [(0.6, 0.4), (0.8, 0.2), (0.7, 0.3)]
    assert builder.adjust_weights(q.keyword_search(), "keyword").vector_weight == 0.7


def test_late_rows(table, session):
    top = search.keyword_search(table.select("filename", "location", "source_name", "start"), None, 2)
    full = search.late_rows(table, top)
    assert sorted(names(full)) == sorted(names(top)) and "code" in full.columns
    assert search.late_rows(table, top.limit(0)).count() == 0


def test_search_late_gives_the_same_rows(session):
    asked = ("fibonacci", "exists(code)"), dict(language="python")
    now, late = session.search(*asked[0], **asked[1]), session.search_late(*asked[0], **asked[1])
    assert {(r.filename, r.score, r.code) for r in now.collect()} == {(r.filename, r.score, r.code) for r in late.collect()}


def test_registered_model(spark):
    embedding.register_model("mine", lambda c: F.transform(F.array(F.length(c), F.lit(1)), lambda x: x.cast("float")))
    try:
        assert embedding.embed_text(spark, "abc", "mine") == [3.0, 1.0]
        assert len(embedding.embed_text(spark, "abc", "other")) == 768
    finally:
        embedding.unregister_model("mine")


def test_models_do_not_share_a_space(spark):
    a, b = (np.array(embedding.embed_text(spark, "alpha beta", m)) for m in ("m1", "m2"))
    assert np.linalg.norm(a) == pytest.approx(1) and not np.allclose(a, b)
    assert embedding.embed_text(spark, "ALPHA  beta!", "m1") == pytest.approx(list(a))


def test_default_embedding_flag(spark):
    files = spark.createDataFrame([("a.py", "x = 1", "files")], "filename string, content string, source_name string")
    row = index_files(files, IndexConfig(default_embedding=True, default_chunking=True)).first()
    assert row.embedding_model == "sentence-transformers/all-mpnet-base-v2" and row.chunking_method == "split_recursively"
    assert index_files(files, IndexConfig(default_language_handler=True)).first().analysis_method == "default_basic"


def test_reports(session):
    found = session.keyword("filename:calc.py")
    out = report.readable(found)
    assert "1. [1.000] (keyword_match) src/calc.py (Python) (L1-L6)" in out and "Functions: fibonacci" in out and "typed" in out
    assert report.readable(found.limit(0)) == "No results found."
    assert '"code": """class MathUtils' in report.pseudo_json(found) and report.pseudo_json(found.limit(0)) == "[]"
    row = json.loads(report.to_json_rows(found).first()[0])
    assert row["filename"] == "src/calc.py" and row["interfaces"] == [] and row["node_counts"]["class_definition"] == 1


def test_tools_and_resources(session, spark):
    assert session.analyze("def f(): pass", "x.py")["functions"] == ["f"]
    assert session.analyze("fn g() {}", "x", "rust")["functions"] == ["g"]
    assert session.embeddings("abc")["dimensions"] == 768
    assert session.stats()["total_records"] == 5
    assert len(session.schema()["columns"]) == 46
    assert session.config()["default_weights"] == {"vector_weight": 0.7, "keyword_weight": 0.3}
    assert names_of(session.languages()) == ["C", "Markdown", "Python", "Rust"]
    for group in session.examples().values():
        for words in group:
            session.keyword(words)
    assert "AND" in session.help_keyword_syntax()["boolean_logic"]
    assert service.list_backends() == ["spark"]
    with pytest.raises(ValueError, match="unknown backend"):
        service.open_session(spark, "/tmp/none", "qdrant")


def names_of(df):
    return [r[0] for r in df.collect()]


def test_plans(table, spark, tmp_path):
    """Top-k without a full sort, pushed filters, pruned columns and partitions."""
    table.write.partitionBy("language").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    found = search.hybrid_search(stored, [1.0] * 768, "language:python", embedding_model="microsoft/graphcodebert-base")
    plan = found.select("filename", "score")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan
    assert "EqualTo(embedding_model,microsoft/graphcodebert-base)" in plan
    assert "lower(language" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "code:string" not in plan.split("ReadSchema:")[1]
    flow = index_files(spark.createDataFrame([("a", "b", "c")], "filename string, content string, source_name string"))
    assert "Exchange" not in flow._jdf.queryExecution().executedPlan().toString()
