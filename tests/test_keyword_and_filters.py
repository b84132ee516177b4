import pytest

import __spark_entry__ as entry_point
from codelode.operators import filters
from codelode.operators.fields import resolve_field
from codelode.operators.filters import QueryFilter
from codelode.operators.keyword import keyword_filter, keyword_sql

ROWS = [
    ("a/test file.py", "python", "def parse(x): 100% sure", ["parse", "load"], 5, True, '{"k": 1, "n": {"a": [1, 2]}}', [1.0]),
    ("b.rs", "Rust", "fn main() { it's }", ["main"], 12, False, '{"k": "1", "t": true}', None),
    ("c.py", "Python", "async def main(): pass\\n", [], 0, True, '{"k": null}', [0.5]),
    ("d.c", "C", "int parse_all(void)", None, None, None, None, None),
]
SCHEMA = (
    "filename string, language string, code string, functions array<string>, complexity_score bigint,"
    " has_async boolean, metadata_json string, embedding array<float>"
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def found(df):
    return sorted(r.filename for r in df.collect())


@pytest.mark.parametrize(
    "query, expected",
    [
        ("", ["a/test file.py", "b.rs", "c.py", "d.c"]),
        ("language:python", ["a/test file.py", "c.py"]),
        ('filename:"test file.py"', ["a/test file.py"]),
        ("filename:'test file.py'", ["a/test file.py"]),
        ("exists(embedding)", ["a/test file.py", "c.py"]),
        ("EXISTS(embedding) And language:PYTHON", ["a/test file.py", "c.py"]),
        ("language:python OR language:rust", ["a/test file.py", "b.rs", "c.py"]),
        ("language:python and functions:parse or language:rust", ["a/test file.py", "b.rs"]),
        ("language:python and (functions:parse or language:rust)", ["a/test file.py"]),
        ("(language:python or language:rust) exists(embedding)", ["a/test file.py", "c.py"]),
        ("has_async:true complexity_score:5", ["a/test file.py"]),
        ("has_async:no", ["b.rs"]),
        ('value_contains(functions, "MAI")', ["b.rs"]),
        ('value_contains(code, "it\'s")', ["b.rs"]),
        ("async def", ["c.py"]),
        ("main language:rust", ["b.rs"]),
        ('value_contains(code, "parse_")', ["a/test file.py", "d.c"]),  # _ is a wildcard
        ('value_contains(code, "\\n")', ["c.py"]),  # a backslash is itself
        ('language:"python and rust"', []),
        ("lang:c", ["d.c"]),
        ("orders", []),
    ],
)
def test_keyword_query(table, query, expected):
    assert found(keyword_filter(table, query)) == sorted(expected)


@pytest.mark.parametrize(
    "query",
    ["(language:c", "language:c)", "nope:1", "has_async:maybe", "complexity_score:many", "language:c or", "a:b:c", '"quoted"', "embedding:1"],
)
def test_bad_keyword_query(table, query):
    with pytest.raises(ValueError):
        keyword_filter(table, query).collect()


def test_values_cannot_leave_their_literal(table):
    assert found(keyword_filter(table, "filename:\"x') OR ('1'='1\"")) == []
    assert keyword_sql(table, "language:rust filename:b") == "lower(`language`) = lower('rust') AND `filename` ILIKE '%b%'"


@pytest.mark.parametrize(
    "operator, field, value, expected",
    [
        ("=", "language", "C", ["d.c"]),
        ("!=", "complexity_score", 5, ["b.rs", "c.py"]),  # NULL drops
        (">", "complexity_score", "4", ["a/test file.py", "b.rs"]),
        ("<=", "complexity_score", 0, ["c.py"]),
        ("IN", "language", ["C", "Rust"], ["b.rs", "d.c"]),
        ("NOT IN", "language", ["C", "Rust"], ["a/test file.py", "c.py"]),
        ("IS NULL", "functions", None, ["d.c"]),
        ("IS NOT NULL", "functions", None, ["a/test file.py", "b.rs", "c.py"]),
        ("CONTAINS", "functions", "load", ["a/test file.py"]),
        ("LIKE", "filename", "%.py", ["a/test file.py", "c.py"]),
        ("ILIKE", "language", "PYTHON", ["a/test file.py", "c.py"]),
        ("CONTAINS", "metadata_json", {"k": 1}, ["a/test file.py"]),
        ("CONTAINS", "metadata_json", {"k": "1"}, ["b.rs"]),
        ("CONTAINS", "metadata_json", {"t": True}, ["b.rs"]),
        ("CONTAINS", "metadata_json", {"k": None}, ["c.py"]),
        ("CONTAINS", "metadata_json", {"n": {"a": [2]}}, ["a/test file.py"]),
    ],
)
def test_typed_operator(table, operator, field, value, expected):
    assert found(filters.apply_filters(table, [QueryFilter(field, operator, value)])) == expected


def test_nested_dictionary_round_trip(table):
    asked = [QueryFilter("language", "=", "C"), QueryFilter("complexity_score", ">", 4), QueryFilter("functions", "IS NULL")]
    for logic, expected in (("OR", ["a/test file.py", "b.rs", "d.c"]), ("AND", [])):
        tree = filters.to_filter_dict(asked, logic)
        assert found(table.filter(filters.from_filter_dict(table, tree))) == expected


def test_field_names():
    assert resolve_field("path") == "filename"
    assert resolve_field("embedding_model") == "embedding_model"
    with pytest.raises(ValueError, match="Valid fields: "):
        resolve_field("drop table")
    with pytest.raises(ValueError):
        filters.to_filter_dict([QueryFilter("code", "LIKE", "x")])


def test_unsupported(table):
    for bad in (QueryFilter("language", "~", "x"), QueryFilter("language", "IN", "x"), QueryFilter("complexity_score", "=", "x")):
        with pytest.raises(ValueError):
            filters.condition(table, bad)


@pytest.mark.parametrize("name", ["filter_array_contains", "filter_array_constant"])
def test_conditions_on_made_texts_stay_above_the_dealing_out(spark, name):
    plan = entry_point.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("REPARTITION_BY_NUM")
    assert "regexp_extract_all" in above and "regexp_extract_all" not in below
