"""Records merged by name, signatures found for functions."""

import json

from pyspark.sql import functions as F

from codelode.operators import records

FIELDS = {"line": "int", "docstring": "string", "bases": "array<string>", "decorators": "array<string>"}
KIND = "array<struct<name:string,line:int,docstring:string,bases:array<string>,decorators:array<string>>>"


def test_merge_by_name(spark):
    left = [("A", 1, "", ["X"], ["l"]), ("B", None, None, None, []), ("A", 9, "again", [], []), (None, 1, "", [], [])]
    right = [("C", 7, "c", [], []), ("A", 5, "doc", ["Y"], ["r"]), ("B", 2, "b", ["Z"], None)]
    rows = spark.createDataFrame([(left, right), (None, right[:1]), (left[:1], None), (None, None), ([], [])], f"l {KIND}, r {KIND}")
    got = [[tuple(x) for x in r.m] for r in rows.select(F.expr(records.merge_by_name("l", "r", FIELDS)).alias("m")).collect()]
    assert got == [
        [("A", 1, "doc", ["X"], ["r"]), ("B", 2, "b", ["Z"], []), ("C", 7, "c", [], [])],
        [("C", 7, "c", [], [])], [("A", 1, "", ["X"], ["l"])], [], [],
    ]


def test_signatures(spark):
    text = """module A where
f, g :: Ord a => a -> (a -> b)
     -> [a -> b] -> b
data T = T
f x = 1
f y = 2
h :: Int
g x y = 3
f :: Int -> Int
f z = 4
k = 5
"""
    rows = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", "f 1 = 2")], "filename string, content string")
    got = sorted(tuple(r) for r in records.signed_functions(rows).select("filename", "name", "ordinal", "clauses", "signature", "arity").collect())
    shape = "Ord a => a -> (a -> b) -> [a -> b] -> b"
    assert got == [("a", "f", 3, 3, shape, 3), ("a", "g", 6, 1, shape, 3), ("a", "k", 9, 1, None, None), ("d", "f", 0, 1, None, None)]


def test_details_of_two_analyzers(spark):
    one = '[{"name":"A","bases":[],"methods":["m"],"docstring":""},{"name":"B","line":3}]'
    two = '[{"name":"A","bases":["X"],"decorators":["d"],"docstring":"says"},{"name":"C","line":9}]'
    rows = spark.createDataFrame([(one, two), ("no json", two), (None, None)], "a string, b string")
    got = [json.loads(r.m) for r in records.merged_details(rows, "a", "b", "m").collect()]
    assert [[(c["name"], c["line"], c["bases"], c["decorators"], c["methods"], c["docstring"]) for c in g] for g in got] == [
        [("A", None, ["X"], ["d"], ["m"], "says"), ("B", 3, None, None, None, None), ("C", 9, None, None, None, None)],
        [("A", None, ["X"], ["d"], None, "says"), ("C", 9, None, None, None, None)], [],
    ]
