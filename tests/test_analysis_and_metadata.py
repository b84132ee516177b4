import hashlib
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from codelode.functions import python_syntax, symbols
from codelode import catalog
from codelode.functions import metadata, text
from codelode.operators.analysis import analyze, universal_analysis

PYTHON = '''"""Top."""
import os
from a.b import c
from . import d

LIMIT = 1

@deco.mark(1)
class Box(Base, metaclass=M):
    """A box."""
    kind = 2

    async def fetch(self, n: int = 3) -> str:
        if n:
            return [x for x in n]

    def __init__(self):
        pass

    def _hidden(self):
        def inner(): pass

@cache
def free(y, *, z=1):
    """Free."""
    try:
        pass
    except ValueError:
        pass
    for i in y:
        pass
'''
JAVA = """package a.b;
public class M extends N {
  /* class Fake { void no() { } } */
  String s = "class Text // { not";
  public M(int a) {
  }
  @Override
  public static <T> List<T> foo(int x) throws E {
    if (x > 1) { return bar(x); }
    while (x < 3) { x++; }
    return null;
  }
}
interface Shape {
  double area();
}
enum Kind { A }
@interface Mark { }
"""
RUST = """pub struct P<T> { a: T }
impl<T> P<T> {
    pub async fn new(a: T) -> Self { P { a } }
}
pub trait T1 { fn go(&self); }
impl T1 for P<i32> {
    fn go(&self) {}
}
enum E { A }
mod inner { }
fn main() { match x { 1 => 2, _ => 3 } }
"""
KOTLIN = """data class Person(val n: String)
sealed class Result
class Calculator {
    suspend fun add(a: Int): Int { if (a > 1) return 1 else return 2 }
    private fun <T> id(x: T): T = x
}
interface I
object O
enum class C { A }
fun String.shout() = uppercase()
fun main() {}
"""
HASKELL = """{-# LANGUAGE X #-}
module Main (main) where
import qualified Data.Map as M
import Data.List (sort)
data Tree a = Leaf | Node a
newtype Age = Age Int
type Name = String
class Show a => Shape a where
  area :: a -> Int
instance Shape Tree where
  area _ = 1
fibonacci, other :: Int -> Int
fibonacci 0 = 1
fibonacci n
  | n > 1 = n
{- ghost :: Int
ghost = 1 -}
compose f g = f . g
main :: IO ()
main = do
  let x = 1
  print x
"""
CPP = """namespace geo {
template <typename T> class Box { };
enum class Color { RED };
class Shape : public Base {
public:
  virtual double area() const { return 1; }
};
int Shape::size(int a) {
  for (;;) { }
}
struct Point { int x; };
typedef unsigned int uint;
}
"""
TYPESCRIPT = """import { a } from "./a";
import "./side";
export interface User { id: number }
export type Id<T> = string;
const enum Mode { A }
declare module Shop.Types {
}
@Component({x: 1})
export abstract class Person {
  constructor(private x: number) {
  }
  async greet(n: string): Promise<void> {
    if (n) {
    }
  }
  get age(): number {
    return 1;
  }
}
export const f = async (a: number): Promise<number> => { return a; };
const plain = function () { };
let not = call(1);
export default function fib(n: number): number { return n; }
"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [
        ("py", "Python", PYTHON), ("bad", "Python", "import os\nclass A:\n  def f(:\n"), ("java", "Java", JAVA),
        ("rs", "Rust", RUST), ("kt", "Kotlin", KOTLIN), ("hs", "Haskell", HASKELL), ("cpp", "C++", CPP),
        ("ts", "TypeScript", TYPESCRIPT), ("js", "JavaScript", "class A {\n m() {\n }\n"), ("md", "Markdown", "# x"),
        ("big", "Python", "x = 1\n" * 20_000),
    ]
    df = spark.createDataFrame(rows, "id string, language string, code string")
    return {r.id: r.asDict(True) for r in analyze(df).collect()}


def test_python(found):
    r = found["py"]
    assert r["functions"] == ["free"]
    assert r["classes"] == ["Box"]
    assert r["imports"] == ["a.b", "os"]
    assert r["variables"] == ["LIMIT"]
    assert r["decorators_used"] == ["cache", "deco.mark"]
    assert r["private_methods"] == ["__init__", "_hidden"] and r["dunder_methods"] == ["__init__"]
    assert r["has_async"] and r["has_type_hints"] and r["has_classes"] and r["docstring"] == "Top."
    assert r["analysis_method"] == "python_code_analyzer" and r["parse_errors"] == 0
    detail = json.loads(r["function_details"])[0]
    assert (detail["name"], detail["decorators"], detail["docstring"]) == ("free", ["cache"], "Free.")
    box = json.loads(r["class_details"])[0]
    assert box["bases"] == ["Base"] and box["methods"] == ["fetch", "__init__", "_hidden", "inner"]
    # 5 functions, 1 class, 1 decorated function, words: if, for x2, try:, except
    assert r["complexity_score"] == 5 * 2 + 3 + 1 + 1 + 2 + 1 + 1
    stored = json.loads(r["metadata_json"])
    assert stored["functions"] == ["free"] and stored["node_counts"]["list_comprehension"] == 1


def test_python_that_does_not_parse(found):
    r = found["bad"]
    assert (r["functions"], r["classes"], r["imports"]) == (["f"], ["A"], ["os"])
    assert r["analysis_method"] == "python_regex_fallback" and r["parse_errors"] == 1
    assert r["nodes_with_errors"] == ["1"] and r["tree_sitter_analyze_error"]
    assert found["big"]["analysis_method"] == "python_code_analyzer" and found["big"]["parse_errors"] == 0  # length is no error


@pytest.mark.parametrize(
    "key, expected",
    [
        ("java", {"functions": ["foo", "area", "M"], "classes": ["M"], "enums": ["Kind"], "has_type_hints": True,
                  "has_classes": True}),
        ("rs", {"functions": ["new", "go", "main"], "structs": ["P"], "traits": ["T1"], "impls": ["P"], "enums": ["E"],
                "modules": ["inner"], "has_async": True, "has_module": True}),
        ("kt", {"functions": ["add", "id", "shout", "main"], "classes": ["Person", "Result", "Calculator"],
                "enums": ["C"], "has_async": True}),
        ("hs", {"functions": ["fibonacci", "main", "compose"], "data_types": ["Tree", "Age"], "types": ["Name"],
                "type_classes": ["Shape"], "classes": ["Shape"], "instances": ["Shape Tree"], "modules": ["Main"],
                "imports": ["Data.Map", "Data.List"], "complexity_score": 9, "has_type_hints": False}),
        ("cpp", {"functions": ["area", "size"], "classes": ["Box", "Shape"], "namespaces": ["geo"], "structs": ["Point"],
                 "enums": ["Color"], "has_classes": True}),
        ("ts", {"functions": ["fib", "f", "plain", "greet", "age"], "classes": ["Person"], "imports": ["./a", "./side"],
                "types": ["Id"], "enums": ["Mode"], "namespaces": ["Shop.Types"], "decorators_used": ["Component"],
                "exports": ["User", "Id", "Person", "f", "fib"]}),
        ("js", {"functions": ["m"], "classes": ["A"], "parse_errors": 1, "has_type_hints": False}),
        ("md", {"functions": [], "analysis_method": "default_basic", "complexity_score": 0, "char_count": 3}),
    ],
)
def test_language(found, key, expected):
    got = {k: found[key][k] for k in expected}
    assert got == expected


def test_metadata_keeps_names_without_column(found):
    assert json.loads(found["java"]["metadata_json"])["interfaces"] == ["Shape"]
    assert json.loads(found["java"]["metadata_json"])["annotations"] == ["Mark"]
    assert json.loads(found["kt"]["metadata_json"])["data_classes"] == ["Person"]


def test_default_handler(spark):
    df = spark.createDataFrame([("Python", "def f(): pass")], "language string, code string")
    r = analyze(df, basic=True).first()
    assert r.functions == [] and r.analysis_method == "default_basic" and r.char_count == 13
    assert json.loads(df.select(metadata.default_metadata()).first()[0])["analysis_method"] == "default_basic"


def test_universal(spark):
    df = spark.createDataFrame([("#include <a.h>\nuse x::y;\nfn go() { if a { while b {} } }\nstruct S;",)], "code string")
    r = universal_analysis(df).first()
    assert (r.functions, r.classes, r.imports, r.complexity_score) == (["go"], ["S"], ["a.h", "x::y"], 2)


J = [
    ('{"x": "a", "l": ["p", "q"], "b": true, "n": 4, "d": {"k": 1}}', "a", True, ["a"], 0),
    ('{"x": null}', "None", False, [], 0),
    ('{"x": true}', "True", True, ["true"], 0),
    ('{"x": "false"}', "false", True, ["false"], 0),
    ('{"x": 0}', "0", False, ["0"], 0),
    ('{"x": 12}', "12", True, ["12"], 12),
    ('{"x": "12"}', "12", True, ["12"], 12),
    ('{"x": "1.5"}', "1.5", True, ["1.5"], 0),
    ('{"x": -7.9}', "-7.9", True, ["-7.9"], -7),
    ('{"x": []}', "[]", False, [], 0),
    ('{"x": ["a", "b"]}', '["a","b"]', True, ["a", "b"], 0),
    ('{"x": {}}', "{}", False, ["{}"], 0),
    ("{}", "dflt", False, [], 0),
    ("[1]", "dflt", False, [], 0),
    ("nope", "dflt", False, [], 0),
    ("", "dflt", False, [], 0),
    (None, "dflt", False, [], 0),
]


def test_json_readers(spark):
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(J)], "i int, j string").withColumn("v", metadata.parsed("j"))
    rows = df.select(
        "i", F.coalesce(metadata.string_field("v", "x", "dflt"), F.lit("dflt")), metadata.bool_field("v", "x"),
        metadata.list_field("v", "x"), metadata.int_field("v", "x"),
    ).orderBy("i").collect()
    assert [tuple(r)[1:] for r in rows] == [r[1:] for r in J]


def test_promote_and_defaults(spark):
    df = spark.createDataFrame([('{"functions": "one", "success": false, "nodes_with_errors": 2, "class_details": [{"a": 1}]}',), ("",)], "metadata_json string")
    first, second = metadata.promote(df).collect()
    assert first.functions == ["one"] and first.success is False and first.nodes_with_errors == ["2"]
    assert json.loads(first.class_details) == [{"a": 1}]
    assert second.success is True and second.analysis_method == "unknown" and second.class_details == "[]"
    assert {n for n, _ in catalog.CHUNK_COLUMNS} - metadata.NOT_IN_METADATA <= set(metadata.promote(df).columns)


def test_validation(spark):
    good = spark.createDataFrame([("a", "C", "1", "12", None)], "filename string, language string, location string, start string, functions array<string>")
    r = metadata.validate_records(good).first()
    assert r.start == 12 and r.functions == [] and r.source_name == "default" and r.success is True and r.metadata_json == "{}"
    with pytest.raises(ValueError, match="location"):
        metadata.validate_records(good.drop("location"))
    with pytest.raises(Exception, match="missing required field: filename"):
        metadata.validate_records(good.withColumn("filename", F.lit(""))).collect()
    with pytest.raises(ValueError, match="must be a list"):
        metadata.validate_records(good.withColumn("classes", F.lit("x")))


def test_text_functions(spark):
    code = "if a:\n\n# x\n\tfor b\nwhile \\x -> y | z"
    df = spark.createDataFrame([(code,)], "c string")
    r = df.select(
        text.line_count("c"), text.solid_size("c"), text.content_hash("c"), text.haskell_complexity("c"),
        text.count_literals("c", ["if ", "for "]),
    ).first()
    assert tuple(r) == (
        5, len(code.replace(" ", "").replace("\n", "").replace("\t", "")),
        hashlib.sha256(code.encode()).hexdigest()[:16], 1 + 1 + 1 + 1, 2,
    )
    quoted = spark.createDataFrame([('"""\nA "b"\n"""',), ("'x'",), (" y ",)], "d string")
    assert [x[0] for x in quoted.select(text.clean_docstring(F.col("d"))).collect()] == ['A "b"', "x", "y"]


def test_haskell_details(spark):
    code = (
        "module A.B (f, T(..)) where\nimport qualified Data.Map as M\nimport Data.List (sort, nub)\nimport Prelude hiding (map)\n"
        "data T a = L Int\n  | N a\n  deriving (Eq, Show)\nnewtype W = W Int\ntype S = String\nf, g :: Int -> a\nh x = 1\n"
    )
    r = spark.createDataFrame([(code,)], "c string").select(*[c.alias(n) for n, c in text.haskell_details("c").items()]).first()
    assert [tuple(i) for i in r.import_details] == [
        ("Data.Map", True, "M", [], []), ("Data.List", False, None, ["sort", "nub"], []), ("Prelude", False, None, [], ["map"]),
    ]
    assert [tuple(d) for d in r.data_type_details] == [
        ("data", "T", ["a"], ["L", "N"], ["Eq", "Show"]), ("newtype", "W", [], ["W"], []), ("type", "S", [], ["String"], []),
    ]
    assert [tuple(x) for x in r.signature_details] == [(["f", "g"], "Int -> a")]
    assert r.module_details[0].name == "A.B" and r.module_details[0].exports[0] == "f"


def test_damaged_haskell_is_cut_by_lines(spark):
    from codelode.plans.index_flow import index_files

    text_of = {"ok.hs": "f :: Int\nf = 1\n", "bad.hs": "f :: ((((((((((((Int\nf = 1\ng = 2\n"}
    files = spark.createDataFrame([(k, v, "s") for k, v in text_of.items()], "filename string, content string, source_name string")
    got = {(r.filename, r.chunking_method, r.tree_sitter_chunking_error) for r in index_files(files, with_vectors=False).collect()}
    assert got == {("ok.hs", "haskell_specialized_chunker", False), ("bad.hs", "rust_haskell_regex_fallback_python", True)}


def test_patterns_survive_large_text(spark):
    """Long comments and literals: no stack overflow, no endless matching."""
    big = 1_000_000
    rows = [
        ("Java", "/*" + "* a" * big + "*/ class A { }\n"), ("C", 'char *s = "' + "\\\\n" * big + '";\nint f(int a) {\n}\n'),
        ("Haskell", "{-" + "- x" * big + "-}\nf :: Int\n"), ("Rust", "fn " + "a" * big + "() {}\n"),
        ("TypeScript", "const x = " + "(a, " * 200_000 + ";\n"), ("Kotlin", "fun f() {}\n" + "private " * 2000 + "\n"),
    ]
    df = spark.createDataFrame(rows, "language string, code string")
    got = {r.language: r for r in analyze(df).select("language", "functions", "classes").collect()}
    assert got["Java"].classes == ["A"] and got["C"].functions == ["f"] and got["Haskell"].functions == ["f"]


def test_literals_and_comments_are_no_code(spark):
    rows = [("C", 'int main() { puts("("); return 0; }\n'), ("JavaScript", 'function f() { return "async"; }\n'), ("Haskell", "f :: Int\nf = 1\n" + "-- fine :)\n" * 12)]
    for r in analyze(spark.createDataFrame(rows, "language string, code string")).collect():
        assert (r.parse_errors, r.tree_sitter_analyze_error, r.has_async) == (0, False, False)


def test_python_text_is_parsed_once_and_after_the_rows_are_dealt_out(spark):
    plan = entry_point.queries()["python_details"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    dealt_out = plan.index("REPARTITION_BY_NUM")
    assert plan.count("ArrowEvalPython [") == 1 and plan.index("ArrowEvalPython [") < dealt_out


def test_nodes_as_arrow_columns():
    texts = [None, "def f(:", "", "class A(B):\n    def g(self, a: int, b=-1, c=None, *d, e=2): return lambda: [x for x in a]\n"] * 50
    found = python_syntax._array([python_syntax._nodes(t) for t in texts]).to_pylist()
    assert [r is None for r in found[:4]] == [True, True, False, False] and found[:4] == found[-4:]
    assert [n["kind"] for n in found[3]] == ["module", "class_definition", "function_definition", "lambda", "list_comprehension"]
    assert found[3][2]["parameters"] == [
        {"name": "self", "type_annotation": None, "default": None}, {"name": "a", "type_annotation": "int", "default": None},
        {"name": "b", "type_annotation": None, "default": "-1"}, {"name": "c", "type_annotation": None, "default": "None"},
    ]


def test_a_text_is_searched_only_for_what_it_may_hold(spark):
    for table in symbols.PATTERNS.values():
        for field, patterns in table.items():
            assert field not in symbols.NEEDED or all(any(w in p for w in symbols.NEEDED[field]) for p in patterns)
    # one search for the words of all node kinds, and one for the kind that no word tells
    counts = symbols.node_counts("code", "language", {field: field for names in symbols.DECLARED_NODES.values() for field in names})
    assert counts.count("regexp_") == len(symbols.NODE_WORDS) + 1
    code = "if (iffy) { x => y -> z }\nfor (;;) try\n  finally\n\n   class\n A {\nenum B { C }\n"
    rows = spark.createDataFrame([("Java", code), ("Rust", "for a in b if c { match d { 1 => 2 } }"), ("C", "no")], "language string, code string")
    got = {r.language: r for r in analyze(rows, node_counts=True).select("language", "classes", "enums", "node_counts").collect()}
    assert got["Java"].node_counts == {"if_statement": 1, "for_statement": 1, "try_statement": 1, "finally_clause": 1, "lambda_expression": 1, "class_declaration": 1}
    assert got["Rust"].node_counts == {"if_expression": 1, "for_expression": 1, "match_expression": 1, "match_arm": 1}
    assert got["Java"].classes == ["A"] and got["Java"].enums == ["B"] and got["C"].node_counts == {}


def test_solid_size_counts_blanks_instead_of_leaving_them_out(spark):
    texts = ["", " \n\t", "a b\tc\n", "é ß\n中 🙂\t", "x" * 5000 + " "]
    rows = spark.createDataFrame([(t,) for t in texts], "code string").select("code", text.solid_size("code").alias("n"))
    assert "translate(" not in rows._jdf.queryExecution().executedPlan().toString()
    assert {r.code: r.n for r in rows.collect()} == {t: len(t) - sum(map(t.count, " \n\t")) for t in texts}
