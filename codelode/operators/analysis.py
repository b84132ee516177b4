"""Chunk text to metadata columns: the analyzer of each language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import symbols, text
from codelode.functions.python_syntax import findings_sql, python_nodes
from codelode.functions.sqltext import EMPTY_LIST, case, columns, constant_map, literal, name, one_of

# --- Fixed values: name of the analyzer that ran -----------------------------
METHODS = {
    "C": "c_ast_visitor", "C++": "cpp_ast_visitor", "Java": "java_ast_visitor",
    "JavaScript": "javascript_ast_visitor", "TypeScript": "typescript_ast_visitor",
    "TSX": "typescript_ast_visitor", "Kotlin": "kotlin_ast_visitor",
    "Rust": "rust_ast_visitor", "Haskell": "haskell_chunk_visitor",
}
PYTHON_METHOD, PYTHON_REGEX = "python_code_analyzer", "python_regex_fallback"
DEFAULT_METHOD = "default_basic"
TYPED_LANGUAGES = ["Java", "TypeScript", "TSX", "Kotlin", "Rust"]
ASYNC_WORDS = {"JavaScript": "async", "TypeScript": "async", "TSX": "async", "Rust": "async", "Kotlin": "suspend"}

_EMPTY_LISTS = [
    "functions", "classes", "imports", "decorators_used", "dunder_methods", "nodes_with_errors",
    "data_types", "instances", "type_classes", "enums", "namespaces", "modules", "structs",
    "traits", "impls", "exports", "types", "private_methods", "variables", "decorators",
]
# Found names that have no column of their own stay in the JSON text.
JSON_ONLY = ["interfaces", "packages", "annotations", "typedefs", "templates", "data_classes", "objects"]


def weighted_complexity(counts: str) -> str:
    """SQL for the sum of node counts times the weight of their kind."""
    weight = f"coalesce(try_element_at({constant_map(catalog.NODE_WEIGHTS)}, e.key), 0)"
    return f"aggregate(map_entries({counts}), cast(0 AS bigint), (total, e) -> total + cast(e.value AS bigint) * {weight})"


def analyze(df: DataFrame, code: str = "code", language: str = "language", basic: bool = False, node_counts: bool = False) -> DataFrame:
    """Add the metadata columns and ``metadata_json`` for the text in ``code``.

    With ``basic`` every language gets the constant default analyzer; with
    ``node_counts`` that map stays as a column too.
    Only Python text reaches a Python worker; other rows pass NULL there.
    """
    lang, source = name(language), name(code)
    constants = {"success": "true", "char_count": f"cast(length({source}) AS bigint)"}
    if basic:
        parts = {n: EMPTY_LIST for n in [*_EMPTY_LISTS, *JSON_ONLY]} | constants | {
            "complexity_score": "0L", "parse_errors": "0L", "has_type_hints": "false", "has_async": "false",
            "has_classes": "false", "has_module": "false", "tree_sitter_analyze_error": "false",
            "docstring": "''", "function_details": "'[]'", "class_details": "'[]'", "data_type_details": "'[]'",
            "analysis_method": literal(DEFAULT_METHOD), "node_counts": "cast(map() AS map<string,bigint>)",
        }
        return with_json(df.withColumns(columns(parts)), node_counts)

    python, known = f"{lang} = 'Python'", one_of(lang, METHODS)
    parsed, broken = f"{python} AND _nodes IS NOT NULL", f"{python} AND _nodes IS NULL"
    fallback = text.python_fallback_sql(source)
    listed = df.withColumn("_nodes", python_nodes(F.expr(f"CASE WHEN {python} THEN {source} END")))
    told = findings_sql("_nodes")
    staged = listed.withColumns(columns({f"_py_{n}": sql for n, sql in told.items()}))
    staged = staged.withColumn("_bare", F.expr(case([(known, symbols.without_comments(source, lang))], "NULL")))
    staged = staged.withColumn("_strict", F.expr(case([(known, symbols.without_literals(source, lang))], "NULL")))
    found = symbols.declared_names("_bare", lang)
    staged = staged.withColumns(columns({f"_{n}": sql for n, sql in found.items()}))

    def choose(field: str, from_python: bool = False) -> str:
        branches = [(parsed, f"_py_{field}" if from_python else EMPTY_LIST)]
        branches.append((broken, fallback[field] if field in fallback else EMPTY_LIST))
        return case(branches, f"_{field}" if field in found else EMPTY_LIST)

    in_python = {"functions", "classes", "imports", "variables", "private_methods", "dunder_methods", "decorators"}
    lists = {n: choose(n, n in in_python) for n in [*_EMPTY_LISTS, *JSON_ONLY]}
    lists["decorators_used"] = case(
        [(parsed, "_py_decorators"), (f"{lang} = 'Java'", "_annotations"), (one_of(lang, ["TypeScript", "TSX"]), "_decorators")],
        EMPTY_LIST,
    )
    lists["_errors"] = case([(broken, "1L"), (known, symbols.bracket_errors("_strict"))], "0L")
    lists["nodes_with_errors"] = EMPTY_LIST
    counts = case(
        [(parsed, "cast(_py_node_counts AS map<string,bigint>)")],
        symbols.node_counts("_bare", lang, {n: f"_{n}" for n in found}),
    )
    staged = staged.withColumns(columns(lists | {"node_counts": counts}))
    counted = (
        "cast(_py_function_count * 2 + size(_py_classes) * 3 + _py_decorated_count"
        f" + {text.count_sql(source, text.PYTHON_BRANCH_WORDS)} AS bigint)"
    )
    weighted = weighted_complexity("node_counts")
    has_async = [(f"{lang} = {literal(n)}", f"_strict RLIKE {literal(rf'{chr(92)}b{w}{chr(92)}b')}") for n, w in ASYNC_WORDS.items()]
    staged = staged.withColumns(columns(constants | {
        "complexity_score": case(
            [
                (parsed, f"greatest({counted}, {weighted})"), (broken, fallback["complexity_score"]),
                (f"{lang} = 'Haskell'", "cast(size(functions) * 2 + size(classes) * 3 AS bigint)"), (known, weighted),
            ],
            "0L",
        ),
        "has_type_hints": case(
            [(parsed, "_py_has_type_hints"), (broken, fallback["has_type_hints"])], one_of(lang, TYPED_LANGUAGES)
        ),
        "has_async": case([(parsed, "_py_has_async"), (broken, fallback["has_async"]), *has_async], "false"),
        "has_classes": case(
            [
                (f"{lang} = 'Java'", "size(classes) > 0 OR size(interfaces) > 0"),
                (f"{lang} = 'Rust'", "size(structs) > 0 OR size(traits) > 0"),
            ],
            "size(classes) > 0",
        ),
        "has_module": "size(modules) > 0",
        "parse_errors": "_errors",
        "nodes_with_errors": case([("_errors > 0", "array(cast(_errors AS string))")], EMPTY_LIST),
        "tree_sitter_analyze_error": "_errors > 0",
        "docstring": "coalesce(_py_docstring, '')",
        "function_details": "coalesce(_py_function_details, '[]')",
        "class_details": "coalesce(_py_class_details, '[]')",
        "analysis_method": case(
            [(parsed, literal(PYTHON_METHOD)), (broken, literal(PYTHON_REGEX))],
            f"coalesce(try_element_at({constant_map(METHODS)}, {lang}), {literal(DEFAULT_METHOD)})",
        ),
    }))
    staged = staged.withColumns({"_h": F.when(F.col(language) == "Haskell", F.col("_bare"))})
    staged = staged.withColumn("_d", text.haskell_details("_h")["data_type_details"])
    staged = staged.withColumn("data_type_details", F.expr(case([("size(_d) > 0", "to_json(_d)")], "'[]'"))).drop("_h", "_d")
    return with_json(staged.drop("_nodes", *[f"_py_{n}" for n in told], "_bare", "_strict", "_errors", *[f"_{n}" for n in found]), node_counts)


def with_json(df: DataFrame, node_counts: bool = False) -> DataFrame:
    """Add ``metadata_json`` and drop the columns that live only in it."""
    parts = [
        *_EMPTY_LISTS, *JSON_ONLY, "complexity_score", "has_type_hints", "has_async", "has_classes",
        "has_module", "success", "parse_errors", "char_count", "docstring", "analysis_method",
        "tree_sitter_analyze_error", "node_counts",
    ]
    parts += [c for c in ("chunking_method",) if c in df.columns]
    return df.withColumn("metadata_json", F.to_json(F.struct(*parts))).drop(*JSON_ONLY, *([] if node_counts else ["node_counts"]))


def universal_analysis(df: DataFrame, code: str = "code") -> DataFrame:
    """Language-independent findings by regular expression."""
    return df.withColumns({**text.universal_names(code), "complexity_score": text.universal_complexity(code)})


def roll_up(chunks: Column) -> dict[str, Column]:
    """A file's chunk findings as one: the chunks are an array of structs with
    ``functions``, ``modules`` and ``classes`` in the file's own row."""

    def union(field: str) -> Column:
        return F.array_distinct(F.flatten(F.transform(chunks, lambda c: c[field])))

    functions, classes = F.array_sort(union("functions")), union("classes")
    return {
        "functions": functions,
        "modules": F.array_sort(union("modules")),
        "classes": classes,
        "complexity_score": (F.size(functions) * 2 + F.size(classes) * 3).cast("bigint"),
    }


def precision_recall(found: Column, expected: Column) -> dict[str, Column]:
    """Sizes needed for precision, recall and F1 of one row."""
    return {
        "n_found": F.size(F.array_distinct(found)).cast("bigint"),
        "n_expected": F.size(F.array_distinct(expected)).cast("bigint"),
        "n_both": F.size(F.array_intersect(found, expected)).cast("bigint"),
    }
