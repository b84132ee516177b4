"""Analyzers over program text; the SQL states what each file declares."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import metadata, text
from codelode.functions.let import unnest
from codelode.operators.analysis import analyze, precision_recall, roll_up
from codelode.operators import records
from codelode.operators.chunking import fixed_lines
from workloads.registry import query
from workloads.views import DAMAGED_FROM, SOURCES_SQL, source_files, table

_BAD = f"(language = 'Python' AND n >= {DAMAGED_FROM})"
# What the texts in views.SOURCE_TEXT declare, by construction: n functions
# compute_<id>_<i> and the fixed parts around them.
TRUTH_SQL = f"""
  SELECT *, CASE
      WHEN {_BAD} THEN list_concat(fns, ['label', 'main_' || id, 'broken_' || id])
      WHEN language IN ('Python', 'Haskell', 'C', 'Kotlin') THEN list_concat(fns, ['main_' || id])
      WHEN language = 'C++' THEN list_concat(fns, ['label'])
      WHEN language = 'Rust' THEN list_concat(fns, ['area', 'main_' || id])
      WHEN language = 'Java' THEN list_concat(fns, ['Part' || id])
      ELSE list_concat(fns, ['label', 'main_' || id]) END AS functions,
    CASE language WHEN 'Haskell' THEN 'Shape' || id WHEN 'C' THEN '' WHEN 'Rust' THEN ''
      ELSE 'Part' || id END AS classes,
    CASE WHEN {_BAD} THEN 3 * n + 4 ELSE CASE language
      WHEN 'Python' THEN 4 * n + 7 WHEN 'Haskell' THEN 2 * n + 5 WHEN 'C' THEN 4 * n + 2
      WHEN 'C++' THEN 3 * n + 2 WHEN 'Rust' THEN 6 * n + 11 WHEN 'Kotlin' THEN 3 * n + 5
      WHEN 'Java' THEN 4 * n + 5 WHEN 'TypeScript' THEN 3 * n + 10 ELSE 4 * n + 8 END END AS complexity_score
  FROM (SELECT filename, language, content, p_partkey AS id, p_size::BIGINT AS n,
               list_transform(range(1, p_size + 1), lambda i: 'compute_' || p_partkey || '_' || i) AS fns
        FROM ({SOURCES_SQL}))"""


def _analyzed(spark, sf_dir):
    return analyze(source_files(spark, sf_dir), "content")


@query(
    "analyze_code",
    f"""SELECT filename, language, array_to_string(list_sort(functions), ' ') AS functions, classes, complexity_score,
          CASE WHEN {_BAD} THEN 'python_regex_fallback' WHEN language = 'Python' THEN 'python_code_analyzer'
               WHEN language = 'Haskell' THEN 'haskell_chunk_visitor' WHEN language = 'C++' THEN 'cpp_ast_visitor'
               ELSE lower(language) || '_ast_visitor' END AS analysis_method,
          language IN ('Python', 'Rust', 'Kotlin', 'TypeScript') AS has_async,
          language IN ('Python', 'Rust', 'Kotlin', 'TypeScript', 'Java') AS has_type_hints,
          language <> 'C' AS has_classes, CASE WHEN {_BAD} THEN 1 ELSE 0 END::BIGINT AS parse_errors,
          length(content)::BIGINT AS char_count
        FROM ({TRUTH_SQL})""",
)
def analyze_code(spark, sf_dir):
    """Declared names, flags and complexity of every source file."""
    return _analyzed(spark, sf_dir).select(
        "filename", "language",
        metadata.joined(F.array_sort("functions")).alias("functions"),
        metadata.joined(F.col("classes")).alias("classes"),
        "complexity_score", "analysis_method", "has_async", "has_type_hints", "has_classes",
        "parse_errors", "char_count",
    )


_OTHER_NAMES = {
    "imports": """CASE WHEN language = 'Python' THEN 'os shop.catalog' WHEN language = 'Haskell' THEN 'Data.Map Shop.Catalog'
       WHEN language = 'TypeScript' THEN './item' WHEN language = 'JavaScript' THEN './item.js' ELSE '' END""",
    "structs": "CASE WHEN language IN ('C', 'Rust') THEN 'Part' || id ELSE '' END",
    "enums": "CASE WHEN language = 'C' THEN 'Kind' || id ELSE '' END",
    "traits": "CASE WHEN language = 'Rust' THEN 'Shape' || id ELSE '' END",
    "impls": "CASE WHEN language = 'Rust' THEN 'Part' || id ELSE '' END",
    "namespaces": "CASE WHEN language = 'C++' THEN 'shop_' || id ELSE '' END",
    "modules": "CASE WHEN language = 'Haskell' THEN 'Part' || id ELSE '' END",
    "data_types": "CASE WHEN language = 'Haskell' THEN 'Kind' || id ELSE '' END",
    "type_classes": "CASE WHEN language = 'Haskell' THEN 'Shape' || id ELSE '' END",
    "types": "CASE WHEN language = 'TypeScript' THEN 'Id' || id ELSE '' END",
    "exports": """CASE WHEN language = 'TypeScript' THEN array_to_string(list_concat(['Shape' || id, 'Part' || id], fns), ' ')
       WHEN language = 'JavaScript' THEN 'main_' || id ELSE '' END""",
    "decorators_used": f"CASE WHEN language = 'Python' AND NOT {_BAD} THEN 'register' ELSE '' END",
    "variables": f"CASE WHEN language = 'Python' AND NOT {_BAD} THEN 'LIMIT' ELSE '' END",
}


@query(
    "analyze_names",
    "SELECT filename, " + ", ".join(f"{sql} AS {n}" for n, sql in _OTHER_NAMES.items()) + f" FROM ({TRUTH_SQL})",
)
def analyze_names(spark, sf_dir):
    """The other declared names, one column per kind."""
    return _analyzed(spark, sf_dir).select(
        "filename", *[metadata.joined(F.col(n)).alias(n) for n in _OTHER_NAMES]
    )


@query(
    "python_details",
    f"""SELECT filename, (n + 1)::BIGINT AS detailed, 'compute_' || id || '_1' AS first_name, '1' AS rate_default,
               'async_function' AS last_type, 'Part' || id AS class_name, 'Item' AS base, name AS docstring
        FROM (SELECT t.*, p.p_name AS name FROM ({TRUTH_SQL}) t JOIN part p ON p.p_partkey = t.id)
        WHERE language = 'Python' AND NOT {_BAD}""",
)
def python_details(spark, sf_dir):
    """Function and class details of Python files that parse."""
    rows = analyze(source_files(spark, sf_dir).filter(F.col("language") == "Python"), "content")
    functions = F.from_json(
        "function_details",
        "array<struct<name:string,type:string,parameters:array<struct<name:string,default:string>>>>",
    )
    classes = F.from_json("class_details", "array<struct<name:string,bases:array<string>,docstring:string>>")
    # A plain filter would go below the dealing out of the rows and parse every text there, in one task, and then again.
    parsed = F.when(F.col("analysis_method") == "python_code_analyzer", F.array(F.struct(functions.alias("f"), classes.alias("c"))))
    read = unnest(rows, ["filename"], parsed)
    return read.select(
        "filename",
        F.size("f").cast("bigint").alias("detailed"),
        F.col("f")[0]["name"].alias("first_name"),
        F.col("f")[0]["parameters"][1]["default"].alias("rate_default"),
        F.element_at("f", -1)["type"].alias("last_type"),
        F.col("c")[0]["name"].alias("class_name"),
        F.col("c")[0]["bases"][0].alias("base"),
        F.col("c")[0]["docstring"].alias("docstring"),
    )


_NODES = [
    # language, node kind, occurrences in a file with n functions
    ("Python", "if_statement", "n"), ("Python", "for_statement", "n"),
    ("Python", "function_definition", "n + 1"), ("Python", "async_function_definition", "1"),
    ("Python", "class_definition", "1"),
    ("C", "if_statement", "n"), ("C", "for_statement", "n"), ("C", "function_definition", "n + 1"),
    ("C++", "while_statement", "n"), ("C++", "function_definition", "n + 1"),
    ("Java", "if_statement", "2 * n"), ("Java", "method_declaration", "n + 1"), ("Java", "class_declaration", "1"),
    ("Rust", "match_expression", "n"), ("Rust", "match_arm", "2 * n"), ("Rust", "function_item", "n + 2"),
    ("Rust", "struct_item", "1"), ("Rust", "trait_item", "1"), ("Rust", "impl_item", "1"),
    ("Kotlin", "if_expression", "n"), ("Kotlin", "function_declaration", "n + 1"), ("Kotlin", "class_declaration", "1"),
    ("TypeScript", "if_statement", "n"), ("TypeScript", "arrow_function", "1"),
    ("TypeScript", "function_declaration", "n + 2"), ("TypeScript", "class_declaration", "1"),
    ("TypeScript", "interface_declaration", "1"),
    ("JavaScript", "try_statement", "n"), ("JavaScript", "catch_clause", "n"), ("JavaScript", "arrow_function", "1"),
    ("JavaScript", "function_declaration", "n + 2"), ("JavaScript", "class_declaration", "1"),
]


@query(
    "node_histogram",
    "SELECT language, kind, sum(c)::BIGINT AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT language, '{kind}' AS kind, {count} AS c FROM t WHERE language = '{language}'"
        for language, kind, count in _NODES
    ).join([f"WITH t AS (SELECT * FROM ({TRUTH_SQL}) WHERE NOT {_BAD}) ", ""])
    + ") GROUP BY ALL",
)
def node_histogram(spark, sf_dir):
    """Syntax node kinds per language, summed over all files."""
    rows = analyze(source_files(spark, sf_dir), "content", node_counts=True)
    # the outer form: for the other one Spark adds a filter that computes the map a second time
    nodes = rows.select("language", F.explode_outer("node_counts").alias("kind", "c")).filter("kind IS NOT NULL")
    return nodes.groupBy("language", "kind").agg(F.sum("c").alias("n"))


@query(
    "precision_recall",
    f"""SELECT language, round(sum(n_both)::DOUBLE / sum(found), 6) AS precision, round(sum(n_both)::DOUBLE / sum(expected), 6) AS recall,
               round(2.0 * sum(n_both) / (sum(found) + sum(expected)), 6) AS f1
        FROM (SELECT language, len(functions) AS found, n + 1 AS expected,
                     CASE WHEN list_contains(functions, 'main_' || id) THEN n + 1 ELSE n END AS n_both FROM ({TRUTH_SQL}))
        GROUP BY language""",
)
def precision_recall_by_language(spark, sf_dir):
    """Found functions against the expected compute_… and main_… names."""
    key = F.col("p_partkey").cast("string")
    expected = F.array_append(
        F.transform(F.sequence(F.lit(1), F.col("p_size")), lambda i: F.concat(F.lit("compute_"), key, F.lit("_"), i)),
        F.concat(F.lit("main_"), key),
    )
    sizes = precision_recall(F.col("functions"), expected)
    rows = _analyzed(spark, sf_dir).select("language", *[c.alias(n) for n, c in sizes.items()])
    total = rows.groupBy("language").agg(*[F.sum(n).alias(n) for n in sizes])
    return total.select(
        "language",
        F.round(F.col("n_both") / F.col("n_found"), 6).alias("precision"),
        F.round(F.col("n_both") / F.col("n_expected"), 6).alias("recall"),
        F.round(F.lit(2.0) * F.col("n_both") / (F.col("n_found") + F.col("n_expected")), 6).alias("f1"),
    )


@query(
    "meta_rollup",
    f"""SELECT filename, array_to_string(list_sort(list_concat(fns, ['main_' || id])), ' ') AS functions,
               'Shape' || id AS classes, 'Part' || id AS modules, (2 * (n + 1) + 3)::BIGINT AS complexity_score
        FROM ({TRUTH_SQL}) WHERE language = 'Haskell'""",
)
def meta_rollup(spark, sf_dir):
    """Findings of a file's chunks united in the file's own row."""
    files = source_files(spark, sf_dir).filter(F.col("language") == "Haskell")
    chunks = files.withColumn("chunks", fixed_lines(F.col("content"), 20))
    named = chunks.withColumn(
        "named",
        F.transform(
            "chunks",
            lambda c: F.struct(
                text.find_all(c["content"], text.HASKELL_SIGNATURE_NAME).alias("functions"),
                text.find_all(c["content"], r"(?m)^module\s+([A-Z][\w.']*)").alias("modules"),
                text.find_all(c["content"], text.HASKELL_TYPE_NAMES[3]).alias("classes"),
            ),
        ),
    )
    return named.select("filename", *[c.alias(n) for n, c in roll_up(F.col("named")).items()]).select(
        "filename", *[metadata.joined(F.col(n)).alias(n) for n in ("functions", "classes", "modules")], "complexity_score"
    )


@query(
    "analyze_default",
    "SELECT 'doc_' || doc_id || '.' || lang AS filename, 'default_basic' AS analysis_method, 0::BIGINT AS complexity_score,"
    " '' AS functions, length(text)::BIGINT AS char_count FROM documents",
)
def analyze_default(spark, sf_dir):
    """Text without an analyzer gets the constant metadata."""
    from workloads.views import document_files

    rows = analyze(document_files(spark, sf_dir), "content")
    return rows.select(
        "filename", "analysis_method", "complexity_score", metadata.joined(F.col("functions")).alias("functions"), "char_count"
    )


@query(
    "haskell_details",
    f"""SELECT filename, 'Data.Map qualified Map, Shop.Catalog' AS imports,
               array_to_string(list_sort(list_concat(fns, ['main_' || id])), ' ') AS signed,
               'data Kind' || id || ' = Small|Large' AS data_types, 'Part' || id AS modules
        FROM ({TRUTH_SQL}) WHERE language = 'Haskell'""",
)
def haskell_details(spark, sf_dir):
    """Imports, signatures, data types and modules in detail."""
    rows = source_files(spark, sf_dir).filter(F.col("language") == "Haskell")
    found = rows.select("filename", *[c.alias(n) for n, c in text.haskell_details("content").items()])
    shown = {
        "imports": "array_join(transform(import_details, i -> concat_ws(' ', i.module,"
        " CASE WHEN i.qualified THEN 'qualified' END, i.alias)), ', ')",
        "signed": "array_join(array_sort(flatten(transform(signature_details, s -> s.names))), ' ')",
        "data_types": "array_join(transform(data_type_details, d -> concat(d.kind, ' ', d.name, ' = ',"
        " array_join(d.constructors, '|'))), ', ')",
        "modules": "array_join(module_details.name, ' ')",
    }
    return found.selectExpr("filename", *[f"{sql} AS {n}" for n, sql in shown.items()])


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_STRIP = "regexp_replace({}, '\\([^()]*\\)|\\[[^\\[\\]]*\\]', '', 'g')"


@query(
    "haskell_signatures",
    f"""WITH files AS (SELECT filename, content FROM ({SOURCES_SQL}) WHERE language = 'Haskell'
                       UNION ALL SELECT 'doc_' || doc_id, text FROM documents),
        blocks AS (SELECT filename, unnest(b) AS block, unnest(range(0, len(b))) AS ordinal
                   FROM (SELECT filename, regexp_extract_all(content, {_quoted(records.BLOCK)}) AS b FROM files)),
        kinds AS (SELECT *, regexp_matches(block, {_quoted(dict((n, p) for n, _, p in records.FORMS)[2])}) AS signed FROM blocks
                  WHERE NOT regexp_matches(block, {_quoted(records.NOT_A_FUNCTION)}) AND regexp_matches(block, {_quoted(records.NAME)})),
        named AS (SELECT filename, ordinal, NOT signed AS defined,
                         CASE WHEN signed THEN regexp_replace(trim(regexp_extract(block, {_quoted(records.TYPE)}, 1)), '\\s+', ' ', 'g') END AS type,
                         unnest(CASE WHEN signed THEN regexp_extract_all(regexp_extract(block, {_quoted(records.SIGNED_NAMES)}, 1), {_quoted(records.ANY_NAME)})
                                ELSE [regexp_extract(block, {_quoted(records.NAME)}, 1)] END) AS name FROM kinds),
        told AS (SELECT *, last_value(type IGNORE NULLS) OVER (PARTITION BY filename, name ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS signature FROM named),
        found AS (SELECT filename, name, min(ordinal) AS ordinal, count(*) AS clauses, arg_min_null(signature, ordinal) AS signature FROM told WHERE defined GROUP BY ALL)
        SELECT *, (length(bare) - length(replace(bare, '->', ''))) // 2 AS arity FROM (SELECT *, regexp_replace({_STRIP.format(_STRIP.format(_STRIP.format(_STRIP.format('signature'))))}, '^(?s).*=>', '') AS bare FROM found)""".replace(
        "SELECT *, (length(bare)", "SELECT filename, name, ordinal, clauses, signature, (length(bare)"
    ),
)
def haskell_signatures(spark, sf_dir):
    """Every function of the Haskell files, and of plain text read as Haskell, with the
    nearest signature before it that lists its name."""
    sources = source_files(spark, sf_dir).filter(F.col("language") == "Haskell").select("filename", "content")
    texts = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("filename"), F.col("text").alias("content"))
    return records.signed_functions(sources.unionByName(texts))


_SIDES = """SELECT o_custkey, o_orderpriority AS name, {0} AS best, {1} AS note, {2} AS years FROM orders WHERE o_orderstatus {3} GROUP BY ALL"""


@query(
    "merge_by_name",
    f"""WITH l AS ({_SIDES.format("max(o_totalprice)", "CASE WHEN count(*) > 1 THEN 'many' ELSE '' END", "CASE WHEN min(o_totalprice) > 1000 THEN list_sort(list_distinct(list(year(o_orderdate)))) ELSE [] END", "= 'O'")}),
             r AS ({_SIDES.format("CASE WHEN count(*) > 1 THEN max(o_totalprice) END", "'other'", "list_sort(list_distinct(list(year(o_orderdate))))", "<> 'O'")})
        SELECT o_custkey, name, coalesce(l.best, r.best) AS best, coalesce(nullif(l.note, ''), r.note, l.note) AS note,
               array_to_string(CASE WHEN coalesce(len(r.years), 0) > 0 THEN r.years ELSE l.years END, ' ') AS years
        FROM l FULL OUTER JOIN r USING (o_custkey, name)""",
)
def merge_by_name(spark, sf_dir):
    """Two lists of records per customer, of open and of other orders by priority, merged field by field."""

    def side(status, best, note, years):
        of = table(spark, sf_dir, "orders").filter(status).groupBy("o_custkey", F.col("o_orderpriority").alias("name"))
        rows = of.agg(best.alias("best"), note.alias("note"), years.alias("years"))
        return rows.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("name", "best", "note", "years"))).alias("records"))

    years = F.array_sort(F.collect_set(F.year("o_orderdate")))
    none = F.array().cast("array<int>")
    left = side(F.col("o_orderstatus") == "O", F.max("o_totalprice"), F.when(F.count("*") > 1, "many").otherwise(""), F.when(F.min("o_totalprice") > 1000, years).otherwise(none))
    right = side(F.col("o_orderstatus") != "O", F.when(F.count("*") > 1, F.max("o_totalprice")), F.lit("other"), years)
    both = left.withColumnRenamed("records", "l").join(right.withColumnRenamed("records", "r"), "o_custkey", "full_outer")
    merged = records.merge_by_name("l", "r", {"best": "double", "note": "string", "years": "array<int>"}, prefer_right=("years",))
    rows = both.select("o_custkey", F.expr(merged).alias("m")).select("o_custkey", F.explode_outer("m").alias("x"))
    return rows.select("o_custkey", "x.name", "x.best", "x.note", F.array_join("x.years", " ").alias("years"))
