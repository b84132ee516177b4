"""JSON readers, text measures and regular-expression extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.functions import metadata, symbols, text
from codelode.operators.analysis import universal_analysis
from workloads.registry import query
from workloads.views import SOURCES_SQL, document_files, source_files, table

# One JSON text per event: all shapes a stored value may take, chosen by the
# event number, plus broken and empty text.
_JSON_SQL = """
  SELECT event_id, CASE event_id % 9
    WHEN 0 THEN '{"a": ' || user_id || ', "b": true, "s": "' || event_type || '", "l": ["x", "' || event_type || '"]}'
    WHEN 1 THEN '{"a": "' || user_id || '", "b": "false", "s": null, "l": "' || event_type || '"}'
    WHEN 2 THEN '{"a": ' || user_id || '.75, "b": 0, "s": true, "l": []}'
    WHEN 3 THEN '{"a": "1.5", "b": "", "s": "", "n": 3}'
    WHEN 4 THEN '{"a": "x' || user_id || '", "b": [], "l": [1, 2], "n": 0}'
    WHEN 5 THEN '{"b": [0], "a": -' || user_id || ', "n": ["' || event_type || '"]}'
    WHEN 6 THEN '{"broken": '
    WHEN 7 THEN ''
    ELSE props END AS j FROM events"""


def _json_rows(spark, sf_dir):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    q = F.lit('"')
    shapes = [
        F.concat(F.lit('{"a": '), user, F.lit(', "b": true, "s": "'), kind, F.lit('", "l": ["x", "'), kind, F.lit('"]}')),
        F.concat(F.lit('{"a": "'), user, F.lit('", "b": "false", "s": null, "l": "'), kind, F.lit('"}')),
        F.concat(F.lit('{"a": '), user, F.lit('.75, "b": 0, "s": true, "l": []}')),
        F.lit('{"a": "1.5", "b": "", "s": "", "n": 3}'),
        F.concat(F.lit('{"a": "x'), user, F.lit('", "b": [], "l": [1, 2], "n": 0}')),
        F.concat(F.lit('{"b": [0], "a": -'), user, F.lit(', "n": ['), q, kind, q, F.lit("]}")),
        F.lit('{"broken": '),
        F.lit(""),
        F.col("props"),
    ]
    number = (F.pmod("event_id", F.lit(len(shapes))) + 1).cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id", F.element_at(F.array(*shapes), number).alias("j")
    ).withColumn("v", metadata.parsed("j"))


_TYPED_SQL = f"""
  SELECT event_id,
    CASE event_id % 9 WHEN 0 THEN u WHEN 1 THEN u WHEN 2 THEN u WHEN 5 THEN -u ELSE 0 END AS a_int,
    event_id % 9 IN (0, 1, 5) AS b_bool,
    CASE event_id % 9 WHEN 0 THEN e WHEN 1 THEN 'None' WHEN 2 THEN 'True' WHEN 3 THEN '' ELSE 'none' END AS s_text,
    coalesce(try_cast(json_extract_string(CASE WHEN json_valid(j) THEN j END, '$.k') AS BIGINT), 0) AS k_int
  FROM (SELECT event_id, user_id AS u, event_type AS e FROM events) JOIN ({_JSON_SQL}) USING (event_id)"""


@query("json_extract_typed", _TYPED_SQL)
def json_extract_typed(spark, sf_dir):
    """Whole numbers, truth values and text with their defaults."""
    return _json_rows(spark, sf_dir).select(
        "event_id",
        F.coalesce(metadata.int_field("v", "a"), F.lit(0)).alias("a_int"),
        F.coalesce(metadata.bool_field("v", "b"), F.lit(False)).alias("b_bool"),
        F.coalesce(metadata.string_field("v", "s", "none"), F.lit("none")).alias("s_text"),
        metadata.int_field("v", "k").alias("k_int"),
    )


@query(
    "json_lists",
    """SELECT event_id,
         CASE event_id % 9 WHEN 0 THEN 'x ' || event_type WHEN 1 THEN event_type WHEN 4 THEN '1 2' ELSE '' END AS l_text,
         CASE event_id % 9 WHEN 3 THEN '3' WHEN 5 THEN event_type ELSE '' END AS errors,
         CASE event_id % 9 WHEN 0 THEN '["x","' || event_type || '"]' WHEN 1 THEN '["' || event_type || '"]'
              WHEN 4 THEN '[1,2]' ELSE '[]' END AS l_json
       FROM events""",
)
def json_lists(spark, sf_dir):
    """List readers: lists, wrapped single values, error counts, list text."""
    return _json_rows(spark, sf_dir).select(
        "event_id",
        metadata.joined(metadata.list_field("v", "l")).alias("l_text"),
        metadata.joined(metadata.error_nodes_field("v", "n")).alias("errors"),
        F.coalesce(metadata.list_text_field("v", "l"), F.lit("[]")).alias("l_json"),
    )


@query(
    "json_promote",
    """SELECT event_id, event_type AS analysis_method, 'unknown' AS chunking_method, user_id AS complexity_score,
              event_type = 'error' AS has_async, true AS success, event_type || ' z' AS functions, '' AS classes
       FROM events""",
)
def json_promote(spark, sf_dir):
    """All metadata columns from one parse of the stored JSON text."""
    events = table(spark, sf_dir, "events")
    body = F.to_json(F.struct(
        F.col("event_type").alias("analysis_method"), F.col("user_id").alias("complexity_score"),
        (F.col("event_type") == "error").alias("has_async"),
        F.array("event_type", F.lit("z")).alias("functions"),
    ))
    rows = metadata.promote(events.select("event_id", body.alias("metadata_json")))
    return rows.select(
        "event_id", "analysis_method", "chunking_method", "complexity_score", "has_async", "success",
        metadata.joined(F.col("functions")).alias("functions"), metadata.joined(F.col("classes")).alias("classes"),
    )


@query(
    "json_defaults",
    """SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'none' ELSE event_type END AS names,
              CASE WHEN event_type = 'error' THEN '' ELSE '{"chunking_method":"' || event_type || '"}' END AS method_json
       FROM events""",
)
def json_defaults(spark, sf_dir):
    """Missing and empty lists take the default; '' for no method."""
    kind = F.col("event_type")
    names = F.when(kind == "error", F.lit(None)).when(kind == "signup", F.array().cast("array<string>")).otherwise(F.array(kind))
    return table(spark, sf_dir, "events").select(
        "event_id",
        metadata.joined(metadata.fill_empty(names, F.array(F.lit("none")))).alias("names"),
        metadata.method_metadata(F.when(kind != "error", F.concat(F.lit(" "), kind, F.lit(" ")))).alias("method_json"),
    )


@query(
    "metadata_merge",
    """SELECT event_id, CASE WHEN event_type < 'm' THEN event_type || ' m' WHEN event_type > 'm' THEN 'm ' || event_type
              ELSE 'm' END AS functions, greatest(user_id, 50) AS complexity_score,
              event_type = 'error' OR user_id > 10 AS has_async FROM events""",
)
def metadata_merge(spark, sf_dir):
    """Two analyzers' findings as one."""
    merged = metadata.merge_metadata(
        {"functions": F.array("event_type"), "complexity_score": F.col("user_id"), "has_async": F.col("event_type") == "error"},
        {"functions": F.array(F.lit("m")), "complexity_score": F.lit(50).cast("bigint"), "has_async": F.col("user_id") > 10},
    )
    return table(spark, sf_dir, "events").select(
        "event_id", metadata.joined(merged["functions"]).alias("functions"),
        merged["complexity_score"].alias("complexity_score"), merged["has_async"].alias("has_async"),
    )


@query(
    "text_metrics",
    """SELECT doc_id, len(l)::BIGINT AS total_lines,
              len(list_filter(l, lambda x: regexp_matches(x, '\\S')))::BIGINT AS non_empty_lines,
              len(list_filter(l, lambda x: regexp_matches(x, '^\\s*#')))::BIGINT AS comment_lines,
              round(list_sum(list_transform(l, lambda x: length(x)))::DOUBLE / len(l), 6) AS avg_line_length,
              contains(text, 'def ') OR contains(text, 'function ') OR contains(text, 'fn ') AS has_functions,
              contains(text, 'class ') OR contains(text, 'struct ') AS has_classes,
              contains(text, 'import ') OR contains(text, '#include') OR contains(text, 'use ') AS has_imports,
              length(replace(replace(replace(text, ' ', ''), chr(10), ''), chr(9), ''))::BIGINT AS solid
       FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""",
)
def text_metrics(spark, sf_dir):
    rows = document_files(spark, sf_dir)
    found = text.text_metrics("content")
    found["avg_line_length"] = F.round(found["avg_line_length"], 6)
    return rows.select(
        "doc_id", *[c.alias(n) for n, c in found.items()], text.solid_size("content").alias("solid")
    )


@query(
    "content_hash",
    "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents",
)
def content_hash(spark, sf_dir):
    return document_files(spark, sf_dir).select("doc_id", text.content_hash("content").alias("hash"))


def _sql_names(patterns: list[str]) -> str:
    parts = ", ".join(f"regexp_extract_all(content, '{p}', 1)" for p in patterns)
    return f"array_to_string(list_sort(list_distinct(list_filter(flatten([{parts}]), lambda n: n <> ''))), ' ')"


_FUNCTION_PATTERNS, _CLASS_PATTERNS, _IMPORT_PATTERNS = (text.UNIVERSAL_PATTERNS[f] for f in ("functions", "classes", "imports"))


@query(
    "regex_names",
    f"""SELECT filename, {_sql_names(_FUNCTION_PATTERNS)} AS functions, {_sql_names(_CLASS_PATTERNS)} AS classes,
               {_sql_names(_IMPORT_PATTERNS)} AS imports FROM ({SOURCES_SQL})""",
)
def regex_names(spark, sf_dir):
    found = universal_analysis(source_files(spark, sf_dir), "content")
    return found.select(
        "filename", *[metadata.joined(F.col(n)).alias(n) for n in ("functions", "classes", "imports")]
    )


@query(
    "regex_complexity",
    "SELECT filename, ("
    + " + ".join(
        f"len(regexp_extract_all(content, '\\b{w}\\b'))" for w in ("if", "for", "while", "switch", "case", "try", "catch")
    )
    + f")::BIGINT AS complexity_score FROM ({SOURCES_SQL})",
)
def regex_complexity(spark, sf_dir):
    return source_files(spark, sf_dir).select(
        "filename", text.universal_complexity("content").alias("complexity_score")
    )


def _sql_count(column: str, words: list[str]) -> str:
    return " + ".join(f"(length({column}) - length(replace({column}, '{w}', ''))) // {len(w)}" for w in words)


@query(
    "complexity_counts",
    f"""SELECT doc_id, ({_sql_count('text', ['if ', 'for ', 'while ', 'try:', 'except'])})::BIGINT AS branches,
               ({_sql_count('text', ['case ', 'if ', '|', 'where', 'let '])} + 1)::BIGINT AS haskell_branches
        FROM documents""",
)
def complexity_counts(spark, sf_dir):
    rows = document_files(spark, sf_dir)
    return rows.select(
        "doc_id",
        text.count_literals("content", text.PYTHON_BRANCH_WORDS).alias("branches"),
        (text.count_literals("content", text.HASKELL_BRANCH_WORDS) + 1).alias("haskell_branches"),
    )


@query(
    "python_fallback",
    f"""SELECT filename, array_to_string(f, ' ') AS functions, array_to_string(c, ' ') AS classes,
               'os shop.catalog' AS imports,
               (len(f) + len(c) + {_sql_count('content', ['if ', 'for ', 'while ', 'try:', 'except'])})::BIGINT AS complexity_score,
               true AS has_type_hints, contains(content, 'async def') AS has_async
        FROM (SELECT *, regexp_extract_all(content, 'def\\s+([a-zA-Z_][a-zA-Z0-9_]*)\\s*\\(', 1) AS f,
                     regexp_extract_all(content, 'class\\s+([a-zA-Z_][a-zA-Z0-9_]*)\\s*[\\(:]', 1) AS c
              FROM ({SOURCES_SQL})) WHERE language = 'Python'""",
)
def python_fallback(spark, sf_dir):
    rows = source_files(spark, sf_dir).filter(F.col("language") == "Python")
    found = text.python_fallback("content")
    shown = {n: metadata.joined(found[n]) for n in ("functions", "classes", "imports")}
    shown |= {n: found[n] for n in ("complexity_score", "has_type_hints", "has_async")}
    return rows.select("filename", *[c.alias(n) for n, c in shown.items()])


@query(
    "haskell_features",
    f"""SELECT filename, array_to_string(list_sort(list_distinct(
                 regexp_extract_all(content, '(?m)^([a-zA-Z][a-zA-Z0-9_'']*)\\s*::', 1))), ' ') AS functions,
               'Kind' || p_partkey || ' Shape' || p_partkey AS types, 'Data.Map Shop.Catalog' AS dependencies,
               ({_sql_count('content', ['case ', 'if ', 'where', 'let ', 'do', '>>', '>>=', '$', '::'])})::BIGINT AS complexity_score,
               true AS has_imports, false AS has_instances, true AS has_classes
        FROM ({SOURCES_SQL}) WHERE language = 'Haskell'""",
)
def haskell_features(spark, sf_dir):
    rows = source_files(spark, sf_dir).filter(F.col("language") == "Haskell")
    found = text.haskell_features("content")
    shown = {n: metadata.joined(found[n]) for n in ("functions", "types", "dependencies")}
    shown |= {n: found[n] for n in ("complexity_score", "has_imports", "has_instances", "has_classes")}
    return rows.select("filename", *[c.alias(n) for n, c in shown.items()])


@query(
    "haskell_signatures",
    f"""SELECT filename, count(*) AS signatures, count(*) FILTER (WHERE poly) AS polymorphic FROM (
          SELECT filename, regexp_matches(s, '\\b[a-z][a-zA-Z0-9_]*\\b') AS poly FROM (
            SELECT filename, unnest(regexp_extract_all(regexp_replace(content, '--[^\\n]*', '', 'g'), '(?m)::[ ]*([^\\n]*)$', 1)) AS s
            FROM ({SOURCES_SQL}) WHERE language = 'Haskell')) GROUP BY filename""",
)
def haskell_signatures(spark, sf_dir):
    """Type signatures and how many of them have a type variable."""
    rows = source_files(spark, sf_dir).filter(F.col("language") == "Haskell")
    bare = rows.withColumn("bare", F.expr(symbols.without_comments("content", "language")))
    found = text.find_all(F.col("bare"), r"(?m)::[ ]*([^\n]*)$")
    return bare.select("filename", found.alias("s")).select(
        "filename", F.size("s").cast("bigint").alias("signatures"),
        F.size(F.filter("s", text.is_polymorphic)).cast("bigint").alias("polymorphic"),
    )


@query(
    "name_visibility",
    """SELECT event_id, name, starts_with(name, '_') AS private, starts_with(name, '__') AND ends_with(name, '__') AS dunder
       FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '_' || event_type
                    ELSE '__' || event_type || '__' END AS name FROM events)""",
)
def name_visibility(spark, sf_dir):
    kind, number = F.col("event_type"), F.pmod("event_id", F.lit(3))
    name = F.when(number == 0, kind).when(number == 1, F.concat(F.lit("_"), kind)).otherwise(
        F.concat(F.lit("__"), kind, F.lit("__"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", name.alias("name"))
    return rows.withColumns({"private": text.is_private(F.col("name")), "dunder": text.is_dunder(F.col("name"))})


@query(
    "docstring_clean",
    """SELECT event_id, event_type AS doc FROM events""",
)
def docstring_clean(spark, sf_dir):
    """Quoted text in its three spellings, cleaned."""
    kind, number = F.col("event_type"), F.pmod("event_id", F.lit(3))
    quoted = F.when(number == 0, F.concat(F.lit('""" '), kind, F.lit('\n"""'))).when(
        number == 1, F.concat(F.lit("'"), kind, F.lit(" '"))
    ).otherwise(F.concat(F.lit("  "), kind))
    return table(spark, sf_dir, "events").select("event_id", text.clean_docstring(quoted).alias("doc"))
