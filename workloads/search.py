"""Keyword, typed-filter, vector and hybrid searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode.operators import filters, search
from codelode.operators.filters import QueryFilter
from codelode.operators.keyword import keyword_filter
from codelode.plans import builder
from codelode import report
from workloads.registry import query
from workloads.views import (
    CHUNKS_SQL, DOCUMENTS_SQL, SOURCES_SQL, chunk_rows, document_rows, query_vector, source_files, table,
)

_SHOWN = ["filename", "source_name", "language", "char_count"]
_KEYWORDS = {
    # name: (keyword query, the same condition in SQL)
    "kw_language_eq": ("language:EN", "lower(language) = lower('EN')"),
    "kw_contains": ('value_contains(code, "tion the")', "code ILIKE '%tion the%'"),
    "kw_text_search": ("tion th", "code ILIKE '%tion th%'"),
    "kw_or": ("language:fr OR language:de", "lower(language) = 'fr' OR lower(language) = 'de'"),
    "kw_and_or_nested": (
        '(language:en or language:es) and (value_contains(code, "ing") or source_name:src3) filename:doc_1',
        "(lower(language) = 'en' OR lower(language) = 'es') AND (code ILIKE '%ing%' OR source_name = 'src3')"
        " AND filename ILIKE '%doc_1%'",
    ),
    "kw_filename_pattern": ("filename:doc_1_", "filename ILIKE '%doc_1_%'"),
    "kw_alias_field": ('path:"7.en" lang:en', "filename ILIKE '%7.en%' AND lower(language) = 'en'"),
    "kw_words_then_field": ("tion language:en", "code ILIKE '%tion%' AND lower(language) = 'en'"),
    "kw_typed_eq": ("start:1 and end:3", 'start = 1 AND "end" = 3'),
    "kw_empty": ("", "TRUE"),
}


def _keyword(name: str, text: str, condition: str) -> None:
    @query(
        name,
        f"SELECT filename, source_name, language, char_count FROM ({DOCUMENTS_SQL}) WHERE {condition}",
    )
    def run(spark, sf_dir):
        return keyword_filter(document_rows(spark, sf_dir), text).select(*_SHOWN)


for _name, (_text, _condition) in _KEYWORDS.items():
    _keyword(_name, _text, _condition)


@query(
    "kw_exists",
    f"SELECT filename, embedding_model FROM ({CHUNKS_SQL}) WHERE embedding IS NOT NULL",
)
def kw_exists(spark, sf_dir):
    return keyword_filter(chunk_rows(spark, sf_dir), "exists(embedding)").select("filename", "embedding_model")


@query(
    "keyword_topk",
    f"""SELECT filename, start, 1.0::DOUBLE AS score, 'keyword_match' AS score_type FROM ({DOCUMENTS_SQL})
        WHERE lower(language) = 'en' AND code ILIKE '%the%' ORDER BY filename, start LIMIT 10""",
)
def keyword_topk(spark, sf_dir):
    found = search.keyword_search(document_rows(spark, sf_dir), 'language:en value_contains(code, "the")')
    return found.select("filename", "start", "score", "score_type")


_OPERATIONS = [
    ("eq", QueryFilter("language", "=", "en"), "language = 'en'"),
    ("ne", QueryFilter("language", "!=", "en"), "language != 'en'"),
    ("gt", QueryFilter("char_count", ">", 2000), "char_count > 2000"),
    ("ge", QueryFilter("char_count", ">=", 11), "char_count >= 11"),
    ("lt", QueryFilter("char_count", "<", 500), "char_count < 500"),
    ("le", QueryFilter("char_count", "<=", 500), "char_count <= 500"),
    ("like", QueryFilter("filename", "LIKE", "doc_1%.en"), "filename LIKE 'doc_1%.en'"),
    ("ilike", QueryFilter("filename", "ILIKE", "DOC_2%"), "filename ILIKE 'DOC_2%'"),
    ("in", QueryFilter("source_name", "IN", ["src1", "src2"]), "source_name IN ('src1', 'src2')"),
    ("not_in", QueryFilter("source_name", "NOT IN", ["src1", "src2"]), "source_name NOT IN ('src1', 'src2')"),
    ("is_null", QueryFilter("code", "IS NULL"), "code IS NULL"),
    ("is_not_null", QueryFilter("code", "IS NOT NULL"), "code IS NOT NULL"),
    ("contains", QueryFilter("code", "CONTAINS", "the"), "contains(code, 'the')"),
]


@query(
    "filter_ops_matrix",
    " UNION ALL ".join(
        f"SELECT '{name}' AS operator, count(*) FILTER (WHERE {sql}) AS n FROM ({DOCUMENTS_SQL})"
        for name, _, sql in _OPERATIONS
    ),
)
def filter_ops_matrix(spark, sf_dir):
    """How many rows each operator keeps, counted in one pass."""
    rows = document_rows(spark, sf_dir)
    counted = rows.agg(*[F.count_if(filters.condition(rows, f)).alias(name) for name, f, _ in _OPERATIONS])
    return counted.unpivot([], [name for name, _, _ in _OPERATIONS], "operator", "n")


@query(
    "filter_array_contains",
    f"""SELECT filename FROM ({SOURCES_SQL}) WHERE list_contains(
          list_distinct(regexp_extract_all(content, 'class\\s+([a-zA-Z_][a-zA-Z0-9_]*)', 1)), 'Part' || p_partkey)""",
)
def filter_array_contains(spark, sf_dir):
    """Array membership against a per-row value: the class named after the part."""
    from codelode.functions import text

    files = source_files(spark, sf_dir)
    found = files.withColumn("classes", text.find_all(F.col("content"), text.UNIVERSAL_PATTERNS["classes"][0]))
    return found.filter(
        F.array_contains("classes", F.concat(F.lit("Part"), "p_partkey"))
    ).select("filename")


@query(
    "filter_array_constant",
    f"""SELECT filename FROM ({SOURCES_SQL})
        WHERE list_contains(regexp_extract_all(content, 'import\\s+([a-zA-Z_][a-zA-Z0-9_\\.]*)', 1), 'os')""",
)
def filter_array_constant(spark, sf_dir):
    from codelode.functions import text

    files = source_files(spark, sf_dir)
    rows = files.withColumn("imports", text.find_all(F.col("content"), text.UNIVERSAL_PATTERNS["imports"][0]))
    return filters.apply_filters(rows, [QueryFilter("imports", "CONTAINS", "os")]).select("filename")


@query(
    "filter_json_contains",
    "SELECT event_id, event_type FROM events WHERE json_extract(props, '$.k')::BIGINT = 42",
)
def filter_json_contains(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumnRenamed("props", "metadata_json")
    return filters.apply_filters(events, [QueryFilter("metadata_json", "CONTAINS", {"k": 42})]).select(
        "event_id", "event_type"
    )


@query(
    "filter_logic_or",
    f"SELECT filename, char_count FROM ({DOCUMENTS_SQL}) WHERE language = 'fr' OR char_count > 5000",
)
def filter_logic_or(spark, sf_dir):
    asked = [QueryFilter("language", "=", "fr"), QueryFilter("char_count", ">", 5000)]
    return filters.apply_filters(document_rows(spark, sf_dir), asked, "OR").select("filename", "char_count")


@query(
    "filter_nested_dict",
    f"""SELECT filename, char_count FROM ({DOCUMENTS_SQL})
        WHERE language = 'en' AND char_count >= 100 AND source_name NOT IN ('src1')""",
)
def filter_nested_dict(spark, sf_dir):
    """The same filters written for a document store and read back."""
    rows = document_rows(spark, sf_dir)
    asked = [
        QueryFilter("language", "=", "en"), QueryFilter("char_count", ">=", 100),
        QueryFilter("source_name", "NOT IN", ["src1"]),
    ]
    tree = filters.to_filter_dict(asked)
    return rows.filter(filters.from_filter_dict(rows, tree)).select("filename", "char_count")


_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_SIMILARITY = f"list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR})"


@query(
    "vector_topk",
    f"""SELECT filename, round(1.0 - {_SIMILARITY}, 6) AS distance, round({_SIMILARITY}, 6) AS score
        FROM ({CHUNKS_SQL}) WHERE embedding IS NOT NULL
        ORDER BY 1.0 - {_SIMILARITY}, filename LIMIT 10""",
)
def vector_topk(spark, sf_dir):
    found = search.vector_search(chunk_rows(spark, sf_dir), query_vector(spark, sf_dir))
    return found.select("filename", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score"))


@query(
    "vector_topk_model",
    f"""SELECT filename, embedding_model, round({_SIMILARITY}, 6) AS score
        FROM ({CHUNKS_SQL}) WHERE embedding IS NOT NULL AND embedding_model = 'model_3'
        ORDER BY {_SIMILARITY} DESC, filename LIMIT 20""",
)
def vector_topk_model(spark, sf_dir):
    found = search.vector_search(chunk_rows(spark, sf_dir), query_vector(spark, sf_dir), 20, "model_3")
    return found.select("filename", "embedding_model", F.round("score", 6).alias("score"))


@query(
    "vector_distance_all",
    f"""SELECT doc_id, round({_SIMILARITY}, 6) AS similarity FROM ({CHUNKS_SQL}) WHERE embedding IS NOT NULL""",
)
def vector_distance_all(spark, sf_dir):
    """Every vector's similarity, without a limit."""
    rows = chunk_rows(spark, sf_dir).filter(F.col("embedding").isNotNull())
    scored = search.with_distance(rows, query_vector(spark, sf_dir))
    return scored.select("doc_id", F.round(F.lit(1.0) - F.col("distance"), 6).alias("similarity"))


@query(
    "legacy_vector_topk5",
    f"""SELECT filename, language, start, "end", source_name, round({_SIMILARITY}, 6) AS score
        FROM ({CHUNKS_SQL}) WHERE embedding IS NOT NULL ORDER BY {_SIMILARITY} DESC, filename LIMIT 5""",
)
def legacy_vector_topk5(spark, sf_dir):
    found = search.legacy_vector_search(chunk_rows(spark, sf_dir), query_vector(spark, sf_dir))
    return found.select("filename", "language", "start", "end", "source_name", F.round("score", 6).alias("score"))


def _hybrid_sql(vector_weight: float, keyword_weight: float, condition: str, k: int) -> str:
    return f"""
      SELECT filename, round({_SIMILARITY} * {vector_weight} + {keyword_weight}, 6) AS score, score_type
      FROM (SELECT *, 'hybrid_combined' AS score_type FROM ({CHUNKS_SQL})
            WHERE embedding IS NOT NULL AND ({condition}))
      ORDER BY {_SIMILARITY} * {vector_weight} + {keyword_weight} DESC, filename LIMIT {k}"""


@query("hybrid_topk", _hybrid_sql(0.7, 0.3, "lower(language) = 'en' AND code ILIKE '%the%'", 10))
def hybrid_topk(spark, sf_dir):
    found = search.hybrid_search(
        chunk_rows(spark, sf_dir), query_vector(spark, sf_dir), 'language:en and value_contains(code, "the")'
    )
    return found.select("filename", F.round("score", 6).alias("score"), "score_type")


@query(
    "builder_hybrid_or",
    _hybrid_sql(0.6, 0.4, "language = 'de' OR char_count > 3000", 15),
)
def builder_hybrid_or(spark, sf_dir):
    """The fluent builder with OR filters and weights shifted towards text."""
    built = (
        builder.create_query().with_embedding(query_vector(spark, sf_dir)).hybrid_search()
        .where("language", "de").filter_by("char_count", ">", 3000).filter_logic_or().limit(15)
    )
    found = builder.adjust_weights(built, "keyword").run(chunk_rows(spark, sf_dir))
    return found.select("filename", F.round("score", 6).alias("score"), "score_type")


@query(
    "builder_keyword",
    f"""SELECT filename, char_count FROM ({DOCUMENTS_SQL}) WHERE language = 'en' AND filename ILIKE '%doc_3%'
        ORDER BY filename, start LIMIT 25""",
)
def builder_keyword(spark, sf_dir):
    built = builder.create_query().keyword_search().where_language("en").where_filename_like("doc_3").limit(25)
    return built.run(document_rows(spark, sf_dir)).select("filename", "char_count")


@query(
    "hybrid_subset",
    f"""SELECT count(*) AS hybrid_rows, 0::BIGINT AS outside_keyword FROM ({CHUNKS_SQL})
        WHERE embedding IS NOT NULL AND lower(language) = 'fr'""",
)
def hybrid_subset(spark, sf_dir):
    """Hybrid rows are keyword rows: counts both and those outside."""
    rows = chunk_rows(spark, sf_dir)
    asked = "language:fr"
    scored = search.with_distance(keyword_filter(rows, asked).filter(F.col("embedding").isNotNull()), query_vector(spark, sf_dir)).select("doc_id")
    allowed = keyword_filter(document_rows(spark, sf_dir), asked).select("doc_id", F.lit(True).alias("inside"))
    return scored.join(allowed, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("hybrid_rows"), F.count_if(F.col("inside").isNull()).alias("outside_keyword")
    )


@query(
    "results_readable",
    f"""SELECT '[' || printf('%.3f', {_SIMILARITY}) || '] (vector_similarity) ' || filename || ' [' || source_name
               || '] (' || language || ') (L' || start || '-L' || "end" || ')' AS line
        FROM ({CHUNKS_SQL}) WHERE embedding IS NOT NULL ORDER BY {_SIMILARITY} DESC, filename LIMIT 10""",
)
def results_readable(spark, sf_dir):
    found = search.vector_search(chunk_rows(spark, sf_dir), query_vector(spark, sf_dir))
    return report.readable_lines(found).select("line")


@query(
    "results_complete",
    f"""SELECT filename, source_name, filename || ':' || start || '-' || "end" AS location
        FROM ({DOCUMENTS_SQL}) WHERE language = 'es'""",
)
def results_complete(spark, sf_dir):
    """Results that lack a location get one from file and lines."""
    rows = keyword_filter(document_rows(spark, sf_dir), "language:es").drop("location")
    return search.complete_result(rows).select("filename", "source_name", "location")


@query(
    "multi_query_topk",
    f"""SELECT query_id, CAST(rank AS INT) AS rank, filename, round(score, 6) AS score FROM (
          SELECT q.vec_id AS query_id, c.filename, list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score,
                 row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, c.filename) AS rank
          FROM ({CHUNKS_SQL}) c, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE c.embedding IS NOT NULL) WHERE rank <= 10""",
)
def multi_query_topk(spark, sf_dir):
    """Every vector whose id is divisible by 100 is a request against all rows."""
    requests = table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = search.multi_query_search(chunk_rows(spark, sf_dir), requests, 10)
    return found.select("query_id", "rank", "filename", F.round("score", 6).alias("score"))
