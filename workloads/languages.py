"""Path filters, language detection, chunk sizes and model routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import languages
from codelode.operators import search
from codelode.sources import globs
from codelode.sources.files import union_sources
from workloads.registry import query
from workloads.views import DOCUMENTS_SQL, document_files, document_rows, source_files, table

# Every given table that holds files, as one list of names.
_PAGE_NAME = "regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1)"
_NAMES_SQL = f"""
  SELECT 'doc_' || doc_id || '.' || lang AS filename FROM documents
  UNION ALL SELECT {_PAGE_NAME} || '/index.html' FROM pages
  UNION ALL SELECT CASE p_partkey % 12
       WHEN 0 THEN 'Makefile' WHEN 1 THEN 'a/Dockerfile' WHEN 2 THEN 'CMakeLists.txt'
       WHEN 3 THEN 'x/build.gradle.kts' WHEN 4 THEN 'my-docker-compose.yml' WHEN 5 THEN 'go.mod'
       WHEN 6 THEN 'stack.yaml' WHEN 7 THEN 'src/m_' || p_partkey || '.RS'
       WHEN 8 THEN 'noext_' || p_partkey WHEN 9 THEN 'lib/w.pyi' WHEN 10 THEN 'web/c' || p_size || '.tsx'
       ELSE 'q.d/r' || p_partkey || '.tar.cpp' END FROM part"""


def _page_name():
    return F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1)


def _file_names(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    shapes = [
        F.lit("Makefile"), F.lit("a/Dockerfile"), F.lit("CMakeLists.txt"), F.lit("x/build.gradle.kts"),
        F.lit("my-docker-compose.yml"), F.lit("go.mod"), F.lit("stack.yaml"),
        F.concat(F.lit("src/m_"), key, F.lit(".RS")), F.concat(F.lit("noext_"), key), F.lit("lib/w.pyi"),
        F.concat(F.lit("web/c"), F.col("p_size").cast("string"), F.lit(".tsx")),
        F.concat(F.lit("q.d/r"), key, F.lit(".tar.cpp")),
    ]
    shape = F.element_at(F.array(*shapes), (F.pmod("p_partkey", F.lit(12)) + 1).cast("int"))
    return union_sources([
        document_files(spark, sf_dir).select("filename"),
        table(spark, sf_dir, "pages").select(F.concat(_page_name(), F.lit("/index.html")).alias("filename")),
        table(spark, sf_dir, "part").select(shape.alias("filename")),
    ])


_BASE = "regexp_extract(filename, '([^/]*)$', 1)"
_EXT = f"lower(regexp_extract({_BASE}, '^\\.*[^.].*?(\\.[^.]*)$', 1))"


@query(
    "lang_detect",
    f"""SELECT filename, language, count(*) AS n FROM (
          SELECT filename, CASE
            WHEN lower({_BASE}) = 'makefile' THEN 'Makefile'
            WHEN lower({_BASE}) = 'dockerfile' THEN 'Dockerfile'
            WHEN lower({_BASE}) = 'jenkinsfile' THEN 'Jenkinsfile'
            WHEN starts_with(lower({_BASE}), 'cmakelists') THEN 'CMake'
            WHEN starts_with(lower({_BASE}), 'build.gradle') THEN 'Gradle'
            WHEN starts_with(lower({_BASE}), 'pom.xml') THEN 'Maven'
            WHEN contains(lower({_BASE}), 'docker-compose') THEN 'Dockerfile'
            WHEN starts_with({_BASE}, 'go.') THEN 'Go'
            WHEN {_BASE} IN ('stack.yaml', 'cabal.project') THEN 'Haskell'
            ELSE CASE {_EXT} WHEN '.rs' THEN 'Rust' WHEN '.tsx' THEN 'TSX' WHEN '.cpp' THEN 'C++'
                 WHEN '.html' THEN 'HTML' WHEN '' THEN 'Unknown' ELSE substr({_EXT}, 2) END
            END AS language FROM ({_NAMES_SQL})) GROUP BY ALL""",
)
def lang_detect(spark, sf_dir):
    """Language of every file name; equal names counted together."""
    named = _file_names(spark, sf_dir).groupBy("filename").agg(F.count(F.lit(1)).alias("n"))
    return named.select("filename", languages.language_of(F.col("filename")).alias("language"), "n")


_LANG_SQL = """SELECT p_partkey, CASE p_partkey % 13
   WHEN 0 THEN 'Python' WHEN 1 THEN 'Rust' WHEN 2 THEN 'Haskell' WHEN 3 THEN 'Markdown' WHEN 4 THEN 'C#'
   WHEN 5 THEN 'TOML' WHEN 6 THEN 'HTML' WHEN 7 THEN 'Kotlin' WHEN 8 THEN 'C++' WHEN 9 THEN 'js'
   WHEN 10 THEN 'TSX' WHEN 11 THEN 'CSS' ELSE p_type END AS language FROM part"""


def _languages(spark, sf_dir):
    names = "Python Rust Haskell Markdown C# TOML HTML Kotlin C++ js TSX CSS".split()
    listed = F.try_element_at(
        F.array(*[F.lit(n) for n in names]), (F.pmod("p_partkey", F.lit(13)) + 1).cast("int")
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(listed, "p_type").alias("language"))


_PARAMS_SQL = """(VALUES ('Python',1000,300,250,1500), ('Rust',1000,250,200,1500), ('Haskell',1200,300,200,2500),
   ('Markdown',2000,500,200,3000), ('C#',1200,300,250,1800), ('TOML',800,200,100,1200), ('HTML',1500,400,200,2200),
   ('C++',800,200,150,1200), ('TSX',1000,300,250,1500), ('CSS',1000,250,150,1500)) p(l,a,b,c,d)"""


@query(
    "chunk_params",
    f"""SELECT p_partkey, language, coalesce(a, 1000)::BIGINT AS chunk_size, coalesce(b, 300)::BIGINT AS min_chunk_size,
               coalesce(c, 200)::BIGINT AS chunk_overlap, coalesce(d, 2000)::BIGINT AS max_chunk_size
        FROM ({_LANG_SQL}) LEFT JOIN {_PARAMS_SQL} ON l = language""",
)
def chunk_params(spark, sf_dir):
    rows = _languages(spark, sf_dir).withColumn("p", languages.chunk_params(F.col("language")))
    return rows.select(
        "p_partkey", "language", *[F.col(f"p.{f}").cast("bigint").alias(f) for f in languages.PARAM_FIELDS]
    )


@query(
    "chunk_params_scaled",
    f"""SELECT language, count(*) AS n, (max(coalesce(a, 1000)) * 30 // 100)::BIGINT AS chunk_size,
               greatest(max(coalesce(d, 2000)) * 30 // 100, 2 * max(coalesce(a, 1000)))::BIGINT AS max_chunk_size
        FROM ({_LANG_SQL}) LEFT JOIN {_PARAMS_SQL} ON l = language GROUP BY language""",
)
def chunk_params_scaled(spark, sf_dir):
    """The scaled sizes as a broadcast dimension (26 rows), joined after counting."""
    counted = _languages(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    dimension = languages.params_table(spark, 30)
    default = languages.scaled_params(30)[catalog.DEFAULT_CHUNK_KEY]
    return counted.join(F.broadcast(dimension), "language", "left").select(
        "language", "n",
        F.coalesce("chunk_size", F.lit(default[0])).cast("bigint").alias("chunk_size"),
        F.coalesce("max_chunk_size", F.lit(default[3])).cast("bigint").alias("max_chunk_size"),
    )


_GROUP_SQL = """CASE WHEN lower(language) IN ('python','java','javascript','php','ruby','go','c','c++')
   THEN 'graphcodebert' WHEN lower(language) IN ('rust','typescript','tsx','c#','kotlin','scala','swift','dart')
   THEN 'unixcoder' ELSE 'fallback' END"""
_MODEL_SQL = """CASE g WHEN 'graphcodebert' THEN 'microsoft/graphcodebert-base'
   WHEN 'unixcoder' THEN 'microsoft/unixcoder-base' ELSE 'sentence-transformers/all-mpnet-base-v2' END"""


@query(
    "model_route",
    f"""SELECT p_partkey, language, g AS model_group, {_MODEL_SQL} AS embedding_model
        FROM (SELECT *, {_GROUP_SQL} AS g FROM ({_LANG_SQL}))""",
)
def model_route(spark, sf_dir):
    group = languages.model_group(F.col("language"))
    return _languages(spark, sf_dir).select(
        "p_partkey", "language", group.alias("model_group"), languages.model_name(group).alias("embedding_model")
    )


@query(
    "model_select",
    f"""SELECT p_partkey, CASE WHEN language IN ('Python', 'C++', 'js') THEN 'microsoft/graphcodebert-base'
          WHEN language IN ('Rust', 'C#', 'Kotlin') THEN 'microsoft/unixcoder-base'
          ELSE 'sentence-transformers/all-mpnet-base-v2' END AS embedding_model FROM ({_LANG_SQL})""",
)
def model_select(spark, sf_dir):
    """The selector that also knows short spellings (js, cpp, rs …)."""
    return _languages(spark, sf_dir).select(
        "p_partkey", languages.select_model(F.col("language")).alias("embedding_model")
    )


@query(
    "language_names",
    f"""SELECT p_partkey, internal, CASE WHEN internal IN ('js') OR internal = lower(language) AND language
               NOT IN ('Python','Rust','Haskell','Markdown','TOML','HTML','Kotlin','TSX','CSS')
               THEN internal ELSE language END AS display, language = 'Haskell' AS haskell
        FROM (SELECT *, CASE language WHEN 'C#' THEN 'c_sharp' WHEN 'C++' THEN 'cpp' ELSE lower(language) END AS internal
              FROM ({_LANG_SQL}))""",
)
def language_names(spark, sf_dir):
    internal = languages.internal_name(F.col("language"))
    return _languages(spark, sf_dir).select(
        "p_partkey", internal.alias("internal"), languages.display_name(internal).alias("display"),
        languages.is_haskell(F.col("language")).alias("haskell"),
    )


@query(
    "method_tags",
    f"""SELECT language, count(*) AS n, CASE WHEN language = 'Haskell' THEN 'haskell_specialized_chunker'
          WHEN language IN ('TOML', 'CSS') THEN 'whole_file' ELSE 'astchunk_library' END AS method
        FROM ({_LANG_SQL}) GROUP BY language""",
)
def method_tags(spark, sf_dir):
    """A chunk without a method of its own takes the file's."""
    lang = F.col("language")
    chunk = (
        F.when(languages.is_haskell(lang), "haskell_specialized_chunker")
        .when(lang.isin("TOML", "CSS"), "unknown_chunking")
        .otherwise("astchunk_library")
    )
    tagged = _languages(spark, sf_dir).withColumn("method", languages.file_method(chunk, F.lit("whole_file")))
    return tagged.groupBy("language", "method").agg(F.count(F.lit(1)).alias("n"))


@query(
    "path_filter",
    f"""SELECT page_id, filename FROM (SELECT page_id, {_PAGE_NAME} || '/index.html' AS filename FROM pages)
        WHERE NOT regexp_matches(filename, '^(.*/)?es(/.*)?$')
          AND NOT regexp_matches(filename, '^fr/1[^/]*(/.*)?$')
          AND NOT regexp_matches(filename, '^(.*/)?[0-9][02468](/.*)?$')""",
)
def path_filter(spark, sf_dir):
    """Include and .gitignore-style exclude patterns over page paths."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.concat(_page_name(), F.lit("/index.html")).alias("filename")
    )
    excludes = globs.gitignore_globs(["# folders", "", "es/", "/fr/1*", "!keep", "[0-9][02468]/"])
    return search.path_filter(pages, ["**/*.html"], excludes)


@query(
    "path_filter_defaults",
    f"""SELECT filename, count(*) AS n FROM ({_NAMES_SQL})
        WHERE regexp_matches(filename, '(^|/)([^/]*\\.(html|cpp|tsx|pyi|kts)|Makefile|Dockerfile|CMakeLists\\.txt|go\\.mod)(/.*)?$')
        GROUP BY filename""",
)
def path_filter_defaults(spark, sf_dir):
    """The default include and exclude lists over all file names."""
    kept = search.path_filter(_file_names(spark, sf_dir), catalog.DEFAULT_INCLUDES, catalog.DEFAULT_EXCLUDES)
    return kept.groupBy("filename").agg(F.count(F.lit(1)).alias("n"))


@query(
    "union_sources",
    """SELECT 'files_0' AS source_name, 'doc_' || doc_id || '.' || lang AS filename, length(text)::BIGINT AS size FROM documents
       UNION ALL SELECT 'files_1', 'page_' || page_id || '.html', length(html) FROM pages
       UNION ALL SELECT 'files_2', 'item_' || item_id || '.txt', length(text) FROM benchmark""",
)
def union_all_sources(spark, sf_dir):
    """Several sources in one relation, each under its own name."""
    parts = [
        document_files(spark, sf_dir).select("filename", "content"),
        table(spark, sf_dir, "pages").select(
            F.concat(F.lit("page_"), "page_id", F.lit(".html")).alias("filename"), F.col("html").alias("content")
        ),
        table(spark, sf_dir, "benchmark").select(
            F.concat(F.lit("item_"), "item_id", F.lit(".txt")).alias("filename"), F.col("text").alias("content")
        ),
    ]
    named = [df.withColumn("source_name", F.lit(f"files_{i}")) for i, df in enumerate(parts)]
    return union_sources(named).select(
        "source_name", "filename", F.length("content").cast("bigint").alias("size")
    )


@query(
    "distinct_languages",
    "SELECT DISTINCT lang AS language FROM documents ORDER BY language",
)
def distinct_languages(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("language"))
    return rows.distinct().orderBy("language")


@query(
    "table_stats",
    """SELECT count(*) AS row_count, count(DISTINCT source) AS sources, count(text) AS texts,
              sum(length(text))::BIGINT AS characters FROM documents""",
)
def table_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.countDistinct("source").alias("sources"),
        F.count("text").alias("texts"),
        F.sum(F.length("text")).cast("bigint").alias("characters"),
    )


@query(
    "file_order",
    f"""SELECT filename, location FROM ({DOCUMENTS_SQL}) ORDER BY filename, location""",
)
def file_order(spark, sf_dir):
    """All rows by file name and location; Spark sorts them by ranges."""
    return document_rows(spark, sf_dir).select("filename", "location").orderBy("filename", "location")
