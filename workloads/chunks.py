"""Chunkers, locations, overlap, merging and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelode import catalog
from codelode.functions import languages, text
from codelode.functions.let import unnest
from codelode.functions.packing import running_totals
from codelode.operators import chunking, layout, ordered
from codelode.plans.index_flow import IndexConfig, index_files
from workloads.registry import query
from workloads.views import SOURCES_SQL, document_files, source_files, table


def _fixed_sql(source: str, key: str, content: str, n: int) -> str:
    return f"""
      SELECT {key}, content, 'line:' || start || '#' || (row_number() OVER (PARTITION BY {key} ORDER BY start) - 1) AS location,
             start, "end" FROM (
        SELECT {key}, array_to_string(l[k * {n} + 1 : k * {n} + {n}], chr(10)) AS content,
               (k * {n} + 1)::BIGINT AS start, least(k * {n} + {n}, len(l))::BIGINT AS "end"
        FROM (SELECT {key}, l, unnest(range(0, (len(l) - 1) // {n} + 1)) AS k
              FROM (SELECT {key}, string_split({content}, chr(10)) AS l FROM {source})))
      WHERE regexp_matches(content, '\\S')"""


@query(
    "chunk_fixed_lines",
    f"SELECT filename, location, start, \"end\", content FROM ({_fixed_sql(f'({SOURCES_SQL})', 'filename', 'content', 180)})",
)
def chunk_fixed_lines(spark, sf_dir):
    """Blocks of 180 lines of every source file."""
    files = source_files(spark, sf_dir)
    return unnest(files, ["filename"], chunking.fixed_lines(F.col("content"))).select(
        "filename", "location", "start", "end", "content"
    )


@query(
    "chunk_fixed_small",
    f"SELECT doc_id, location, start, \"end\", length(content)::BIGINT AS size FROM ({_fixed_sql('documents', 'doc_id', 'text', 3)})",
)
def chunk_fixed_small(spark, sf_dir):
    """Blocks of three lines of every document."""
    files = document_files(spark, sf_dir)
    return unnest(files, ["doc_id"], chunking.fixed_lines(F.col("content"), 3)).select(
        "doc_id", "location", "start", "end", F.length("content").cast("bigint").alias("size")
    )


@query(
    "chunk_overlap",
    """SELECT doc_id, start, sha256(array_to_string(list_concat(list_concat(
             CASE WHEN start > 1 THEN l[greatest(start - 2, 1) : start - 1] ELSE [] END, l[start : "end"]),
             l["end" + 1 : "end" + 2]), chr(10))) AS hash
       FROM (SELECT doc_id, l, k * 5 + 1 AS start, least(k * 5 + 5, len(l)) AS "end"
             FROM (SELECT doc_id, l, unnest(range(0, (len(l) - 1) // 5 + 1)) AS k
                   FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)))""",
)
def chunk_overlap(spark, sf_dir):
    """Blocks of five lines with two lines of their neighbours."""
    files = document_files(spark, sf_dir).withColumn("chunks", chunking.fixed_lines(F.col("content"), 5))
    wide = unnest(files, ["doc_id"], chunking.with_overlap(F.col("chunks"), text.lines("content"), 2))
    return wide.select("doc_id", "start", F.sha2(F.col("content").cast("binary"), 256).alias("hash"))


@query(
    "chunk_header",
    f"""SELECT filename, start, '-- File: ' || filename || ' | Lines: ' || start || '-' || "end"
             || ' | Node type: block | Method: ast_fallback_unavailable' AS head
        FROM ({_fixed_sql(f'({SOURCES_SQL})', 'filename', 'content', 100)})""",
)
def chunk_header(spark, sf_dir):
    """The line that says where a chunk comes from."""
    rows = unnest(source_files(spark, sf_dir), ["filename"], chunking.fixed_lines(F.col("content"), 100))
    headed = chunking.with_header(
        F.col("content"), F.col("filename"), F.col("start"), F.col("end"), F.lit("block"), F.col("chunking_method")
    )
    return rows.select("filename", "start", F.substring_index(headed, "\n", 1).alias("head"))


@query(
    "chunk_structural",
    f"""SELECT filename, len(string_split(content, chr(10)))::BIGINT - 1 AS lines, length(content)::BIGINT AS characters,
               0::BIGINT AS too_wide
        FROM ({SOURCES_SQL}) WHERE language IN ('Python', 'Java', 'TypeScript', 'JavaScript', 'Haskell')""",
)
def chunk_structural(spark, sf_dir):
    """Chunks cut at definitions cover their whole file within the budget."""
    files = source_files(spark, sf_dir).filter(
        F.col("language").isin("Python", "Java", "TypeScript", "JavaScript", "Haskell")
    )
    return chunking.chunk_arrays(files).select(
        "filename",
        F.expr("aggregate(chunks, 0L, (n, c) -> n + c.end - c.start + 1)").alias("lines"),
        F.expr("aggregate(chunks, 0L, (n, c) -> n + length(c.content) + 1)").alias("characters"),
        F.expr(f"cast(size(filter(chunks, c -> length(c.content) > {catalog.STRUCTURAL_BUDGET})) AS bigint)").alias("too_wide"),
    )


@query(
    "chunk_default_split",
    f"""SELECT filename, 1::BIGINT AS first_line, len(string_split(content, chr(10)))::BIGINT - 1 AS last_line,
               0::BIGINT AS too_wide, 0::BIGINT AS holes FROM ({SOURCES_SQL})""",
)
def chunk_default_split(spark, sf_dir):
    """The sized splitter: chunks may overlap, leave no line out, keep the size."""
    rows = chunking.chunk_arrays(source_files(spark, sf_dir), default_chunking=True)
    limited = rows.withColumn("widest", languages.chunk_params(F.col("language"))["chunk_size"])
    return limited.select(
        "filename",
        F.col("chunks")[0]["start"].alias("first_line"),
        F.expr("array_max(transform(chunks, c -> c.end))").alias("last_line"),
        F.expr("cast(size(filter(chunks, c -> length(c.content) > widest)) AS bigint)").alias("too_wide"),
        F.expr(
            "cast(size(filter(chunks, (c, i) -> i > 0 AND c.start > element_at(chunks, i).end + 1)) AS bigint)"
        ).alias("holes"),
    )


@query(
    "chunk_haskell_regex",
    f"""SELECT filename, len(string_split(content, chr(10)))::BIGINT - 1 AS lines, length(content)::BIGINT AS characters,
               0::BIGINT AS too_wide FROM ({SOURCES_SQL}) WHERE language = 'Haskell'""",
)
def chunk_haskell_regex(spark, sf_dir):
    """A chunk per declaration-like line; blank pieces between them count as covered."""
    files = source_files(spark, sf_dir).filter(F.col("language") == "Haskell")
    rows = chunking.haskell_regex_chunks(files)
    totals = files.select(
        "filename", (text.line_count("content") - 1).alias("all_lines"), F.length("content").cast("bigint").alias("size")
    )
    kept = rows.groupBy("filename").agg(
        F.sum(F.col("end") - F.col("start") + 1).alias("l"), F.sum(F.length("chunk_content") + 1).alias("c"),
        F.count_if(text.solid_size("chunk_content") > catalog.HASKELL_MAX).alias("too_wide"),
    )
    # Pieces left out hold blank lines only: one line break per line.
    return kept.join(totals, "filename").select(
        "filename",
        F.col("all_lines").alias("lines"),
        (F.col("c") + (F.col("all_lines") - F.col("l"))).cast("bigint").alias("characters"),
        "too_wide",
    )


@query(
    "unique_locations",
    """SELECT doc_id, source, CASE WHEN n = 1 THEN lang ELSE lang || '#' || (n - 1) END AS location
       FROM (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)""",
)
def unique_locations(spark, sf_dir):
    """Equal locations within a source numbered in document order."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("location"))
    return ordered.unique_locations(rows, ["source"], "location", "doc_id", span=1000)


@query(
    "unique_locations_in_file",
    """SELECT doc_id, array_to_string(list_sort(list(CASE WHEN n = 1 THEN w ELSE w || '_dup' || (n - 1) END)), ' ') AS names
       FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id, w ORDER BY i) AS n
             FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i
                   FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: 'size:' || length(x)) AS l FROM documents)))
       GROUP BY doc_id""",
)
def unique_locations_in_file(spark, sf_dir):
    """Names repeated inside one file numbered within the file's own row."""
    named = F.transform(
        text.lines("content"),
        lambda x: F.struct(x.alias("content"), F.concat(F.lit("size:"), F.length(x)).alias("location")),
    )
    files = document_files(spark, sf_dir).withColumn("chunks", named)
    unique = chunking.with_unique_locations(files, "chunks", "_dup")
    return unique.select("doc_id", F.array_join(F.array_sort("chunks.location"), " ").alias("names"))


# Lines with their line break as character ranges; capital first letters mark
# one category, everything else the other.
_LINES_SQL = """
  SELECT doc_id, i, x, CASE WHEN regexp_matches(x, '^[A-Z]') THEN 'capital' ELSE 'other' END AS category,
         coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS "end"
  FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def _line_chunks(spark, sf_dir):
    """Each document's lines as an array of ranges in the document's row."""
    rows = document_files(spark, sf_dir).select("doc_id", text.lines("content").alias("rows"))
    placed = rows.withColumn(
        "ends", running_totals(F.transform("rows", lambda x: (F.length(x) + 1).cast("bigint")))
    )
    chunks = F.zip_with(
        "rows",
        "ends",
        lambda x, e: F.struct(
            x.alias("content"),
            (e - F.length(x) - 1).alias("start"),
            e.alias("end"),
            F.when(x.rlike("^[A-Z]"), "capital").otherwise("other").alias("category"),
        ),
    )
    return placed.select("doc_id", chunks.alias("chunks"))


@query(
    "merge_adjacent",
    f"""WITH RECURSIVE lines AS MATERIALIZED (SELECT doc_id, i, length(x) AS size, category, start, "end" FROM ({_LINES_SQL})),
        walk AS (
          SELECT doc_id, i, 1 AS run, size, category, start, "end" FROM lines WHERE i = 1
          UNION ALL
          SELECT l.doc_id, l.i,
                 CASE WHEN w.size + l.size <= 600 AND w.category = l.category THEN w.run ELSE w.run + 1 END,
                 CASE WHEN w.size + l.size <= 600 AND w.category = l.category THEN w.size + 1 + l.size ELSE l.size END,
                 l.category, l.start, l."end"
          FROM walk w JOIN lines l ON l.doc_id = w.doc_id AND l.i = w.i + 1)
        SELECT doc_id, min(start)::BIGINT AS start, max("end")::BIGINT AS "end", max(size)::BIGINT AS size, any_value(category) AS category
        FROM walk GROUP BY doc_id, run""",
)
def merge_adjacent(spark, sf_dir):
    """Touching lines of one category merged up to 600 characters."""
    merged = chunking.merge_adjacent(_line_chunks(spark, sf_dir), "chunks", 600)
    return unnest(merged, ["doc_id"], "chunks").select(
        "doc_id", "start", "end", F.length("content").cast("bigint").alias("size"), "category"
    )


@query(
    "coverage_gaps",
    f"""WITH lines AS (SELECT * FROM ({_LINES_SQL})),
        points AS (
          SELECT doc_id, start AS s, "end" AS e FROM lines WHERE category = 'capital'
          UNION ALL SELECT doc_id, 0, 0 FROM documents
          UNION ALL SELECT doc_id, length(text) + 1, length(text) + 1 FROM documents)
        SELECT doc_id, reach::BIGINT AS gap_start, s::BIGINT AS gap_end FROM (
          SELECT doc_id, s, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM points) WHERE reach < s""",
)
def coverage_gaps(spark, sf_dir):
    """Parts of each document that no line with a capital covers."""
    lines = unnest(_line_chunks(spark, sf_dir), ["doc_id"], "chunks")
    covered = lines.filter(F.col("category") == "capital").select("doc_id", "start", "end")
    bounds = document_files(spark, sf_dir).select(
        "doc_id", F.lit(0).cast("bigint").alias("start"), (F.length("content") + 1).cast("bigint").alias("end")
    )
    return ordered.uncovered_ranges(covered, bounds, ["doc_id"], span=2000)


@query(
    "index_documents",
    f"""SELECT filename, location, start, "end", length(content)::BIGINT AS char_count, sha256(content) AS hash,
               'ast_fallback_unavailable' AS chunking_method, 'default_basic' AS analysis_method,
               'sentence-transformers/all-mpnet-base-v2' AS embedding_model, 768::BIGINT AS dimensions, 46::BIGINT AS columns
        FROM ({_fixed_sql("(SELECT 'doc_' || doc_id || '.' || lang AS filename, text FROM documents)", 'filename', 'text', 180)})""",
)
def index_documents(spark, sf_dir):
    """The whole indexing plan over all documents: every chunk-table row."""
    rows = index_files(document_files(spark, sf_dir))
    return rows.select(
        "filename", "location", "start", "end", "char_count", F.sha2(F.col("code").cast("binary"), 256).alias("hash"),
        "chunking_method", "analysis_method", "embedding_model",
        F.size("embedding").cast("bigint").alias("dimensions"), F.lit(len(rows.columns)).cast("bigint").alias("columns"),
    )


@query(
    "index_sources",
    f"""SELECT language, count(*) AS files, sum(length(regexp_replace(content, '[ \\n\\t]', '', 'g')))::BIGINT AS solid,
          CASE WHEN language IN ('Python', 'C', 'C++', 'Java', 'JavaScript') THEN 'microsoft/graphcodebert-base'
               WHEN language IN ('Rust', 'Kotlin', 'TypeScript') THEN 'microsoft/unixcoder-base'
               ELSE 'sentence-transformers/all-mpnet-base-v2' END AS embedding_model,
          0::BIGINT AS without_vector
        FROM ({SOURCES_SQL}) GROUP BY language""",
)
def index_sources(spark, sf_dir):
    """The indexing plan over all source files: no file and no text is lost."""
    rows = index_files(source_files(spark, sf_dir), IndexConfig())
    per_file = rows.groupBy("language", "embedding_model", "filename").agg(
        F.sum(text.solid_size("code")).alias("solid"),
        F.count_if(F.col("embedding").isNull()).alias("without_vector"),
    )
    return per_file.groupBy("language", "embedding_model").agg(
        F.count(F.lit(1)).alias("files"), F.sum("solid").alias("solid"), F.sum("without_vector").alias("without_vector")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _layout_sql() -> str:
    kinds = " ".join(f"WHEN regexp_matches(line, {_quoted(p)}) THEN {n}" for n, _, p in layout.FORMS)
    names = " ".join(f"WHEN {n} THEN '{c}'" for n, c in {n: c for n, c, _ in layout.FORMS}.items())
    return f"""
      WITH files AS (SELECT filename, content FROM ({SOURCES_SQL}) WHERE language = 'Haskell'
                     UNION ALL SELECT 'doc_' || doc_id, text FROM documents WHERE text IS NOT NULL),
      lines AS (SELECT filename, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT filename, string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, -1) ELSE content END, chr(10)) AS l FROM files)),
      inked AS (SELECT filename, i, line, length(replace(regexp_extract(line, '^[ \\t]*'), chr(9), '        ')) AS indent FROM lines WHERE NOT regexp_matches(line, '^\\s*$')),
      least AS (SELECT *, coalesce(min(indent) OVER (PARTITION BY filename ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), indent) AS before FROM inked),
      tops AS (SELECT filename, i, CASE WHEN indent > 0 THEN 0 {kinds} ELSE 0 END AS kind, regexp_extract(line, {_quoted(layout.NAME)}, 1) AS name FROM least WHERE indent <= before),
      parts AS (SELECT *, lag(kind) OVER w AS k, lag(name) OVER w AS n FROM tops WINDOW w AS (PARTITION BY filename ORDER BY i)),
      opens AS (SELECT *, NOT coalesce((k IN (2, 3) AND kind IN (2, 3) AND n = name) OR (k = 1 AND kind <> 0) OR (k = 0 AND kind = 0), false) AS opens FROM parts),
      placed AS (SELECT l.filename, l.i, l.line, o.kind, greatest(1, coalesce(sum(o.opens::INT) OVER (PARTITION BY l.filename ORDER BY l.i), 0)) AS chunk
                 FROM lines l LEFT JOIN opens o ON o.filename = l.filename AND o.i = l.i)
      SELECT filename, min(i) AS start, max(i) AS "end", CASE arg_max(kind, i) {names} END AS category, md5(string_agg(line, chr(10) ORDER BY i)) AS hash
      FROM placed GROUP BY filename, chunk HAVING count(kind) > 0"""


@query("haskell_layout", _layout_sql())
def haskell_layout(spark, sf_dir):
    """Exact cuts at declarations and recovery chunks, of Haskell files and of plain text
    read as (badly damaged) Haskell; no size limit, so that SQL can state the cuts."""
    sources = source_files(spark, sf_dir).filter(F.col("language") == "Haskell").select("filename", "content")
    texts = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.concat(F.lit("doc_"), "doc_id").alias("filename"), F.col("text").alias("content"))
    cut = layout.layout_chunks(sources.unionByName(texts), chunking.HASKELL, limit=2_000_000_000, least=0)
    rows = cut.select("filename", F.explode_outer("chunks").alias("c")).filter("c IS NOT NULL")
    return rows.select("filename", "c.start", "c.end", "c.category", F.md5(F.col("c.content").cast("binary")).alias("hash"))
