"""Keyed upsert, change detection, the chunk store and the index stream."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from codelode.session import work_folder
from codelode.sources import listing, store
from codelode.sources.files import list_files
from codelode.sources.vector_index import VectorIndex
from codelode.streaming import live
from workloads.registry import query
from workloads.views import (
    CHUNKS_SQL, DOCUMENTS_SQL, chunk_rows, document_files, document_rows, query_vector, table,
)


def _flagged(spark, sf_dir, flag: str, value: int):
    labels = table(spark, sf_dir, "labels")
    return labels.filter(F.col(flag) == value).select("doc_id")


@query(
    "upsert_snapshot",
    f"""WITH base AS ({DOCUMENTS_SQL}), updates AS (
          SELECT b.* REPLACE ('new ' || code AS code) FROM base b JOIN labels l USING (doc_id) WHERE quality = 1
          UNION ALL SELECT 1000000000 + item_id, 'item_' || item_id || '.txt', 'line:1#0', 'bench', 'en', text, 1, 1, length(text) FROM benchmark)
        SELECT filename, location, source_name, md5(code) AS hash FROM updates
        UNION ALL SELECT filename, location, source_name, md5(code) FROM base b
        WHERE NOT EXISTS (SELECT 1 FROM updates u WHERE u.filename = b.filename AND u.location = b.location AND u.source_name = b.source_name)""",
)
def upsert_snapshot(spark, sf_dir):
    """Documents with good labels replaced, benchmark items added, by key."""
    base = document_rows(spark, sf_dir)
    changed = base.join(_flagged(spark, sf_dir, "quality", 1), "doc_id", "left_semi").withColumn(
        "code", F.concat(F.lit("new "), "code")
    )
    added = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item_"), "item_id", F.lit(".txt")).alias("filename"),
        F.lit("line:1#0").alias("location"), F.lit("bench").alias("source_name"), F.col("text").alias("code"),
    )
    columns = ["filename", "location", "source_name", "code"]
    updates = changed.select(*columns).unionByName(added)
    merged = store.upsert(base.select(*columns), updates)
    return merged.select("filename", "location", "source_name", F.md5(F.col("code").cast("binary")).alias("hash"))


def _before_after(spark, sf_dir):
    """Two states of the documents: the later one lacks the toxic documents, has
    the good ones rewritten, and has the benchmark items as new files."""
    before = document_files(spark, sf_dir)
    after = (
        before.join(_flagged(spark, sf_dir, "toxic", 1), "doc_id", "left_anti")
        .join(_flagged(spark, sf_dir, "quality", 1).withColumn("good", F.lit(True)), "doc_id", "left")
        .withColumn("content", F.when(F.col("good"), F.concat("content", F.lit("\nmore"))).otherwise(F.col("content")))
    )
    added = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("item_"), "item_id", F.lit(".txt")).alias("filename"),
        F.col("text").alias("content"), F.lit("bench").alias("source_name"), F.lit("en").alias("language"),
    )
    columns = ["filename", "content", "source_name", "language"]
    return before.select(*columns), after.select(*columns).unionByName(added)


_STATES_SQL = """
  SELECT source AS source_name, 'doc_' || doc_id || '.' || lang AS filename, text,
         CASE WHEN coalesce(toxic, 0) = 1 THEN 'removed' WHEN coalesce(quality, 0) = 1 THEN 'changed' ELSE 'unchanged' END AS state
  FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT 'bench', 'item_' || item_id || '.txt', text, 'added' FROM benchmark"""


@query("file_changes", f"SELECT source_name, filename, state FROM ({_STATES_SQL})")
def file_changes(spark, sf_dir):
    """Added, changed, removed and unchanged files between two snapshots."""
    before, after = _before_after(spark, sf_dir)
    return store.changes(store.snapshot(before), store.snapshot(after))


@query(
    "replace_files",
    f"""SELECT source_name, filename, md5(CASE state WHEN 'changed' THEN text || chr(10) || 'more' ELSE text END) AS hash
        FROM ({_STATES_SQL}) WHERE state <> 'removed'""",
)
def replace_files(spark, sf_dir):
    """Whole-file replacement and removal, as one batch job."""
    before, after = _before_after(spark, sf_dir)
    diff = store.changes(store.snapshot(before), store.snapshot(after))
    fresh = after.join(diff.filter(F.col("state").isin("added", "changed")), store.FILE_KEY, "left_semi")
    current = store.replace_files(before, fresh, diff.filter(F.col("state") == "removed"))
    return current.select("source_name", "filename", F.md5(F.col("content").cast("binary")).alias("hash"))


_CURRENT_SQL = """
  SELECT source_name, filename, 'line:' || (k * 180 + 1) || '#' || k AS location, md5(array_to_string(l[k * 180 + 1 : k * 180 + 180], chr(10))) AS hash
  FROM (SELECT source_name, filename, l, unnest(range(0, (len(l) - 1) // 180 + 1)) AS k
        FROM (SELECT source_name, filename, string_split(text, chr(10)) AS l FROM ({})))"""


def _shown(rows):
    return rows.select(
        "source_name", "filename", "location", F.md5(F.col("code").cast("binary")).alias("hash")
    )


@query(
    "store_update",
    _CURRENT_SQL.format(
        f"SELECT source_name, filename, CASE state WHEN 'changed' THEN text || chr(10) || 'more' ELSE text END AS text"
        f" FROM ({_STATES_SQL}) WHERE state <> 'removed'"
    ),
)
def store_update(spark, sf_dir):
    """Index everything, then bring the store to the later state: only changed
    files are indexed again, removed files lose their rows."""
    before, after = _before_after(spark, sf_dir)
    kept = store.ChunkStore(spark, work_folder(spark, "store"))
    live.update(kept, before)
    live.update(kept, after)
    return _shown(kept.table())


@query(
    "stream_index",
    _CURRENT_SQL.format("SELECT source AS source_name, 'doc_' || doc_id || '.' || lang AS filename, text FROM documents"),
)
def stream_index(spark, sf_dir):
    """A stream of documents indexed into a store, one run per micro-batch."""
    schema = table(spark, sf_dir, "documents").schema
    stream = (
        # A pattern, since a stream takes a plain path for a folder: the table is one file or a folder of files.
        spark.readStream.schema(schema).parquet(f"{sf_dir}/documents[.]parquet")
        .select(
            F.concat(F.lit("doc_"), "doc_id", F.lit("."), "lang").alias("filename"),
            F.col("text").alias("content"), F.col("source").alias("source_name"), F.col("lang").alias("language"),
        )
    )
    folder = work_folder(spark, "stream")
    kept = store.ChunkStore(spark, f"{folder}/table")
    live.index_stream(stream, kept, f"{folder}/progress").awaitTermination()
    return _shown(kept.table())


def _write_files(folder: str):
    def run(batches):
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                store_of, path = listing.opened(f"{folder}/{name}")
                store_of.create_dir(path.rpartition("/")[0], recursive=True)
                with store_of.open_output_stream(path) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["written"])

    return run


_SITES_SQL = r"""
  SELECT page_id, html, regexp_extract(url, 'https?://([^/]+)/', 1) AS host, page_id % 7 AS part,
         CASE page_id % 5 WHEN 0 THEN 'drafts' WHEN 1 THEN 'build' ELSE 'docs' END AS folder,
         CASE WHEN page_id % 11 = 0 THEN 'log' ELSE 'html' END AS ext
  FROM pages WHERE url IS NOT NULL AND regexp_matches(url, 'https?://([^/]+)/')"""


def _site_rows(spark, sf_dir):
    """Each page as a file of its host's folder."""
    pages = table(spark, sf_dir, "pages").filter(F.col("url").rlike("https?://([^/]+)/"))
    kind = F.col("page_id") % 5
    folder = F.when(kind == 0, "drafts").when(kind == 1, "build").otherwise("docs")
    host = F.regexp_extract("url", "https?://([^/]+)/", 1)
    name = F.format_string("%s/part%d/%s/page_%d.%s", host, F.col("page_id") % 7, folder, "page_id", F.when(F.col("page_id") % 11 == 0, "log").otherwise("html"))
    return pages.select(host.alias("host"), name.alias("name"), F.coalesce("html", F.lit("")).alias("text"))


@query(
    "listed_tree",
    rf"""WITH sites AS ({_SITES_SQL}), named AS (
          SELECT host || '/part' || part || '/' || folder || '/page_' || page_id || '.' || ext AS filename, strlen(coalesce(html, '')) AS n_bytes,
                 md5(coalesce(html, '')) AS hash, host, folder, part FROM sites WHERE ext = 'html')
        SELECT filename, n_bytes, hash FROM named
        WHERE folder <> 'build' AND NOT (folder = 'drafts' AND length(host) % 2 = 0) AND NOT (part = 3 AND length(host) % 3 = 0)""",
)
def listed_tree(spark, sf_dir):
    """Pages written as a tree of files with .gitignore files in some folders, then listed and
    read level by level: hosts of even length leave out ``drafts``, those of a length
    divisible by three leave out ``part3``, and the top leaves out ``build``."""
    rows = _site_rows(spark, sf_dir)
    hosts = rows.select("host").distinct()
    even = F.when(F.length("host") % 2 == 0, "drafts/\n").otherwise("# nothing\n")
    third = F.when(F.length("host") % 3 == 0, "/part3/\n").otherwise("\n")
    ignores = hosts.select(F.concat("host", F.lit("/.gitignore")).alias("name"), F.concat(even, third).alias("text"))
    top = spark.range(1).select(F.lit(".gitignore").alias("name"), F.lit("build/\n*.log\n").alias("text"))
    folder = work_folder(spark, "tree")
    written = rows.select("name", "text").unionByName(ignores).unionByName(top).mapInArrow(_write_files(folder), "written long")
    written.agg(F.sum("written")).collect()
    found = listing.with_content(list_files(spark, [folder], include=["**/*.html"]))
    return found.select("filename", "n_bytes", F.md5(F.col("content").cast("binary")).alias("hash"))


@query(
    "tracking_state",
    """SELECT source AS source_name, 'doc_' || doc_id || '.' || lang AS filename, CAST(max(k) AS VARCHAR) AS version, max(k) AS run
       FROM documents, range(10) r(k) WHERE doc_id % 10 = k OR (doc_id % 3 = 0 AND (doc_id + 1) % 10 = k)
       GROUP BY doc_id, source, lang HAVING NOT (max(k) = 8 AND doc_id % 2 = 0)""",
)
def tracking_state(spark, sf_dir):
    """Ten runs of file states, each with a tenth of the documents and some of the run
    before; run 8 removes every second of its files.  Read back from merged levels."""
    documents = document_files(spark, sf_dir)
    kept = store.ChunkStore(spark, work_folder(spark, "states"))
    none = spark.createDataFrame([], store.CHUNK_SCHEMA).drop("run")
    for k in range(10):
        mine = documents.filter((F.col("doc_id") % 10 == k) | ((F.col("doc_id") % 3 == 0) & ((F.col("doc_id") + 1) % 10 == k)))
        gone = mine.filter((F.lit(k) == 8) & (F.col("doc_id") % 2 == 0))
        states = mine.join(gone.select(*store.FILE_KEY), store.FILE_KEY, "left_anti")
        kept.write_run(k, none, states.withColumn("version", F.lit(str(k))), gone)
    return kept.manifest().filter("NOT removed").drop("removed")


@query(
    "snapshot_versions",
    "SELECT source AS source_name, 'doc_' || doc_id || '.' || lang AS filename, substr(sha256(text), 1, 16) AS version FROM documents",
)
def snapshot_versions(spark, sf_dir):
    return store.snapshot(document_files(spark, sf_dir))


_SIMILARITY = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))"


@query(
    "vector_topk_indexed",
    f"""SELECT filename, embedding_model, round({_SIMILARITY}, 6) AS score FROM ({CHUNKS_SQL})
        WHERE embedding IS NOT NULL ORDER BY {_SIMILARITY} DESC, filename LIMIT 10""",
)
def vector_topk_indexed(spark, sf_dir):
    """All rows laid out by direction, then searched cell by cell: exact."""
    index = VectorIndex(spark, work_folder(spark, "index"))
    index.build(chunk_rows(spark, sf_dir), cells=16)
    found = index.search(query_vector(spark, sf_dir))
    return found.select("filename", "embedding_model", F.round("score", 6).alias("score"))
