"""File scan: one row per text file of one or several roots."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode import catalog
from codelode.sources import globs, listing


def source_names(paths: list[str]) -> list[str]:
    """``files`` for a single root, ``files_0``, ``files_1`` … for several."""
    return ["files"] if len(paths) == 1 else [f"files_{i}" for i in range(len(paths))]


def _file_system(spark: SparkSession, root: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def full_path(spark: SparkSession, root: str) -> str:
    """A root with scheme and working folder filled in, as Spark lists it."""
    files, place = _file_system(spark, root)
    return files.makeQualified(place).toString().rstrip("/")


def read_gitignores(spark: SparkSession, root: str) -> list[str]:
    """Globs of every .gitignore below a root, in path order.

    Only for stores that ``listing`` cannot open: the driver lists them through the
    Hadoop file system, one glob per folder depth.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files, _ = _file_system(spark, root)
    top = full_path(spark, root)
    found: list[tuple[str, str]] = []
    level = ""
    while len(files.globStatus(path(f"{top}{level}/*")) or []):
        for status in files.globStatus(path(f"{top}{level}/.gitignore")) or []:
            name = status.getPath().toString()
            stream = files.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            found.append((name[len(top) + 1 :].rpartition("/")[0], text))
        level += "/*"
    return [g for folder, text in sorted(found) for g in globs.gitignore_globs(text.splitlines(), folder)]


def relative_path(root: str, path: str = "path"):
    """Path below the root, without scheme and leading slash."""
    bare = F.regexp_replace(F.col(path), r"^[a-z0-9]+:/*(?=/)", "")
    plain_root = re.sub(r"^[a-z0-9]+:/*(?=/)", "", root).rstrip("/") + "/"
    return F.substring(bare, F.lit(len(plain_root) + 1), F.length(bare))


# --- Fixed values: columns of Spark's binary file source ---------------------
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _file_rows(reader, spark, root, source_name, includes, excludes) -> DataFrame:
    reader = reader.format("binaryFile").option("recursiveFileLookup", True)
    name_filter = globs.listing_glob(includes)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    root = full_path(spark, root)
    return (
        reader.load(root)
        .withColumn("filename", relative_path(root))
        .filter(globs.path_matches(F.col("filename"), includes, excludes))
        .select(
            "filename",
            F.make_valid_utf8(F.col("content").cast("string")).alias("content"),
            F.lit(source_name).alias("source_name"),
            F.col("modificationTime").alias("modified"),
            F.col("length").alias("n_bytes"),
        )
    )


def scan_root(
    spark: SparkSession, root: str, source_name: str, includes: list[str], excludes: list[str]
) -> DataFrame:
    """``filename, content, source_name, modified, n_bytes`` of one root."""
    return _file_rows(spark.read, spark, root, source_name, includes, excludes)


def stream_root(
    spark: SparkSession,
    root: str,
    source_name: str = "files",
    includes: list[str] = catalog.DEFAULT_INCLUDES,
    excludes: list[str] = catalog.DEFAULT_EXCLUDES,
    files_per_batch: int = 10_000,
) -> DataFrame:
    """The same rows as a stream of new files, for ``live.index_stream``.

    A file stream does not see removed or rewritten files; ``live.follow`` does.
    """
    reader = spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch)
    return _file_rows(reader, spark, root, source_name, includes, excludes)


def list_files(
    spark: SparkSession,
    paths: list[str],
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    use_gitignore: bool = True,
) -> DataFrame:
    """``source_name, root, filename, modified, n_bytes`` of all matching files of all
    roots, listed in tasks.  Hidden files are seen too."""
    roots = {name: full_path(spark, path) for path, name in zip(paths, source_names(paths))}
    skip = globs.gitignore_globs(exclude or [])
    if not use_gitignore:
        skip = [*catalog.DEFAULT_EXCLUDES, *skip]
    tree = listing.list_tree(spark, roots, skip, use_gitignore)
    includes, excludes = globs.choose_patterns(
        catalog.DEFAULT_INCLUDES, catalog.DEFAULT_EXCLUDES, tree.ignored, include, exclude, use_gitignore
    )
    return tree.files.filter(globs.path_matches(F.col("filename"), includes, excludes))


def scan(
    spark: SparkSession,
    paths: list[str],
    include: list[str] | None = None,
    exclude: list[str] | None = None,
    use_gitignore: bool = True,
) -> DataFrame:
    """All matching files of all roots as one relation, with their content.

    Roots in a store that only Spark's readers open are listed by Spark instead, on the
    driver and without hidden files.
    """
    if all(listing.can_open(full_path(spark, p)) for p in paths):
        found = list_files(spark, paths, include, exclude, use_gitignore)
        return listing.with_content(found).select("filename", "content", "source_name", "modified", "n_bytes")
    ignored = [g for p in paths for g in read_gitignores(spark, p)] if use_gitignore else []
    includes, excludes = globs.choose_patterns(
        catalog.DEFAULT_INCLUDES, catalog.DEFAULT_EXCLUDES, ignored, include, exclude, use_gitignore
    )
    parts = [
        scan_root(spark, path, name, includes, excludes)
        for path, name in zip(paths, source_names(paths))
    ]
    return union_sources(parts)


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Several sources as one relation, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
