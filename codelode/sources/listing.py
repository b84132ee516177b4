"""Listing folders in tasks: a frontier of folders is expanded level by level.

Every folder is a row.  A level's folders are dealt out to tasks, which list them and
write what they found; the folders among it are the next frontier.  Nothing but the texts
of .gitignore files comes back to the driver, and a folder that a pattern known by then
excludes is never entered, so neither are the patterns in it read.  Links to folders are
not followed (a link upwards ends nowhere); links to files are files.  Each level is a
written table, so a lost executor costs one task.

Tasks open folders with ``pyarrow.fs``: local or mounted paths, HDFS and object stores.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.session import work_folder
from codelode.sources import globs

FOLDERS_PER_TASK = 32
ENTRIES_AT_ONCE = 10_000
BYTES_PER_TASK = 64 << 20
_ENTRY = pa.schema([("source_name", pa.string()), ("root", pa.string()), ("name", pa.string()), ("folder", pa.bool_()), ("modified", pa.timestamp("us", "UTC")), ("n_bytes", pa.int64()), ("patterns", pa.string())])
_ENTRY_SQL = "source_name string, root string, name string, folder boolean, modified timestamp, n_bytes long, patterns string"
LISTING = ["source_name", "root", "filename", "modified", "n_bytes"]


def opened(place: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if place.startswith("file:"):
        place = re.sub(r"^file:/+", "/", place)
    return (pafs.LocalFileSystem(), place) if place.startswith("/") else pafs.FileSystem.from_uri(place)


def can_open(place: str) -> bool:
    try:
        opened(place)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _entries(place: str) -> Iterator[tuple[str, bool, datetime | None, int | None]]:
    """Name, whether it is a folder, time and size of what lies in one folder; none if it is gone."""
    files, path = opened(place)
    if isinstance(files, pafs.LocalFileSystem):
        try:
            found = os.scandir(path)
        except (FileNotFoundError, NotADirectoryError, PermissionError):
            return
        with found:
            for entry in found:
                try:
                    facts = entry.stat()
                except OSError:  # a link to nowhere, or removed meanwhile
                    continue
                if stat.S_ISDIR(facts.st_mode):
                    if not entry.is_symlink():
                        yield entry.name, True, None, None
                elif stat.S_ISREG(facts.st_mode):
                    yield entry.name, False, datetime.fromtimestamp(facts.st_mtime, timezone.utc), facts.st_size
        return
    for entry in files.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if entry.type == pafs.FileType.Directory:
            yield entry.base_name, True, None, None
        elif entry.type == pafs.FileType.File:
            yield entry.base_name, False, entry.mtime, entry.size


def _content(place: str) -> bytes | None:
    files, path = opened(place)
    try:
        with files.open_input_stream(path) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[dict] = []
        for source, root, folder in zip(*(batch.column(c).to_pylist() for c in ("source_name", "root", "name")), strict=True):
            for own, is_folder, modified, size in _entries(f"{root}/{folder}" if folder else root):
                name = f"{folder}/{own}" if folder else own
                patterns = None
                if own == ".gitignore" and not is_folder:
                    patterns = (_content(f"{root}/{name}") or b"").decode("utf-8", "replace")
                made.append({"source_name": source, "root": root, "name": name, "folder": is_folder, "modified": modified, "n_bytes": size, "patterns": patterns})
                if len(made) >= ENTRIES_AT_ONCE:
                    yield pa.RecordBatch.from_pylist(made, schema=_ENTRY)
                    made = []
        yield pa.RecordBatch.from_pylist(made, schema=_ENTRY)


@dataclass(frozen=True)
class Tree:
    """``files``: source_name, root, filename, modified, n_bytes.  ``ignored``: globs of .gitignore files."""

    files: DataFrame
    ignored: list[str]
    levels: int


def list_tree(spark: SparkSession, roots: dict[str, str], skip: list[str] = (), use_gitignore: bool = True) -> Tree:
    """All files below the roots (source name to path), except in folders that are excluded.

    ``skip`` are globs of folders not to enter.  With ``use_gitignore`` the patterns found
    on the way are added to them, from the level on at which they stand.
    """
    base, level, ignored = work_folder(spark, "listing"), 0, []
    frontier = spark.createDataFrame([(name, root.rstrip("/") or "/", "") for name, root in roots.items()], "source_name string, root string, name string")
    folders, seen = len(roots), []
    while folders:
        tasks = -(-folders // FOLDERS_PER_TASK)
        place = f"{base}/level-{level:04d}"
        frontier.repartition(tasks).mapInArrow(_expand, _ENTRY_SQL).write.parquet(place)
        entries = spark.read.schema(_ENTRY_SQL).parquet(place)
        seen.append(place)
        if use_gitignore:
            texts = entries.filter("patterns IS NOT NULL").select("name", "patterns").orderBy("name").collect()
            ignored += [g for r in texts for g in globs.gitignore_globs(r.patterns.splitlines(), r.name.rpartition("/")[0])]
        frontier = entries.filter("folder").select("source_name", "root", "name")
        excluded = globs.globs_to_regex([*skip, *ignored])
        if excluded:
            frontier = frontier.filter(~F.col("name").rlike(excluded))
        folders = frontier.count()
        level += 1
    files = spark.read.schema(_ENTRY_SQL).parquet(*seen).filter("NOT folder").withColumnRenamed("name", "filename")
    return Tree(files.select(*LISTING), list(dict.fromkeys(ignored)), level)


def with_content(files: DataFrame) -> DataFrame:
    """The listing with ``content``; files are dealt out so that a task reads some ``BYTES_PER_TASK``.

    A file that is gone has NULL.  Where ``content`` is not used nothing is read."""

    @F.arrow_udf("binary")
    def read(places: pa.Array) -> pa.Array:
        return pa.array([_content(p) for p in places.to_pylist()], pa.binary())

    total = files.agg(F.sum("n_bytes")).first()[0] or 0
    dealt = files.repartition(max(1, -(-int(total) // BYTES_PER_TASK)))
    return dealt.withColumn("content", F.make_valid_utf8(read(F.concat("root", F.lit("/"), "filename")).cast("string")))
