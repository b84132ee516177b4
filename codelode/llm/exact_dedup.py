"""Exact dedup: full byte strings in Patricia tries, by partitions of length and content hash.

1. Each task puts the normalised texts of a slice into a trie and passes one row
   per distinct text on, so a text with very many copies is shuffled once per
   slice at most.
2. Rows are partitioned by (length, content hash) and sorted by it.  A reducer
   inserts the full byte strings into a trie; a terminal node keeps the smallest
   id and the number of rows.  The sort spills, and as rows with another length
   or hash belong to another subtree, finished subtrees leave memory as soon as
   the trie is larger than ``subtree_bytes``.
3. Documents find their owner by SHA-256 in a join on narrow rows; that join can
   be split by Spark where one text holds a large part of all rows.

Equal hashes never make texts equal: only the bytes in the trie do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm import tables
from codelode.llm.radix import RadixTrie

SUBTREE_BYTES = 32 << 20
LOCAL_BYTES = 8 << 20
_OWNERS = pa.schema([("n_bytes", pa.int64()), ("content_hash", pa.int64()), ("text", pa.binary()), ("text_sha256", pa.string()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("keep_rows", pa.int64())])
_OWNERS_SQL = "n_bytes long, content_hash long, text binary, text_sha256 string, keep_id long, group_size long, keep_rows long"


def normalised(text: Column) -> Column:
    """Each run of white space becomes one blank; NULL becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class _Owner:
    __slots__ = ("row", "keep_id", "rows", "keep_rows")

    def __init__(self, row: tuple):
        self.row, self.keep_id, self.rows, self.keep_rows = row, None, 0, 0

    def add(self, keep_id: int | None, rows: int, keep_rows: int) -> None:
        self.rows += rows
        if keep_id is not None and (self.keep_id is None or keep_id < self.keep_id):
            self.keep_id, self.keep_rows = keep_id, 0
        if keep_id == self.keep_id:
            self.keep_rows += keep_rows


def _merge(subtree_bytes: int, with_text: bool):
    """Rows with the same bytes become one; a run of equal (length, hash) stays in one trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = RadixTrie(), None

        def flush() -> Iterator[pa.RecordBatch]:
            found = list(trie.owners())
            columns = [[o.row[0] for o in found], [o.row[1] for o in found], [o.row[2] if with_text else None for o in found], [o.row[3] for o in found], [o.keep_id for o in found], [o.rows for o in found], [o.keep_rows for o in found]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OWNERS, strict=True)], schema=_OWNERS)

        for batch in batches:
            names = batch.schema.names
            for row in zip(*(batch.column(names.index(c)).to_pylist() for c in _OWNERS.names), strict=True):
                if trie.stored > subtree_bytes and (with_text or row[:2] != last):
                    yield from flush()
                    trie = RadixTrie()
                node = trie.at(row[2])
                if node.owner is None:
                    node.owner = _Owner(row)
                node.owner.add(*row[4:])
                last = row[:2]
        yield from flush()

    return run


def exact_dedup(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", content_hash: Column | None = None, subtree_bytes: int = SUBTREE_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, keep_rows.

    ``keep_id`` is the smallest id among the rows of equal text.  ``keep_rows`` is the
    number of rows that carry it: over 1 only where whole ids repeat, and then all of
    them are ``kept`` (see :func:`deduplicated`).  A NULL id never owns a text unless all
    its rows have NULL; such rows are kept then.  No rows give no rows.
    """
    text = normalised(F.col(text_column))
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.select("doc_id", F.sha2("text", 256).alias("text_sha256"))
    hashed = F.xxhash64("text") if content_hash is None else content_hash
    strings = rows.select(
        F.octet_length("text").cast("long").alias("n_bytes"), hashed.cast("long").alias("content_hash"), F.encode("text", "UTF-8").alias("text"),
        F.sha2("text", 256).alias("text_sha256"), F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(1).cast("long").alias("keep_rows"),
    )
    local = strings.mapInArrow(_merge(LOCAL_BYTES, True), _OWNERS_SQL)
    dealt = local.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    owners = dealt.mapInArrow(_merge(subtree_bytes, False), _OWNERS_SQL).select("text_sha256", "keep_id", "group_size", "keep_rows")
    return keyed.join(owners, "text_sha256").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "keep_rows")


def deduplicated(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, one for each text, with their own columns.

    Where rows repeat with id and text, one of them stays.
    """
    verdict = tables.kept(exact_dedup(documents, id_column, text_column), "exact-dedup")
    keyed = documents.withColumn("_own", F.sha2(normalised(F.col(text_column)), 256))

    def among(rows: DataFrame, how: str) -> DataFrame:
        ids = rows.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
        return keyed.join(ids, keyed[id_column].cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_sha")), how)

    repeated = verdict.where("kept AND keep_rows > 1")
    if repeated.isEmpty():
        return among(verdict.where("NOT kept"), "left_anti").select(*documents.columns)
    single = among(verdict.where("NOT kept OR keep_rows > 1"), "left_anti")
    return single.unionByName(among(repeated, "left_semi").dropDuplicates([id_column, "_own"])).select(*documents.columns)
