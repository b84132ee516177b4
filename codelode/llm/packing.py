"""Mixture-controlled packing by deficit round-robin.

Documents are dealt by a hash, so every partition holds a like mix of sources, also
where one source has a third of all rows.  Each partition encodes its documents and
writes them as blocks of about ``BLOCK_TOKENS`` tokens, one row per block, to the
shared folder.  Prefix sums over the blocks (per source and in all) give each block
its place in the one stream of tokens and the deficit of each source there:

    deficit = share of the source * tokens before the block - its tokens before the block

So blocks are packed independently, and still deficits and windows carry on from
block to block and from partition to partition.  Within a block every source is a
queue.  For each window of ``window`` tokens each waiting source earns its share;
sources are served in turn from their deficit, in pieces of ``MIN_PIECE`` tokens or
whole documents, and what is left of the window goes to the largest deficits.
All windows are full; only the last one of all is padded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm import bytebpe, spans
from codelode.session import work_folder

BLOCK_TOKENS = 1 << 20
MIN_PIECE = 256
#: Rows of the blocks' carry table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
_DOC = "array<struct<doc_id:{id},source:string,tokens:long>>"


def _blocks(dealt: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    kind = dealt.schema["doc_id"].dataType
    schema = f"part int, seq int, docs {_DOC.format(id=kind.simpleString())}, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(tokenizer)
        part, seq, docs, parts, size = TaskContext.get().partitionId(), 0, [], [], 0
        width = np.uint16 if max(bpe.size, end_id + 1) <= 1 << 16 else np.uint32

        def row() -> pa.RecordBatch:
            arrow = pa.struct([("doc_id", id_type), ("source", pa.string()), ("tokens", pa.int64())])
            values = [[part], [seq], [docs], [np.concatenate(parts).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.list_(arrow), pa.binary()), strict=True)], ["part", "seq", "docs", "ids"])

        for batch in batches:
            id_type = batch.column(0).type
            owner, source = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            data, offsets = spans.flat(batch.column(2))
            for first, last, piece, at in spans.slices(data, offsets):
                ids, cuts = bpe.encode(piece, at)
                for k in range(last - first):
                    own = ids[cuts[k] : cuts[k + 1]]
                    docs.append({"doc_id": owner[first + k], "source": source[first + k], "tokens": len(own) + 1})
                    parts.append(np.append(own, end_id).astype(width))
                    size += len(own) + 1
                    if size >= BLOCK_TOKENS:
                        yield row()
                        seq, docs, parts, size = seq + 1, [], [], 0
        if docs:
            yield row()

    return dealt.mapInArrow(run, schema)


def _carry(blocks: DataFrame, proportions: dict[str | None, float] | None) -> DataFrame:
    """Per block: its place in the stream, and share and deficit of each of its sources."""
    each = blocks.select("part", "seq", F.explode("docs").alias("d")).groupBy("part", "seq", F.col("d.source").alias("source")).agg(F.sum("d.tokens").alias("tokens"))
    by_part = each.groupBy("part", "source").agg(F.sum("tokens").alias("all"))
    rows_before = (Window.unboundedPreceding, -1)
    parts = by_part.withColumn("source_start", F.coalesce(F.sum("all").over(Window.partitionBy("source").orderBy("part").rowsBetween(*rows_before)), F.lit(0)))
    parts = parts.withColumn("source_total", F.sum("all").over(Window.partitionBy("source"))).drop("all")
    # One row per partition of the job, whatever the data: a single small window.
    starts = by_part.groupBy("part").agg(F.sum("all").alias("all")).select(
        "part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(*rows_before)), F.lit(0)).alias("part_start"), F.sum("all").over(Window.partitionBy()).alias("total")
    )
    earlier = F.coalesce(F.sum("tokens").over(Window.partitionBy("part", "source").orderBy("seq").rangeBetween(*rows_before)), F.lit(0))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rangeBetween(*rows_before)), F.lit(0))
    placed = each.select("part", "seq", "source", earlier.alias("earlier"), inside.alias("inside")).alias("e")
    placed = placed.join(parts.alias("p"), (F.col("e.part") == F.col("p.part")) & F.col("e.source").eqNullSafe(F.col("p.source"))).join(starts.alias("s"), F.col("e.part") == F.col("s.part"))
    share = F.col("source_total") / F.col("total")
    if proportions is not None:
        whole = sum(proportions.values()) or 1.0
        share = F.lit(0.0)
        for source, weight in proportions.items():
            share = F.when(F.col("e.source").eqNullSafe(F.lit(source)), weight / whole).otherwise(share)
    place = F.col("part_start") + F.col("inside")
    return placed.select(
        F.col("e.part").alias("part"), "seq", place.alias("place"),
        F.struct(F.col("e.source").alias("source"), share.alias("share"), (share * place - F.col("source_start") - F.col("earlier")).alias("deficit")).alias("q"),
    ).groupBy("part", "seq").agg(F.first("place").alias("place"), F.collect_list("q").alias("queues"))


def _fill(docs: list[dict], queues: list[dict], place: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(document, start, length, place in the stream) of each piece of one block."""
    number = {q["source"]: k for k, q in enumerate(sorted(queues, key=lambda q: (q["source"] is None, q["source"] or "")))}
    share, deficit = [0.0] * len(number), [0.0] * len(number)
    for q in queues:
        share[number[q["source"]]], deficit[number[q["source"]]] = q["share"], q["deficit"]
    waiting: list[deque] = [deque() for _ in number]
    for k, doc in enumerate(docs):
        waiting[number[doc["source"]]].append(k)
    used, turn = [0] * len(docs), 0

    def serve(s: int, most: int) -> tuple[int, int, int, int]:
        doc = waiting[s][0]
        length = min(most, docs[doc]["tokens"] - used[doc])
        piece = (doc, used[doc], length, place)
        used[doc] += length
        deficit[s] -= length
        if used[doc] == docs[doc]["tokens"]:
            waiting[s].popleft()
        return piece

    live = [s for s in range(len(number)) if waiting[s]]
    while live:
        room = window - place % window
        weight = sum(share[s] for s in live)
        for s in live:
            deficit[s] += room * (share[s] / weight if weight else 1 / len(live))
        turn = (turn + 1) % len(live)
        for s in live[turn:] + live[:turn]:
            while room and waiting[s]:
                rest = docs[waiting[s][0]]["tokens"] - used[waiting[s][0]]
                if deficit[s] < min(rest, MIN_PIECE):
                    break
                piece = serve(s, min(room, int(deficit[s])))
                yield piece
                place, room = place + piece[2], room - piece[2]
        while room and (open_ := [s for s in live if waiting[s]]):
            piece = serve(max(open_, key=lambda s: deficit[s]), room)
            yield piece
            place, room = place + piece[2], room - piece[2]
        live = [s for s in live if waiting[s]]


def pack(documents: DataFrame, tokenizer: str, end_id: int, window: int = 2048, proportions: dict[str | None, float] | None = None, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset.

    ``proportions`` are target weights of sources; by default those of the corpus, so
    that all queues end together.  A source without a weight is only taken when no
    other waits.  NULL text is empty and still has its end token; a NULL source is a
    source of its own; rows with equal ids are packed apart; no rows give no pieces.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(source_column).cast("string").alias("source"), F.col(text_column).alias("text"))
    folder = work_folder(spark, "packing")
    _blocks(rows.repartition(F.xxhash64("doc_id", "text")), tokenizer, end_id).write.parquet(folder)
    blocks = spark.read.parquet(folder)
    carry_folder = work_folder(spark, "packing-carry")
    _carry(blocks.select("part", "seq", "docs"), proportions).write.parquet(carry_folder)
    carry = spark.read.parquet(carry_folder)
    if carry.select(F.coalesce(F.sum(F.size("queues")), F.lit(0))).first()[0] <= BROADCAST_ROWS:
        carry = F.broadcast(carry)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                docs, ids, place, queues = (batch.column(c)[k].as_py() for c in ("docs", "ids", "place", "queues"))
                total = sum(d["tokens"] for d in docs)
                stream = np.frombuffer(ids, np.uint16 if len(ids) == 2 * total else np.uint32).astype("<u4")
                first = np.cumsum([0] + [d["tokens"] for d in docs])
                pieces = np.array(list(_fill(docs, queues, place, window)), np.int64).reshape(-1, 4)
                doc, start, length, at = pieces.T
                own = stream[spans.spread_positions(first[doc] + start, length)]
                id_type = batch.schema.field("docs").type.value_type.field("doc_id").type
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[d]["doc_id"] for d in doc.tolist()], id_type), pa.array(start), pa.array(length),
                        pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(length * 4)]).astype(np.int32).tobytes()), pa.py_buffer(own.tobytes())]),
                        pa.array([docs[d]["tokens"] for d in doc.tolist()], pa.int64()), pa.array(at // window), pa.array(at % window),
                    ],
                    ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

    return blocks.join(carry, ["part", "seq"]).mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
