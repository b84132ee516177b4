"""BPE encoding and decoding: speculate, verify, merge only what fails.

Texts are encoded in slices inside the task that read them; there is no shuffle.
NULL text counts as empty and has no ids.  Rows with equal or NULL ids stay apart.
Only the id and the text column are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import bytebpe, spans


def text_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Bytes and offsets as an Arrow text column; bytes that are no UTF-8 are replaced."""
    raw = data.tobytes()
    try:
        raw.decode()
    except UnicodeDecodeError:
        return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(raw))


def encode(documents: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: its id, ``ids array<int>`` and ``decoded string``.

    ``tokenizer`` is the path of a byte-level BPE file on every executor.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = bytebpe.load(tokenizer)
        for batch in batches:
            data, offsets = spans.flat(batch.column(1))
            for first, last, part, at in spans.slices(data, offsets):
                ids, cuts = bpe.encode(part, at)
                lengths = np.concatenate([[0], np.cumsum(bpe.token_length[ids])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))),
                        text_array(bpe.decode(ids), lengths[cuts]),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """Number and SHA-256 of the ids, and SHA-256 of the decoded text."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
