"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled text.
A text is cut into blocks (all of it, so that a dictionary helps late blocks as much
as the first), each block is compressed with either dictionary, and

    d = (bytes with the bad dictionary - bytes with the good one) / (bytes of text + 64)

becomes a score by logistic calibration on labelled rows that no dictionary has seen.

The fit reads a bounded sample of labelled rows: ``sample_rows`` of each class for the
dictionaries, as many for the calibration, none longer than ``sample_text_bytes``.
Scoring is one pass without a shuffle; only the two dictionaries travel.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm import spans

SAMPLE_ROWS = 1500
SAMPLE_TEXT_BYTES = 16 << 10
DICTIONARY_BYTES = 112 << 10
BLOCK_BYTES = 512
LEVEL = 3


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a NULL id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(0))


@dataclass
class Model:
    good: bytes | None
    bad: bytes | None
    scale: float = 0.0
    shift: float = 0.0

    @cached_property
    def coders(self) -> list:
        made = []
        for content in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(content)
            words.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "coders"}

    def difference(self, text: bytes) -> float:
        if self.good is None or self.bad is None:
            return 0.0
        good, bad = self.coders
        total = 0
        for k in range(0, len(text), BLOCK_BYTES):
            block = text[k : k + BLOCK_BYTES]
            total += len(bad.compress(block)) - len(good.compress(block))
        return total / (len(text) + 64)

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-min(500.0, max(-500.0, self.scale * self.difference(text) + self.shift))))


def _dictionary(texts: list[bytes], size: int) -> bytes | None:
    if not texts:
        return None
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:  # too few or too short for training: their text itself
        return b"\n".join(texts)[-size:] + b"\n"


def _calibrated(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve, by Newton steps with a slight penalty."""
    if not len(labels) or labels.min() == labels.max():
        return 0.0, math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)) if len(labels) else 0.0
    middle, width = values.mean(), values.std() or 1.0
    x = np.column_stack([(values - middle) / width, np.ones(len(values))])
    weights = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        gradient = x.T @ (labels - p) - np.array([1e-2, 0]) * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(curve, gradient)
        weights += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(weights[0] / width), float(weights[1] - weights[0] * middle / width)


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_text_bytes: int = SAMPLE_TEXT_BYTES) -> Model:
    """A model from labelled rows; ``labels`` must hold only rows that may be learned from.

    Rows with a NULL id, label or text are left out.  Without rows of both classes
    every text gets the share of label 1 (one half without any).
    """
    seen = labels.select(F.col(id_column).alias("_id"), F.col(label_column).alias("_label")).dropna().dropDuplicates(["_id"])
    chosen = None
    for label in (0, 1):
        some = seen.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(2 * sample_rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = (
        documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text")).where(F.octet_length("_text") <= sample_text_bytes)
        .join(F.broadcast(chosen), "_id").select("_id", "_label", "_text", F.xxhash64("_id").alias("_order")).toPandas()
    )
    rows = rows.drop_duplicates("_id").sort_values(["_order", "_id"])
    words, rest = {}, []
    for label in (0, 1):
        own = rows[rows["_label"] == label]
        words[label] = [t.encode() for t in own["_text"].iloc[::2]]
        rest.append(own.iloc[1::2])
    model = Model(_dictionary(words[1], DICTIONARY_BYTES), _dictionary(words[0], DICTIONARY_BYTES))
    values = np.array([model.difference(t.encode()) for part in rest for t in part["_text"]])
    kinds = np.array([int(k) for part in rest for k in part["_label"]])
    # The classes were sampled alike; the shift restores their true shares.
    totals = {r["_label"]: r["count"] for r in seen.groupBy("_label").count().collect()}
    model.scale, model.shift = _calibrated(values, kinds)
    if len(set(kinds.tolist())) == 2:
        model.shift += math.log((totals[1] / totals[0]) / ((kinds == 1).sum() / (kinds == 0).sum()))
    return model


def score(documents: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, ``score`` in [0, 1] and ``predicted``; NULL text counts as empty."""
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in spans.row_slices(whole, "text")):
            data, offsets = spans.flat(batch.column(1))
            scores = np.array([shared.value.score(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep(documents: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The rows whose text is predicted to be good, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in spans.row_slices(whole, text_column)):
            data, offsets = spans.flat(batch.column(batch.schema.names.index(text_column)))
            kept = [shared.value.score(data[a:b].tobytes()) >= 0.5 for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
