"""Ties sets that have an n-gram in common, without gathering an n-gram's sets.

A task makes the stars of the sets it holds and passes one set of each n-gram on, so a
very common n-gram is shuffled once per slice.  The rows of an n-gram then come sorted,
and each is tied to the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LOCAL_SQL = "key long, gram long, a long, b long"


def local_star(grams: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle from n-grams and the sets they belong to.

    ``b`` is the centre of a finished pair; it is NULL in the one row of an n-gram that
    still has to meet those of other slices.
    """
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    opens = np.diff(grams, prepend=grams[:1] ^ np.uint64(1)) != 0
    centre = owner[np.flatnonzero(opens)[np.cumsum(opens) - 1]]
    key = np.where(opens, grams.view(np.int64), owner)  # finished pairs are dealt by set
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(grams.view(np.int64)), pa.array(owner), pa.array(centre, mask=opens)], ["key", "gram", "a", "b"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, centre = None, 0
    for batch in batches:
        gram, a = batch.column("gram").to_numpy(), batch.column("a").to_numpy()
        if not len(gram):
            continue
        done = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
        b = batch.column("b").fill_null(0).to_numpy().copy()
        at = np.flatnonzero(~done)
        if len(at):
            opens = np.diff(gram[at], prepend=gram[at[:1]] ^ 1) != 0
            opens[0] = last is None or gram[at[0]] != last
            first = np.cumsum(opens) - 1
            centres = a[at[opens]]
            b[at] = np.where(first >= 0, centres[first] if len(centres) else 0, centre)
            last, centre = gram[at[-1]], b[at[-1]]
        pairs = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[pairs]), pa.array(b[pairs]), pa.array(gram[pairs])], ["a", "b", "gram"])


def tie(local: DataFrame) -> DataFrame:
    """(a, b, gram) from the rows of :func:`local_star`."""
    return local.repartition("key").sortWithinPartitions("gram").mapInArrow(_across, "a long, b long, gram long")
