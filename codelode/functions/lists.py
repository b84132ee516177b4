"""Arrow lists of numbers and spans as Python lists and back, buffer by buffer.

``to_pylist`` and ``pa.array`` of dicts make an object per value, which took most of the
time of the small helpers that walk a row's arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa


def rows_of(lists: pa.ListArray) -> Iterator[list | None]:
    """Each row's list; None for a NULL row.  Values are numbers or booleans."""
    values = lists.values
    flat = values.to_pylist() if values.null_count or pa.types.is_boolean(values.type) else values.to_numpy().tolist()
    offsets = lists.offsets.to_numpy().tolist()
    for low, high, there in zip(offsets, offsets[1:], lists.is_valid().to_pylist()):
        yield flat[low:high] if there else None


def grouped(rows: list[list | None], flat: pa.Array) -> pa.ListArray:
    """The values of all rows, one after another, as a list per row; None gives NULL."""
    offsets = pa.array(list(accumulate((len(r) if r else 0 for r in rows), initial=0)), pa.int32())
    return pa.ListArray.from_arrays(offsets, flat, mask=pa.array([r is None for r in rows], pa.bool_()))


def lists_of(rows: list[list | None], values: pa.DataType) -> pa.ListArray:
    """A list per row of plain values."""
    return grouped(rows, pa.array(list(chain.from_iterable(r or () for r in rows)), values))


def structs_of(rows: list[list[tuple] | None], fields: list[pa.Field]) -> pa.ListArray:
    """A list per row of structs, given as tuples of the fields' values."""
    columns = list(zip(*chain.from_iterable(r or () for r in rows))) or [()] * len(fields)
    return grouped(rows, pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields))
