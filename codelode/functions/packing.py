"""Small sequential helpers over one row's arrays of numbers or names.

They see sizes and flags, never the text: cutting and joining the text stays in
Spark expressions.  Greedy packing depends on every earlier decision in the
same file, which array functions can only express with quadratic copying.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.functions.lists import lists_of, rows_of, structs_of

_SPANS = "array<struct<first:int,last:int,start:int,end:int>>"
_SPAN_FIELDS = [pa.field(n, pa.int32()) for n in ("first", "last", "start", "end")]


def _pack(sizes, levels, breaks, limit, least, overlap, every):
    """Greedy cuts over one file's segments, as (first, last, start, end).

    A chunk grows until the next segment would exceed ``limit``.  It is then cut
    before the strongest separator that leaves at least ``least`` in the chunk,
    the latest one on a tie, or right here if there is none.  With ``every`` each
    separator starts a chunk.  A new chunk reaches back up to ``overlap``.
    """
    spans, first, size, fresh = [], 0, 0, 0
    line_of = [1]
    for b in breaks:
        line_of.append(line_of[-1] + b)

    def emit(stop):
        spans.append((first + 1, stop, line_of[first], line_of[stop - 1]))

    i = 0
    while i < len(sizes):
        full = size + sizes[i] > limit
        if i > fresh and (full or (every and levels[i])):
            cut = i
            if full and not every:
                before, best = 0, 0
                for j in range(first, i + 1):
                    if j > fresh and before >= least and levels[j] and levels[j] >= best:
                        cut, best = j, levels[j]
                    before += sizes[j]
            emit(cut)
            first, reach = cut, 0
            room = min(overlap, limit - sizes[cut])
            while first > spans[-1][0] and reach + sizes[first - 1] <= room:
                first -= 1
                reach += sizes[first]
            fresh, i = cut, cut
            size = reach
        size += sizes[i]
        i += 1
    if fresh < len(sizes):
        emit(len(sizes))
    return spans


def _pack_rows(
    sizes: pa.Array, levels: pa.Array, breaks: pa.Array,
    limit: pa.Array, least: pa.Array, overlap: pa.Array, every: pa.Array,
) -> pa.Array:
    rows = zip(*(rows_of(c) for c in (sizes, levels, breaks)), *(c.to_pylist() for c in (limit, least, overlap, every)))
    return structs_of([None if r[0] is None else _pack(*r) for r in rows], _SPAN_FIELDS)


def pack(sizes, levels, breaks, limit, least, overlap, every) -> Column:
    """Chunk spans of one file: 1-based segments ``first..last`` and the lines
    ``start..end`` they cover."""
    return F.arrow_udf(_pack_rows, _SPANS)(
        sizes, levels, breaks, limit.cast("int"), least.cast("int"), overlap.cast("int"), every
    )


def merge_runs(sizes: Column, starts: Column, ends: Column, categories: Column, limit: Column) -> Column:
    """Greedy runs of touching neighbours of one category.

    A run takes the next item while both are of one category, the next begins
    where the run ends, and the joined length (one line break per join, which
    counts towards later joins) stays within ``limit``.
    """
    merge = F.arrow_udf(_merge_rows, "array<struct<first:int,last:int>>")
    return merge(sizes, starts, ends, categories, limit)


def _merge_rows(
    sizes: pa.Array, starts: pa.Array, ends: pa.Array, categories: pa.Array, limit: pa.Array
) -> pa.Array:
    out = []
    for size, start, end, kind, most in zip(*map(rows_of, (sizes, starts, ends)), categories.to_pylist(), limit.to_pylist()):
        if size is None:
            out.append(None)
            continue
        runs, length = [], 0
        for i in range(len(size)):
            joined = length + size[i]
            if runs and joined <= most and kind[i] == kind[i - 1] and end[i - 1] == start[i]:
                runs[-1] = (runs[-1][0], i + 1)
                length = joined + 1
            else:
                runs.append((i + 1, i + 1))
                length = size[i]
        out.append(runs)
    return structs_of(out, _SPAN_FIELDS[:2])


def unique_names(names: Column, joiner: str = "#") -> Column:
    """A file's names made distinct: the first keeps its name, later ones get
    ``name#1``, ``name#2`` … skipping names that are already taken."""

    @F.arrow_udf("array<string>")
    def rename(lists: pa.Array) -> pa.Array:
        out = []
        for row in lists.to_pylist():
            taken, last, fresh = set(), {}, []
            for name in row or []:
                new, n = name, last.get(name, 0)
                while new in taken:
                    n += 1
                    new = f"{name}{joiner}{n}"
                last[name] = n
                taken.add(new)
                fresh.append(new)
            out.append(fresh if row is not None else None)
        return pa.array(out, pa.list_(pa.string()))

    return rename(names)


def running_totals(sizes: Column) -> Column:
    """Sums of the first 1, 2, 3 … numbers of a row's list, in linear time."""

    def sums(lists: pa.Array) -> pa.Array:
        return lists_of([None if row is None else list(accumulate(row)) for row in rows_of(lists)], pa.int64())

    return F.arrow_udf(sums, "array<bigint>")(sizes)
