"""Offside-rule spans of indented text, from numbers alone.

A small helper over one row's arrays: it sees the indentation, size, kind and name number
of each line, never the text.  A line opens a node that reaches to the next line indented
no deeper; the stack of open nodes gives that in one pass.
"""

from __future__ import annotations

from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from codelode.functions.lists import rows_of, structs_of

_SQL = "array<struct<first:int,last:int,kind:int,start:int,end:int>>"
_FIELDS = [pa.field(n, pa.int32()) for n in ("first", "last", "kind", "start", "end")]
LOST, COMMENT, SIGNATURE, FUNCTION = 0, 1, 2, 3


def _ends(indents: list[int]) -> list[int]:
    """For each line the next one indented no deeper; blank lines (-1) belong to what is above."""
    ends, open_lines = [len(indents)] * len(indents), []
    for k, indent in enumerate(indents):
        if indent >= 0:
            while open_lines and indents[open_lines[-1]] >= indent:
                ends[open_lines.pop()] = k
            open_lines.append(k)
    return ends


def spans(indents: list[int], sizes: list[int], kinds: list[int], names: list[int], limit: int, least: int) -> list[tuple[int, int, int]]:
    """(first line, line after the last, kind) of chunks that cover every line once.

    Clauses of one name and comments before a declaration are one declaration.  One larger
    than ``limit`` is cut at its nested nodes, which are joined again while they fit; lines
    at the margin that begin nothing known are recovery chunks.  Neighbours of one kind, one
    of them under ``least``, are joined while they fit.
    """
    ends, total = _ends(indents), [0, *accumulate(sizes)]
    top = [k for k, indent in enumerate(indents) if indent >= 0][:1]
    while top and ends[top[-1]] < len(indents):
        top.append(ends[top[-1]])
    if not top:
        return []
    groups: list[list] = []  # first line, kind, name, lines at which its parts begin
    for k in top:
        kind, name = (kinds[k], names[k]) if indents[k] == 0 else (LOST, 0)
        last = groups[-1] if groups else None
        clause = last and kind in (SIGNATURE, FUNCTION) and last[1] in (SIGNATURE, FUNCTION) and last[2] == name
        if last and (clause or (last[1] == COMMENT and kind != LOST) or (last[1] == kind == LOST)):
            last[1], last[2] = FUNCTION if clause else kind, name
            last[3].append(k)
        else:
            groups.append([k, kind, name, [k]])
    groups[0][0] = groups[0][3][0] = 0
    found: list[tuple[int, int, int]] = []
    for (first, kind, _, parts), after in zip(groups, [g[0] for g in groups[1:]] + [len(indents)]):
        pieces, todo = [], [(first, after, parts)]
        while todo:
            low, high, inner = todo.pop()
            if total[high] - total[low] <= limit:
                pieces.append((low, high))
                continue
            cuts = list(inner)
            if len(cuts) < 2:  # the head, then what is nested in it
                at = next((j for j in range(low + 1, high) if indents[j] >= 0), high)
                cuts = [low]
                while at < high:
                    cuts.append(at)
                    at = ends[at]
            if len(cuts) < 2:
                pieces.append((low, high))
                continue
            todo += [(a, b, [a]) for a, b in reversed(list(zip(cuts, cuts[1:] + [high])))]
        joined = pieces[:1]
        for low, high in pieces[1:]:
            if total[high] - total[joined[-1][0]] <= limit:
                joined[-1] = (joined[-1][0], high)
            else:
                joined.append((low, high))
        for low, high in joined:
            last = found[-1] if found else None
            small = last and min(total[high] - total[low], total[last[1]] - total[last[0]]) < least
            if small and last[2] == kind and kind != LOST and total[high] - total[last[0]] <= limit:
                found[-1] = (last[0], high, kind)
            else:
                found.append((low, high, kind))
    return found


def _outside(indents: list[int], opened: list[int]) -> list[int]:
    """Lines that begin inside a block comment continue what is above; ``opened`` is how
    many comments each line opens beyond those it closes."""
    depth, found = 0, []
    for indent, more in zip(indents, opened):
        found.append(-1 if depth else indent)
        depth = max(0, depth + more)
    return found


def layout_spans(indents: Column, opened: Column, sizes: Column, breaks: Column, kinds: Column, names: Column, limit: int, least: int) -> Column:
    """First and last segment (from 1), kind, first and last line of each chunk of a text.

    ``breaks`` is 1 for segments that end their line."""

    def one(indents, opened, sizes, breaks, kinds, names):
        line = list(accumulate(breaks, initial=1))
        return [(a + 1, b, kind, line[a], line[b - 1]) for a, b, kind in spans(_outside(indents, opened), sizes, kinds, names, limit, least)]

    @F.arrow_udf(_SQL)
    def cut(indents: pa.Array, opened: pa.Array, sizes: pa.Array, breaks: pa.Array, kinds: pa.Array, names: pa.Array) -> pa.Array:
        rows = zip(*map(rows_of, (indents, opened, sizes, breaks, kinds, names)))
        return structs_of([None if r[0] is None else one(*r) for r in rows], _FIELDS)

    return cut(indents, opened, sizes, breaks, kinds, names)
