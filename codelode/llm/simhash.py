"""SimHash near-dedup by segment popcounts.

1. A text's fingerprint is the majority of the XXH64 hashes of its word shingles, bit by
   bit.  Equal fingerprints become one row at once.
2. Embedding.  A fingerprint is cut into 32 segments of two bits and mapped to the number
   of set bits in each.  The Manhattan distance of two such vectors never exceeds the
   Hamming distance, so links lie within a Manhattan distance of 3.  Counts are kept in
   unary digits: the Manhattan distance is then the number of differing digits.
3. Grid range-join.  The vector has two halves; one of them differs by at most 1.  A
   fingerprint lies in one cell of each half's grid and also visits the cells that have
   one more in one segment.  Of two fingerprints one step apart one visits the other.
4. In a cell the whole Manhattan distance is tested first, then the Hamming distance.
   A group of near copies yields a forest of links, not all of its pairs.

A cell that can get more than ``big`` fingerprints is cut by the quarters of the other
half in the same way (3 = at most 1 in one of two), so that near copies in very large
number are spread over tasks.  Nothing is dropped on any path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import spans, tables
from codelode.llm.components import components

WORDS = 3
SEED = 42
DISTANCE = 3
BIG = 200_000
DENSE = 64
PAIRS_AT_ONCE = 1 << 20
_ONES = np.uint64(0x5555555555555555)
_LANES = np.uint64(0x0101010101010101)
_HALF = np.uint64(0xFFFFFFFF)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes; texts lie side by side, none is empty.

    Eight bits are counted at once in the bytes of a word, at most 255 hashes at a time."""
    blocks = -(-counts // 255)
    firsts = np.cumsum(counts) - counts
    starts = np.repeat(firsts, blocks) + 255 * spans.spread_positions(np.zeros(len(counts), np.int64), blocks)
    found = np.zeros(len(counts), np.uint64)
    for low in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(low)) & _LANES, starts).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(sums.astype(np.int64), np.cumsum(blocks) - blocks)
        for byte in range(8):
            found |= (2 * sums[:, byte] > counts).astype(np.uint64) << np.uint64(8 * byte + low)
    return found


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> np.ndarray:
    """A fingerprint for each text; 0 where there is no word."""
    data = spans._LOWER[data]
    starts, ends = spans.word_spans(data, offsets)
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1) - 1  # the words again, one blank behind each
    new_starts = new_ends - lengths
    joined = np.full(int(new_ends[-1]) + 1 if len(starts) else 0, 32, np.uint8)
    joined[spans.spread_positions(new_starts, lengths)] = data[spans.spread_positions(starts, lengths)]
    firsts = np.searchsorted(starts, offsets)
    own = np.diff(firsts)
    counts = np.where(own == 0, 0, np.maximum(own - words + 1, 1))
    at = spans.spread_positions(firsts[:-1], counts)
    last = at + np.minimum(np.repeat(own, counts), words) - 1
    text, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[a:b], SEED) for a, b in zip(new_starts[at].tolist(), new_ends[last].tolist(), strict=True)), np.uint64, len(at))
    found = np.zeros(len(own), np.uint64)
    some = counts > 0
    if some.any():
        found[some] = majority(hashes, counts[some])
    return found


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.flat(batch.column("text"))
            for first, last, part, cuts in spans.slices(data, offsets):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(fingerprints_of(part, cuts, words).view(np.int64))], ["doc_id", "bits"])

    return run


def fingerprints(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, bits) for every row: the fingerprint as a signed number."""
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(words), "doc_id long, bits long")


def embedding(bits: np.ndarray) -> np.ndarray:
    """The counts of the two-bit segments in unary digits: 0, 1, 3 for none, one, two."""
    low, high = bits & _ONES, (bits >> np.uint64(1)) & _ONES
    return (low | high) | ((low & high) << np.uint64(1))


def steps(cells: np.ndarray, segments: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, cells) with one more in one segment, for every segment that has room."""
    for s in range(segments):
        digits = (cells >> np.uint64(2 * s)) & np.uint64(3)
        rows = np.flatnonzero(digits != 3)
        yield rows, cells[rows] + ((digits[rows] + np.uint64(1)) << np.uint64(2 * s))


def halves(bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The cells of both halves, and what tells the halves apart."""
    unary = embedding(bits)
    for half in range(2):
        yield (unary >> np.uint64(32 * half)) & _HALF, np.uint64(half) << np.uint64(32)


def _rows(cells: np.ndarray, bits: np.ndarray, segments: int, key: Callable[[np.ndarray, np.ndarray | None], np.ndarray]) -> pa.RecordBatch:
    """A fingerprint's own cell (visit 0) and the cells it visits (visit 1)."""
    keys, visits, owners = [key(cells, None)], [np.zeros(len(cells), np.int8)], [bits]
    for rows, reached in steps(cells, segments):
        keys.append(key(reached, rows))
        visits.append(np.ones(len(rows), np.int8))
        owners.append(bits[rows])
    columns = [np.concatenate(keys).view(np.int64), np.concatenate(visits), np.concatenate(owners).view(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "visit", "bits"])


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = batch.column("bits").to_numpy().view(np.uint64)
        for cells, half in halves(bits):
            yield _rows(cells, bits, 16, lambda c, _, half=half: c | half)


def _own_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cells, half in halves(batch.column("bits").to_numpy().view(np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array((cells | half).view(np.int64))], ["cell"])


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = batch.column("cell").to_numpy().view(np.uint64)
        half, cells = cells & ~_HALF, cells & _HALF
        found = [cells | half, *(c | half[rows] for rows, c in steps(cells, 16))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["cell"])


def _finer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a big cell by the quarters of the other half; a clash of keys only costs comparisons."""
    for batch in batches:
        cell, bits = (batch.column(c).to_numpy().view(np.uint64) for c in ("cell", "bits"))
        other = embedding(bits) >> np.where(cell >> np.uint64(32) == 0, np.uint64(32), np.uint64(0)) & _HALF
        for quarter in range(2):
            own = (other >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)
            salt = spans.mix(cell * np.uint64(2) + np.uint64(quarter))
            yield _rows(own, bits, 8, lambda c, rows, salt=salt: spans.mix(c ^ (salt if rows is None else salt[rows])))


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs within the Manhattan distance first, then those within the Hamming distance."""
    near = np.flatnonzero(np.bitwise_count(embedding(a) ^ embedding(b)) <= DISTANCE)
    return near[np.bitwise_count(a[near] ^ b[near]) <= DISTANCE]


def _sparse(start: np.ndarray, size: np.ndarray, own: np.ndarray, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every row of some cells with the cell's own fingerprints before it."""
    row = spans.spread_positions(start, size)
    place = row - np.repeat(start, size)
    count = np.minimum(place, np.repeat(own, size))
    ends = np.cumsum(count)
    low = 0
    while low < len(row):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS_AT_ONCE, "right")))
        a = np.repeat(row[low:high], count[low:high])
        b = spans.spread_positions((row - place)[low:high], count[low:high])
        near = _near(bits[a], bits[b])
        yield bits[a[near]], bits[b[near]]
        low = high


def _dense(own: int, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A forest of the links in one cell: each row meets one row of every tree it is linked with."""
    tree = np.arange(own)
    for k in range(1, len(bits)):
        before = bits[: min(k, own)]
        near = _near(before, np.broadcast_to(bits[k], len(before)))
        if len(near):
            trees, at = np.unique(tree[near], return_index=True)
            yield np.full(len(at), bits[k]), before[near[at]]
            if k < own:
                tree[k] = trees[0]
            for joined in trees[1:]:
                tree[tree == joined] = trees[0]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def linked(cell: np.ndarray, visit: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.diff(cell, prepend=cell[:1] ^ np.uint64(1)))
        size = np.diff(np.append(start, len(cell)))
        own = np.add.reduceat((visit == 0).astype(np.int64), start)
        useful = (own > 0) & (size > 1)
        few = useful & (own <= DENSE)
        found = list(_sparse(start[few], size[few], own[few], bits))
        for k in np.flatnonzero(useful & ~few):
            found.extend(_dense(int(own[k]), bits[start[k] : start[k] + size[k]]))
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.uint64)]).view(np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, visit, bits = batch.column("cell").to_numpy().view(np.uint64), batch.column("visit").to_numpy(), batch.column("bits").to_numpy().view(np.uint64)
        changes = np.flatnonzero(np.diff(cell, prepend=held[-1][0][-1] if held else cell[0]))
        if len(changes):
            cut = changes[-1]
            whole = [np.concatenate(c) for c in zip(*held, (cell[:cut], visit[:cut], bits[:cut]), strict=True)]
            yield from linked(*whole)
            held = [(cell[cut:], visit[cut:], bits[cut:])]
        else:
            held.append((cell, visit, bits))
    if held:
        yield from linked(*[np.concatenate(c) for c in zip(*held, strict=True)])


_ROW = "cell long, visit byte, bits long"


def links(distinct: DataFrame, big: int = BIG) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``bits``, as many as connect what is linked.

    ``distinct`` is read several times."""

    def within(rows: DataFrame) -> DataFrame:
        return rows.repartition("cell").sortWithinPartitions("cell", "visit").mapInArrow(_links, "a long, b long")

    rows = distinct.mapInArrow(_spread, _ROW)
    # a cell gets its own fingerprints and those of 16 others, so one of these has a 17th at least
    crowded = tables.kept(distinct.mapInArrow(_own_cells, "cell long").groupBy("cell").count().where(F.col("count") > big // 17).select("cell"), "simhash-crowded")
    if crowded.isEmpty():
        return within(rows)
    crowded = crowded.mapInArrow(_reached, "cell long").distinct()
    finer = rows.join(crowded, "cell", "left_semi").select("cell", "visit", "bits").mapInArrow(_finer, _ROW)
    return within(rows.join(crowded, "cell", "left_anti").select("cell", "visit", "bits")).unionByName(within(finer))


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS, big: int = BIG) -> DataFrame:
    """One row per row: doc_id, bits, fingerprint (16 hexadecimal digits), component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; a text with fewer than ``words`` has
    its whole sequence as one shingle; NULL, empty and blank texts have the fingerprint
    zero, which is linked like any other.  ``component_id`` is the smallest id, NULL left
    aside, of all rows reachable by links; it is NULL only where all of them have NULL.
    Repeated rows each count, no rows give no rows, other columns are not read.
    """
    rows = tables.kept(fingerprints(documents, id_column, text_column, words), "simhash-fingerprints")
    distinct = tables.kept(rows.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = tables.kept(components(links(distinct.select("bits"), big)).select(F.col("node").alias("bits"), "root"), "simhash-roots")
    joined = distinct.join(roots, "bits")
    of_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = joined.join(of_root, "root").select("bits", "component_id")
    alone = distinct.join(roots, "bits", "left_anti").select("bits", F.col("least").alias("component_id"))
    ids = tables.kept(linked.unionByName(alone), "simhash-components")
    return rows.join(ids, "bits").select("doc_id", "bits", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
