"""N-gram Jaccard join by a prefix tree.

1. A text becomes the set of 64-bit hashes of its word n-grams.  Equal sets are one set.
2. Two sets can only be linked if they share one of the first ``n - ceil(t n) + 1``
   n-grams of a global order; sets chained by such n-grams form a candidate cluster.
   This holds for any order.  Here n-grams that recur within a slice of the texts come
   last (a bitmap of fixed size says which), then the order is that of the hashes;
   n-grams found to chain sets join those at the end in the next round, in which only
   sets still chained take part.  Every text is read in whole.
3. The ordered sets of a cluster lie in a prefix tree.  A set walks the tree once for
   all sets in it, sharing the overlap along common beginnings; a subtree is left as
   soon as the overlap so far and the lengths that remain cannot reach the threshold,
   or if all of its sets are already connected with the walking one.
4. A large cluster is cut into blocks by size and by a hash.  Blocks are joined within, then one
   set of each component of each block with its like; after that only those pairs of
   blocks are joined that are not yet one component, so a group of very many near
   copies costs little more than its size and no link is lost.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import spans, stars, tables
from codelode.llm.components import UnionFind, components

WORDS = 5
THRESHOLD = (4, 5)  # a link needs this share of the union, as a fraction
BLOCK_SETS = 2000
BLOCK_BYTES = 32 << 20
STAR_BYTES = 16 << 20
ROUNDS = 3
EDGE = 48
_LIFT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(64)], np.uint64)


@dataclass
class Rarity:
    """A global order of word tokens: those that have not yet chained sets first, then rare ones first.

    Counts are kept for 2^22 ranges of hashes; tokens that share a range only stand later.
    """

    ranks: np.ndarray
    chained: np.ndarray

    @staticmethod
    def of(counts: DataFrame) -> Rarity:
        """From (gram, n)."""
        found = counts.groupBy(F.shiftrightunsigned("gram", 42).cast("int").alias("range")).agg(F.sum("n").alias("n")).toArrow()
        ranks = np.zeros(1 << 22, np.uint8)
        ranks[found["range"].to_numpy()] = np.minimum(31, 2 * np.log2(found["n"].to_numpy())).astype(np.uint8)
        return Rarity(ranks, np.zeros(1 << (tables.BITMAP_BITS - 6), np.uint64))

    def names(self, grams: np.ndarray) -> np.ndarray:
        rank = self.ranks[grams >> np.uint64(42)].astype(np.uint64) | tables.has_bit(self.chained, grams).astype(np.uint64) << np.uint64(5)
        return grams >> np.uint64(6) | rank << np.uint64(58)

    def after(self, tied: DataFrame) -> Rarity:
        """The order in which the tokens that chain sets in ``tied`` stand last."""
        return Rarity(self.ranks, self.chained | tables.bitmap(tied.select(F.shiftleft("gram", 6).alias("gram")), "gram"))


@dataclass
class Sets:
    """Distinct n-grams of many units of text: sorted within a unit, with the n + 1 offsets of the units."""

    grams: np.ndarray
    bounds: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.bounds)

    def names(self) -> np.ndarray:
        """A 64-bit name of each set, for any order of its members; 0 for an empty one."""
        full = np.flatnonzero(self.sizes)
        names = np.zeros(len(self.sizes), np.uint64)
        if len(full):
            sums = np.add.reduceat(spans.mix(self.grams ^ np.uint64(0x5851F42D4C957F2D)), self.bounds[full])
            names[full] = spans.mix(sums + self.sizes[full].astype(np.uint64)) | np.uint64(1)
        return names.view(np.int64)

    def ordered(self, common: np.ndarray | Rarity) -> np.ndarray:
        """Names of n-grams that sort in the global order, in this order: common ones last."""
        names = common.names(self.grams) if not isinstance(common, np.ndarray) else (self.grams >> np.uint64(1)) | (tables.has_bit(common, self.grams).astype(np.uint64) << np.uint64(63))
        return names[_by_unit(np.repeat(np.arange(len(self.sizes)), self.sizes), names, len(self.sizes))]

    def pick(self, units: np.ndarray) -> Sets:
        sizes = self.sizes[units]
        return Sets(self.grams[spans.spread_positions(self.bounds[units], sizes)], np.concatenate([[0], np.cumsum(sizes)]))


def _by_unit(unit: np.ndarray, values: np.ndarray, units: int) -> np.ndarray:
    """An order by unit and then by value (by its upper bits)."""
    bits = np.uint64(max(1, int(units).bit_length()))
    return np.argsort(unit.astype(np.uint64) << (np.uint64(64) - bits) | values >> bits, kind="stable")


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of lines, and text and line number of each; a line break ends its line."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.unique(np.concatenate([offsets, breaks]))
    text = np.searchsorted(offsets, starts[:-1], "right") - 1
    number = np.searchsorted(breaks, starts[:-1], "right") - np.searchsorted(breaks, offsets[text], "right")
    return starts, text, number


def ngram_sets(data: np.ndarray, offsets: np.ndarray, words: int, short: bool, repeats: bool = False) -> Sets:
    """The set of each unit.  ``short``: units with fewer words have one n-gram of all of them, else none.
    ``repeats``: the second, third, ... occurrence of an n-gram in a unit is a member of its own."""
    hashes, at = spans.word_hashes(data, offsets)
    sizes, units = np.diff(at), len(at) - 1
    rolled = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
    for k in range(words):
        rolled += hashes[k : len(rolled) + k] * _LIFT[k]
    rolled = spans.mix(rolled)
    unit = np.repeat(np.arange(units), sizes)
    whole = unit[: len(rolled)] == unit[words - 1 :] if len(rolled) else np.zeros(0, bool)
    rolled, unit = rolled[whole], unit[: len(whole)][whole]
    if short and (few := np.flatnonzero((sizes > 0) & (sizes < words))).size:
        single = np.array([(hashes[at[k] : at[k + 1]] * _LIFT[: sizes[k]]).sum() + np.uint64(sizes[k]) for k in few], np.uint64)
        rolled, unit = np.concatenate([rolled, spans.mix(single)]), np.concatenate([unit, few])
    order = _by_unit(unit, rolled, units)
    rolled, unit = rolled[order], unit[order]
    fresh = np.ones(len(rolled), bool)
    fresh[1:] = (rolled[1:] != rolled[:-1]) | (unit[1:] != unit[:-1])
    if repeats and not fresh.all():
        at = np.arange(len(rolled))
        before = at - np.maximum.accumulate(np.where(fresh, at, 0))
        rolled = np.where(before > 0, spans.mix(rolled + before.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), rolled)
        rolled, fresh = rolled[_by_unit(unit, rolled, units)], np.ones(len(rolled), bool)
    return Sets(rolled[fresh], np.concatenate([[0], np.cumsum(np.bincount(unit[fresh], minlength=units))]))


def _units(data: np.ndarray, offsets: np.ndarray, words: int, by_line: bool) -> Sets:
    return ngram_sets(data, line_offsets(data, offsets)[0] if by_line else offsets, words, not by_line, by_line and words == 1)


def required(a: int, b: int, threshold: tuple[int, int]) -> int:
    """Least overlap of sets of these sizes that makes a link."""
    part, whole = threshold
    return -(-part * (a + b) // (part + whole))


def _scan(rows: DataFrame, words: int) -> DataFrame:
    """One pass for two things: per text doc_id, set_id (NULL for an empty set) and number of n-grams, and
    (in rows with a ``gram``) the n-grams that different sets of one slice have in common."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_hash long, set_id long, n_shingles long, gram long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.flat(batch.column(1))
            for start, _, outer, bounds in spans.slices(data, offsets, STAR_BYTES):
                held, seen = [], set()
                for first, last, piece, at in spans.slices(outer, bounds):
                    sets = ngram_sets(piece, at, words, True)
                    names = pa.array(sets.names(), mask=sets.sizes == 0)
                    own = [batch.column(c).slice(start + first, last - first) for c in (0, 2)]
                    yield pa.RecordBatch.from_arrays([*own, names, pa.array(sets.sizes, pa.int64()), pa.nulls(last - first, pa.int64())], ["doc_id", "text_hash", "set_id", "n_shingles", "gram"])
                    held.append(sets.pick(_fresh(sets, seen, None)[0]).grams)
                every = np.sort(np.concatenate(held))
                twice = np.unique(every[1:][every[1:] == every[:-1]])
                none = [pa.nulls(len(twice), t) for t in (batch.column(0).type, pa.int64(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, pa.array(twice.view(np.int64))], ["doc_id", "text_hash", "set_id", "n_shingles", "gram"])

    return rows.mapInArrow(run, schema)


def _fresh(sets: Sets, seen: set[int], wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Units with the first set of its name that is not empty, has its bit in ``wanted`` and is not in ``seen``; their names."""
    names = sets.names()
    _, first = np.unique(names, return_index=True)
    first = first[sets.sizes[first] > 0]
    if wanted is not None:
        first = first[tables.has_bit(wanted, names[first])]
    first = first[[n not in seen for n in names[first].tolist()]] if len(first) else first
    seen.update(names[first].tolist())
    return first, names[first]


def _holding(batch: pa.RecordBatch, texts: np.ndarray | None) -> pa.RecordBatch:
    """The rows whose hash of the text has its bit in ``texts``."""
    return batch if texts is None else batch.filter(pa.array(tables.has_bit(texts, batch.column(2).to_numpy())))


def chains(rows: DataFrame, words: int, threshold: tuple[int, int], common: np.ndarray | Rarity, wanted: np.ndarray | None, by_line: bool, texts: np.ndarray | None = None) -> DataFrame:
    """(a, b, gram): sets that have an n-gram of their prefixes in common, as stars around one of them.

    Texts without a bit in ``texts`` hold no wanted set and are left alone."""
    part, whole = threshold
    shared = rows.sparkSession.sparkContext.broadcast((common, wanted, texts))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, wanted, texts = shared.value
        for batch in batches:
            batch = _holding(batch, texts)
            data, offsets = spans.flat(batch.column(1))
            for _, _, outer, bounds in spans.slices(data, offsets, STAR_BYTES):
                held, owners, seen = [], [], set()
                for _, _, piece, at in spans.slices(outer, bounds):
                    sets = _units(piece, at, words, by_line)
                    units, names = _fresh(sets, seen, wanted)
                    sets = sets.pick(units)
                    reach = sets.sizes - -(-part * sets.sizes // whole) + 1
                    held.append(sets.ordered(common)[spans.spread_positions(sets.bounds[:-1], reach)])
                    owners.append(np.repeat(names, reach))
                if not sum(map(len, held)):
                    continue
                yield stars.local_star(np.concatenate(held), np.concatenate(owners))

    return stars.tie(rows.mapInArrow(local, stars.LOCAL_SQL))


def candidates(rows: DataFrame, scanned: DataFrame, words: int, threshold: tuple[int, int], rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Chained pairs of sets that may be linked, and the bitmap of common n-grams of the last order.

    The n-grams that chain sets in one round come last in the order of the next, which
    only takes the sets that are still chained.  So shared passages leave the prefixes,
    and what stays are sets that have nearly all n-grams in common with others.
    """
    common, wanted, texts, before, used = tables.bitmap(scanned.where("gram IS NOT NULL"), "gram"), None, None, None, None
    found = None
    for _ in range(rounds):
        used = common
        found = tables.kept(chains(rows, words, threshold, common, wanted, False, texts), "chains")
        nodes = found.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        active = nodes.count()
        if active == 0 or (before is not None and active > 0.95 * before):
            break
        # Names of the global order have lost the lowest bit and have the common bit on top.
        common = common | tables.bitmap(found.select(F.shiftleft("gram", 1).alias("gram")), "gram")
        wanted, texts, before = tables.bitmap(nodes, "set_id"), texts_of(scanned, nodes), active
    return found, used


def texts_of(scanned: DataFrame, sets: DataFrame) -> np.ndarray:
    """Bitmap of the hashes of the texts that have one of ``sets``."""
    return tables.bitmap(scanned.select("set_id", "text_hash").join(sets, "set_id", "left_semi"), "text_hash")


def members(rows: DataFrame, words: int, common: np.ndarray | Rarity, wanted: np.ndarray, by_line: bool = False, texts: np.ndarray | None = None) -> DataFrame:
    """set_id and all ordered n-grams of the sets whose bit is set in ``wanted``."""
    shared = rows.sparkSession.sparkContext.broadcast((common, wanted, texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, wanted, texts = shared.value
        for batch in batches:
            batch = _holding(batch, texts)
            data, offsets = spans.flat(batch.column(1))
            for _, _, piece, at in spans.slices(data, offsets):
                sets = _units(piece, at, words, by_line)
                units, names = _fresh(sets, set(), wanted)
                sets = sets.pick(units)
                raw = pa.py_buffer(sets.ordered(common).tobytes())
                grams = pa.BinaryArray.from_buffers(pa.binary(), len(names), [None, pa.py_buffer((sets.bounds * 8).astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([pa.array(names), grams], ["set_id", "grams"])

    return rows.mapInArrow(run, "set_id long, grams binary")


class _Node:
    __slots__ = ("edge", "kids", "ends", "low", "high", "some", "mixed")

    def __init__(self, edge: list[int], low: int, high: int, some: int):
        self.edge, self.kids, self.ends, self.low, self.high, self.some, self.mixed = edge, {}, [], low, high, some, False


class PrefixTree:
    """Ordered sets of one cluster; finds links to sets of other components."""

    def __init__(self, threshold: tuple[int, int]):
        self.root, self.threshold, self.union = _Node([], 1 << 60, 0, -1), threshold, UnionFind()

    def insert(self, name: int, grams: list[int]) -> None:
        node, at, size = self.root, 0, len(grams)
        while True:
            if node.some == -1:
                node.some = name
            node.mixed |= self.union.find(node.some) != self.union.find(name)
            node.low, node.high = min(node.low, size), max(node.high, size)
            if at == size:
                node.ends.append((name, size))
                return
            kid = node.kids.get(grams[at])
            if kid is None:
                kid = node.kids[grams[at]] = _Node(grams[at:], size, size, name)
                kid.ends.append((name, size))
                return
            same, edge = 0, kid.edge
            if grams[at : at + len(edge)] == edge:
                same = len(edge)
            else:
                while same < len(edge) and at + same < size and edge[same] == grams[at + same]:
                    same += 1
                upper = node.kids[grams[at]] = _Node(edge[:same], kid.low, kid.high, kid.some)
                upper.mixed, kid.edge = kid.mixed, edge[same:]
                upper.kids[kid.edge[0]] = kid
                kid = upper
            node, at = kid, at + same

    def links(self, name: int, grams: list[int]) -> Iterator[tuple[int, int]]:
        """Links of a set to the sets in the tree, one for each component it is not yet in."""
        part, both, size = self.threshold[0], sum(self.threshold), len(grams)
        has, find = set(grams).__contains__, self.union.find
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if node.some == -1 or (not node.mixed and find(node.some) == find(name)):
                continue
            dead = False
            for k in range(0, len(node.edge), EDGE):
                piece = node.edge[k : k + EDGE]
                overlap += sum(map(has, piece))
                depth += len(piece)
                rest = size - bisect_right(grams, piece[-1])
                best = min(max(rest + depth, node.low), node.high)  # the length that helps most
                if both * (overlap + min(rest, best - depth)) < part * (size + best):
                    dead = True
                    break
            if dead:
                continue
            for other, length in node.ends:
                if both * overlap >= part * (size + length) and self.union.join(name, other):
                    yield name, other
            stack.extend((kid, overlap, depth) for kid in node.kids.values())


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _grams(row: dict) -> list[int]:
    return np.frombuffer(row["grams"], np.uint64).tolist()


def _join_within(threshold: tuple[int, int]):
    def work(rows: list[dict]) -> Iterator[dict]:
        if len(rows) > 1:
            tree = PrefixTree(threshold)
            for row in sorted(rows, key=lambda r: (len(r["grams"]), r["set_id"])):
                grams = _grams(row)
                for a, b in tree.links(row["set_id"], grams):
                    yield {"a": a, "b": b}
                tree.insert(row["set_id"], grams)

    return work


def _join_across(threshold: tuple[int, int]):
    def work(rows: list[dict]) -> Iterator[dict]:
        tree = PrefixTree(threshold)
        for row in rows:
            tree.union.join(row["root"], row["set_id"])
        for row in rows:
            if row["block"] == row["left"]:
                tree.insert(row["set_id"], _grams(row))
        for row in rows:
            if row["block"] != row["left"]:
                for a, b in tree.links(row["set_id"], _grams(row)):
                    yield {"a": a, "b": b}

    return work


def blocks(sets: DataFrame, block_sets: int) -> DataFrame:
    """Adds the block of each set in its cluster, and its class of sizes; a set has its ``grams`` or only their ``bytes``.

    A small cluster is one block.  A larger one is cut by size classes, of which only
    neighbours can have links, and these by a hash into as many blocks as their sets and
    bytes ask for.
    """
    step = math.log(THRESHOLD[1] / THRESHOLD[0])
    size = F.col("bytes") if "bytes" in sets.columns else F.octet_length("grams")
    need = F.greatest(F.ceil(F.count("*") / block_sets), F.ceil(F.sum(size) / BLOCK_BYTES))
    whole = sets.groupBy("cluster").agg(need.alias("blocks"))
    # Sizes of a link differ by the threshold at most, so its classes by one at most.
    sized = sets.join(whole, "cluster").withColumn("size_class", F.when(F.col("blocks") == 1, 0).otherwise(F.floor(F.log(size / 8.0) / step - 1e-9).cast("int")))
    parts = sized.groupBy("cluster", "size_class").agg(need.alias("parts"))
    part = F.pmod(F.xxhash64("set_id", F.lit(7)), F.col("parts")).cast("int")
    return sized.join(parts, ["cluster", "size_class"]).withColumn("block", F.col("size_class") * 1_000_000 + part).drop("parts")


def _links(blocked: DataFrame, threshold: tuple[int, int], block_sets: int) -> DataFrame:
    """Links (a, b) that connect what is connected in each cluster; blocked: what blocks() returns, with grams."""
    columns = ["cluster", "block", "set_id", "grams"]
    within = tables.in_groups(blocked.select(*columns), ["cluster", "block"], _join_within(threshold), _LINK, "a long, b long")
    links = tables.kept(within, "links")
    large = blocked.where("blocks > 1")
    if large.isEmpty():
        return links
    roots = components(links)
    rooted = tables.kept(large.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "rooted-sets")
    # One set of each component: they lie in far fewer blocks.
    pivots = rooted.where("set_id = root").select("cluster", "set_id", "grams", "bytes")
    more = tables.in_groups(blocks(pivots, block_sets).select(*columns), ["cluster", "block"], _join_within(threshold), _LINK, "a long, b long")
    links = tables.kept(links.unionByName(more), "links")
    roots = components(links)
    rooted = tables.kept(rooted.drop("root").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "rooted-sets")
    ranges = rooted.groupBy("cluster", "block", "size_class").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    left, right = ranges.select("cluster", F.col("block").alias("left"), F.col("low").alias("l1"), F.col("high").alias("h1"), F.col("size_class").alias("c1")), ranges.select("cluster", F.col("block").alias("right"), F.col("low").alias("l2"), F.col("high").alias("h2"), F.col("size_class").alias("c2"))
    pairs = left.join(right, "cluster").where("left < right AND c2 - c1 <= 1 AND NOT (l1 = h1 AND l2 = h2 AND l1 = l2)").select("cluster", "left", "right")
    sides = pairs.withColumn("block", F.explode(F.array("left", "right")))
    crossed = rooted.select(*columns, "root").join(sides, ["cluster", "block"])
    across = tables.in_groups(crossed, ["cluster", "left", "right"], _join_across(threshold), _LINK, "a long, b long")
    return links.unionByName(across)


def near_duplicates(documents: DataFrame, words: int = WORDS, threshold: tuple[int, int] = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", block_sets: int = BLOCK_SETS, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, text_hash, first.

    Words are runs of other than white space, A-Z lowered.  A text with fewer than
    ``words`` words is one n-gram; a text without words (or NULL) is linked with
    nothing and has its own id as component.  Rows with equal ids are linked as their
    texts are; a NULL id is never the smallest of a component that has another.
    ``first`` marks the row with the smallest id (of equal ids, the smallest hash of the
    text); rows equal in both are marked alike.
    """
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text_hash"))
    scanned = tables.kept(_scan(rows, words), "sets")
    sets = scanned.where("gram IS NULL")
    tied, common = candidates(rows, scanned, words, threshold, rounds)
    clusters = components(tied).select(F.col("root").alias("cluster"), F.col("node").alias("set_id"))
    sizes = sets.groupBy("set_id").agg((8 * F.min("n_shingles")).alias("bytes"))
    # Blocks are told from sizes; the n-grams are only then made, and shuffled once to meet their block.
    placed = tables.kept(blocks(clusters.join(sizes, "set_id"), block_sets), "clusters")
    found = members(rows, words, common, tables.bitmap(placed, "set_id"), texts=texts_of(scanned, placed.select("set_id"))).groupBy("set_id").agg(F.first("grams").alias("grams"))
    links = tables.kept(_links(tables.kept(placed.join(found, "set_id"), "blocked-sets"), threshold, block_sets), "all-links")
    roots = components(links).withColumnRenamed("node", "set_id")
    columns = ["doc_id", "n_shingles", "text_hash"]
    placed = sets.where("set_id IS NOT NULL").join(roots, "set_id", "left").select(*columns, F.coalesce("root", "set_id").alias("root"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("least"))
    linked = placed.join(least, "root").select(*columns, "component_id", order.eqNullSafe(F.col("least")).alias("first"))
    alone = sets.where("set_id IS NULL").select(*columns, F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return linked.unionByName(alone).select("doc_id", "n_shingles", "component_id", "text_hash", "first")


def keep_one(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without all but the first of each group of near copies."""
    gone = near_duplicates(documents, id_column=id_column, text_column=text_column).where("NOT first").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    own = documents.withColumn("_own", F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))))
    same = own[id_column].cast("long").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash"))
    return own.join(gone, same, "left_anti").select(*documents.columns)
