"""Merkle manifest of a dataset: a tree of SHA midstates.

The leaves of a group lie in order; every three consecutive nodes become their parent,
level by level, until one is left; the groups' roots become one root likewise.

* A parent retains a copy of its hash state before each child slot (``midstates``).
  Folding another leaf into the tree resumes the state before the slot with the
  replacement and then takes the right siblings only; left siblings are never read.
* Order.  Leaves are sorted by ranges of (group, id), so a group with a third of all rows
  lies over many tasks.  What each task holds of each group is a narrow table of spans,
  from which every leaf gets its place in its group.
* Levels.  ``levels`` levels at a time are built in one task per run of ``3 ** levels``
  leaves; only one node of each run goes on to the next round.  Runs are aligned, so no
  parent ever needs nodes of two tasks.
* A leaf is folded within its run where the run is built.  The way from there to the root
  (slot, width, state before the slot and siblings of each level) is one short value per
  run, joined to the leaves of the run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelode.llm import midstates as sha
from codelode.llm import tables

FAN = 3
LEVELS = 7
STEP = np.dtype([("slot", "u1"), ("width", "u1"), ("state", "<u4", 8), ("beside", "<u4", (FAN - 1, 8))])


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each ``-`` for NULL, else its count of UTF-8 bytes, a colon and its value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def depth(leaves: np.ndarray) -> np.ndarray:
    """Levels above the leaves until one node is left."""
    found, room = np.zeros(len(leaves), np.int64), np.ones(len(leaves), np.int64)
    while (more := room < leaves).any():
        found[more] += 1
        room[more] *= FAN
    return found


class _Level:
    """One level of many runs side by side: for every node its parent, and what folding at it needs."""

    def __init__(self, digest: np.ndarray, place: np.ndarray, active: np.ndarray):
        self.active, self.slot = active, np.where(active, place % FAN, 0)
        opens = (self.slot == 0) | ~active
        first = np.flatnonzero(opens)
        self.up = np.cumsum(opens) - 1
        widths = np.diff(np.append(first, len(opens)))
        self.width = widths[self.up]
        blocks = sha.digits(digest)
        state = np.broadcast_to(sha.START, (8, len(first)))
        self.state = np.empty_like(digest)
        for k in range(FAN):
            here = np.flatnonzero(widths > k)
            child = first[here] + k
            self.state[:, child] = state[:, here]
            state = state.copy()
            state[:, here] = sha.absorb(state[:, here], blocks[:, child])
        self.beside = np.zeros((FAN - 1, 8, len(opens)), np.uint32)
        for k in range(FAN - 1):  # siblings from left to right, the node itself left out
            other = k + (self.slot <= k)
            here = np.flatnonzero(other < self.width)
            self.beside[k][:, here] = digest[:, here - self.slot[here] + other[here]]
        self.parents = sha.finish(state, widths)
        still = ~active[first]
        self.parents[:, still] = digest[:, first[still]]
        self.places = np.where(active[first], place[first] // FAN, place[first])

    def steps(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), STEP)
        out["slot"], out["width"] = self.slot[at], self.width[at]
        out["state"], out["beside"] = self.state[:, at].T, self.beside[:, :, at].transpose(2, 0, 1)
        return out


def _climb(digest: np.ndarray, place: np.ndarray, height: np.ndarray) -> Iterator[tuple[_Level, np.ndarray]]:
    """The levels of some whole runs, each with the nodes that stand over the first ones."""
    at = np.arange(len(place))
    for level in range(int(height.max(initial=0))):
        one = _Level(digest, place, height > level)
        yield one, at
        first = np.flatnonzero(np.diff(one.up, prepend=-1))
        digest, place, height, at = one.parents, one.places, height[first], one.up[at]


class _Fold:
    """Digests on their way up, and the hash of all siblings they met."""

    def __init__(self, digest: np.ndarray, proof: np.ndarray, blocks: np.ndarray):
        self.digest, self.proof, self.blocks = digest, proof, blocks

    def up(self, rows: np.ndarray, steps: np.ndarray) -> None:
        """``rows`` each meet their step: the kept state is resumed, right siblings follow."""
        state = sha.absorb(np.ascontiguousarray(steps["state"].T), sha.digits(self.digest[:, rows]))
        width, slot = steps["width"].astype(np.int64), steps["slot"]
        for k in range(FAN - 1):
            there = np.flatnonzero(width - 1 > k)
            block = sha.digits(np.ascontiguousarray(steps["beside"][there, k].T))
            self.proof[:, rows[there]] = sha.absorb(self.proof[:, rows[there]], block)
            right = slot[there] <= k
            state[:, there[right]] = sha.absorb(state[:, there[right]], block[:, right])
        self.blocks[rows] += width - 1
        self.digest[:, rows] = sha.finish(state, width)


def _whole_runs(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Batches cut where a run of nodes begins: at each place that is a multiple of ``run``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = np.flatnonzero(batch.column("place").to_numpy() % run == 0)
        if len(starts):
            ready = pa.Table.from_batches([*held, batch.slice(0, starts[-1])]).combine_chunks().to_batches()
            yield from (b for b in ready if b.num_rows)
            held = []
        held.append(batch.slice(starts[-1] if len(starts) else 0))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _tops(place: np.ndarray, levels: list[tuple[_Level, np.ndarray]], digest: np.ndarray, run: int) -> list[bytes | None]:
    """The digest over each run, at the run's first node."""
    last = levels[-1][0] if levels else None
    over = last.parents[:, last.up[levels[-1][1]]] if last else digest
    first = place % run == 0
    found = iter(sha.to_bytes(over[:, first]))
    return [next(found) if f else None for f in first]


def _leaves_up(levels: int):
    """Builds each run's tree and folds each leaf's replacement through it."""
    run = FAN**levels

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches, run):
            place, count = batch.column("place").to_numpy(), batch.num_rows
            digest = sha.from_bytes(batch.column("leaf").to_pylist())
            built = list(_climb(digest, place % run, np.minimum(depth(batch.column("n").to_numpy()), levels)))
            fold = _Fold(sha.from_bytes(batch.column("replacement").to_pylist()), np.broadcast_to(sha.START, (8, count)).copy(), np.zeros(count, np.int64))
            for level, at in built:
                rows = np.flatnonzero(level.active[at])
                fold.up(rows, level.steps(at[rows]))
            columns = [*(batch.column(c) for c in ("group", "id", "leaf", "n")), pa.array(place // run), pa.array(sha.to_bytes(fold.digest)), pa.array(sha.to_bytes(fold.proof)), pa.array(fold.blocks), pa.array(_tops(place, built, digest, run), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["group", "id", "leaf", "n", "run", "folded", "proof", "blocks", "top"])

    return work


def _nodes_up(levels: int):
    """Builds ``levels`` more levels; the steps of each node through them are one value."""
    run = FAN**levels

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_runs(batches, run):
            place, count = batch.column("place").to_numpy(), batch.num_rows
            digest, left = sha.from_bytes(batch.column("digest").to_pylist()), batch.column("levels_left").to_numpy()
            built = list(_climb(digest, place % run, np.clip(left, 0, levels)))
            steps = np.zeros((count, len(built)), STEP)
            for k, (level, at) in enumerate(built):
                steps[:, k] = level.steps(at)
            ways = [steps[k, : max(0, min(int(left[k]), levels))].tobytes() for k in range(count)]
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("place"), batch.column("levels_left"), pa.array(ways, pa.binary()), pa.array(place // run), pa.array(_tops(place, built, digest, run), pa.binary())], ["group", "place", "levels_left", "way", "run", "top"])

    return work


def _ways(nodes: DataFrame, deepest: int, levels: int) -> DataFrame:
    """(group, place, way, root) of nodes (group, place, levels_left, digest)."""
    keyed = nodes.withColumn("run", F.expr(f"place DIV {FAN**levels}")).repartition("group", "run").sortWithinPartitions("group", "place").drop("run")
    built = tables.kept(keyed.mapInArrow(_nodes_up(levels), "group string, place long, levels_left long, way binary, run long, top binary"), "merkle-nodes")
    heads = built.where("top IS NOT NULL")
    if deepest <= levels:
        return built.drop("top").join(heads.select("group", F.col("top").alias("root")), "group").select("group", "place", "way", "root")
    above = _ways(heads.select("group", F.col("run").alias("place"), (F.col("levels_left") - levels).alias("levels_left"), F.col("top").alias("digest")), deepest - levels, levels)
    above = above.select("group", F.col("place").alias("run"), F.col("way").alias("onward"), "root")
    return built.drop("top").join(above, ["group", "run"]).select("group", "place", F.concat("way", "onward").alias("way"), "root")


def _placed(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``place`` (from 0) in their group and ``n``, the rows of the group."""
    lined = tables.kept(rows.repartitionByRange("group", *order).sortWithinPartitions("group", *order).withColumn("_row", F.monotonically_increasing_id()), "merkle-order")
    lined = lined.withColumn("_part", F.shiftright("_row", 33))
    held = lined.groupBy("group", "_part").agg(F.min("_row").alias("_low"), F.count("*").alias("_rows"))
    before = Window.partitionBy("group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    spans = held.select("group", "_part", "_low", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(Window.partitionBy("group")).alias("n"))
    return lined.join(spans, ["group", "_part"]).withColumn("place", F.col("_row") - F.col("_low") + F.col("_before")).drop("_part", "_row", "_low", "_before")


def _to_root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count = batch.num_rows
        if not count:
            continue
        ways = batch.column("way").dictionary_encode()
        which, values = ways.indices.to_numpy(), [np.frombuffer(v, STEP) for v in ways.dictionary.to_pylist()]
        lengths = np.array([len(v) for v in values], np.int64)
        table = np.zeros((len(values), int(lengths.max(initial=0))), STEP)
        for k, v in enumerate(values):
            table[k, : len(v)] = v
        fold = _Fold(*(sha.from_bytes(batch.column(c).to_pylist()) for c in ("folded", "proof")), batch.column("blocks").to_numpy().copy())
        for k in range(table.shape[1]):
            rows = np.flatnonzero(lengths[which] > k)
            fold.up(rows, table[which[rows], k])
        proof = sha.finish(fold.proof, fold.blocks)
        made = [pa.array(sha.to_bytes(x)) for x in (proof, fold.digest)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "leaf", "subroot", "root")), *made], ["id", "leaf", "subroot", "root", "proof", "folded_root"])


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The manifest of rows (doc_id, group, leaf, replacement); digests are hexadecimal.

    Returns doc_id, leaf, subroot, root, proof_sha256, folded_root (the root with the
    replacement in the leaf's stead) and verified (it equals the root), one row per row.

    Leaves of a group ascend by doc_id, NULL first; rows with equal ids by their leaf, then
    by the replacement, and rows equal in all of it are interchangeable.  Groups ascend by
    the bytes of their names, the NULL group first.  A NULL replacement means the leaf
    itself.  No rows give no rows; other columns are not read.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))  # never NULL, same order
    narrow = rows.select(key.alias("group"), F.col("doc_id").alias("id"), F.unhex("leaf").alias("leaf"), F.unhex(F.coalesce("replacement", "leaf")).alias("replacement"))
    placed = _placed(narrow, "id", "leaf", "replacement")
    run = F.expr(f"place DIV {FAN**levels}")
    id_type = dict(narrow.dtypes)["id"]
    keyed = placed.select("group", "id", "leaf", "replacement", "n", "place").withColumn("run", run).repartition("group", "run").sortWithinPartitions("group", "place").drop("run")
    built = tables.kept(keyed.mapInArrow(_leaves_up(levels), f"group string, id {id_type}, leaf binary, n long, run long, folded binary, proof binary, blocks long, top binary"), "merkle-leaves")
    heads = built.where("top IS NOT NULL")
    deepest = int(depth(np.array([built.agg(F.max("n")).first()[0] or 0]))[0])
    left = F.lit(0).cast("long")
    for k in range(deepest):  # the levels of a group with more than 3 ** k leaves
        left = left + F.when(F.col("n") > FAN**k, 1).otherwise(0)
    nodes = heads.select("group", F.col("run").alias("place"), (left - levels).alias("levels_left"), F.col("top").alias("digest"))
    ways = tables.kept(_ways(nodes, max(0, deepest - levels), levels), "merkle-ways")
    subroots = ways.where("place = 0").select(F.lit("").alias("group"), F.col("group").alias("name"), F.col("root").alias("digest"))
    ranked = tables.kept(_placed(subroots, "name"), "merkle-groups")
    groups = ranked.agg(F.max("n")).first()[0] or 0
    top = _ways(ranked.select("group", "place", F.lit(int(depth(np.array([groups]))[0])).cast("long").alias("levels_left"), "digest"), int(depth(np.array([groups]))[0]), levels)
    top = ranked.join(top.select("place", F.col("way").alias("onward"), F.col("root").alias("whole")), "place").select(F.col("name").alias("group"), "onward", "whole")
    runs = ways.join(top, "group").select("group", F.col("place").alias("run"), F.concat("way", "onward").alias("way"), F.col("root").alias("subroot"), F.col("whole").alias("root"))
    walked = built.select("group", "run", "id", "leaf", "folded", "proof", "blocks").join(runs, ["group", "run"])
    done = walked.select("id", "leaf", "folded", "proof", "blocks", "way", "subroot", "root").mapInArrow(_to_root, f"id {id_type}, leaf binary, subroot binary, root binary, proof binary, folded_root binary")
    hexed = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "folded_root")}
    return done.select(
        F.col("id").alias("doc_id"), hexed["leaf"].alias("leaf"), hexed["subroot"].alias("subroot"), hexed["root"].alias("root"), F.lower(F.hex("proof")).alias("proof_sha256"),
        hexed["folded_root"].alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"),
    )
