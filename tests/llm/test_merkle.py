"""The Merkle manifest against a tree built by the standard library's SHA-256."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codelode.llm import merkle, midstates


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """The root, and for each leaf its siblings and slots, level by level."""
    ways, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, way in enumerate(ways):
            first = at[k] // 3 * 3
            way.append((at[k] - first, [nodes[j] for j in range(first, min(first + 3, len(nodes))) if j != at[k]]))
            at[k] //= 3
        nodes = [h(*nodes[j : j + 3]) for j in range(0, len(nodes), 3)]
    return nodes[0], ways


def fold(leaf, way):
    for slot, others in way:
        leaf = h(*others[:slot], leaf, *others[slot:])
    return leaf


def plain(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3] or r[2]))
        trees[g] = tree([r[2] for r in groups[g]])
    root, tops = tree([trees[g][0] for g in names]) if names else (None, [])
    out = []
    for g, top in zip(names, tops, strict=True):
        for r, way in zip(groups[g], trees[g][1], strict=True):
            folded = fold(r[3] or r[2], way + top)
            out.append((r[0], r[2], trees[g][0], root, h(*[x for _, others in way + top for x in others]), folded, folded == root))
    return out


def test_midstates():
    digests = [hashlib.sha256(bytes([k])).digest() for k in range(50)]
    words = midstates.from_bytes(digests)
    assert midstates.to_bytes(words) == digests
    state, want = np.broadcast_to(midstates.START, (8, 50)), [hashlib.sha256() for _ in digests]
    for blocks in range(5):
        assert midstates.to_bytes(midstates.finish(state, np.full(50, blocks))) == [w.digest() for w in want]
        state = midstates.absorb(state, midstates.digits(words))
        for w, d in zip(want, digests, strict=True):
            w.update(d.hex().encode())


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_manifest(spark, levels):
    rng, rows = random.Random(levels), []
    for g, count in [("a", 1), ("b", 3), ("", 2), (None, 4), ("é", 28), ("big", 100), ("c", 9), ("=", 10)]:
        rows += [(rng.randrange(-50, 500), g, h(str(g), str(k)), h("new", str(k)) if k % 3 else None) for k in range(count)]
    rows += [(None, "b", h("null id"), None), (7, "b", h("twice"), h("x")), (7, "b", h("twice"), h("x")), (7, "b", h("same id"), None)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, group string, leaf string, replacement string, place string, run string").repartition(5)
    found = merkle.manifest(table, levels)
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, plain(rows)))
    one = spark.createDataFrame([(5, "only", h("1"), h("2"))], "doc_id long, group string, leaf string, replacement string")
    assert list(map(tuple, merkle.manifest(one, levels).collect())) == plain([(5, "only", h("1"), h("2"))])
    assert merkle.manifest(table.limit(0), levels).count() == 0


def test_leaf(spark):
    rows = [(1, "a", None, "text\nmore é"), (None, "", "en", None)]
    table = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    got = [r[0] for r in table.select(merkle.leaf(*[F.col(c) for c in table.columns])).collect()]
    assert got == [h("1:1", "1:a", "-", f"{len('text\nmore é'.encode())}:text\nmore é"), h("-", "0:", "2:en", "-")]
