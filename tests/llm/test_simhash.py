"""SimHash near-dedup against fingerprints and links computed one by one."""

import random
import re

import numpy as np
import pytest
import xxhash

from codelode.llm import queries, simhash

SF_DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def plain(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(values):
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    ordered = sorted(up)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    return {v: find(v) for v in ordered}


def expected(rows):
    bits = [(i, plain(t)) for i, t in rows]
    root = roots({b for _, b in bits})
    least = {}
    for i, b in bits:
        if i is not None:
            least[root[b]] = min(i, least.get(root[b], i))
    return sorted((repr((i, f"{b:016x}", least.get(root[b]))) for i, b in bits))


def test_majority_over_many_hashes():
    rng = np.random.default_rng(3)
    counts = np.array([1, 2, 254, 255, 256, 1000, 510])
    hashes = rng.integers(0, 2**64, int(counts.sum()), dtype=np.uint64)
    hashes[:300] |= np.uint64(0xFFFF)
    at = 0
    for n, got in zip(counts.tolist(), simhash.majority(hashes, counts).tolist(), strict=True):
        own = hashes[at : at + n].tolist()
        assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > n)
        at += n


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    b = np.where(np.arange(5000) % 2, b, a ^ (np.uint64(1) << rng.integers(0, 64, 5000, dtype=np.uint64)))
    apart = np.bitwise_count(simhash.embedding(a) ^ simhash.embedding(b))
    counted = sum(np.abs(np.bitwise_count((a >> np.uint64(2 * s)) & np.uint64(3)).astype(int) - np.bitwise_count((b >> np.uint64(2 * s)) & np.uint64(3))) for s in range(32))
    assert (apart == counted).all() and (apart <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("big", [17, simhash.BIG])
def test_links_of_fingerprints(spark, big):
    rng, values = random.Random(big), set()
    for _ in range(30):  # chains and dense groups around random centres, corners of the cube
        centre = rng.choice([rng.getrandbits(64), 0, 2**64 - 1])
        for _ in range(rng.choice([1, 3, 40])):
            values.add(centre)
            for _ in range(rng.randrange(1, 5)):
                centre ^= 1 << rng.randrange(64)
    middle = rng.getrandbits(64)
    values |= {middle ^ sum(1 << rng.randrange(20) for _ in range(4)) & (2**64 - 1) for _ in range(400)}
    want = roots(values)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "bits long").repartition(3), big).collect()
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for r in found:
        a, b = r.a % 2**64, r.b % 2**64
        assert (a ^ b).bit_count() <= 3
        up[find(a)] = find(b)
    assert len({find(v) for v in values}) == len(set(want.values())) and all(find(v) == find(r) for v, r in want.items())
    assert len(found) < 40 * len(values)


def test_rows(spark):
    rng, base = random.Random(9), [f"word{k}" for k in range(300)]
    texts = [None, "", " \n", "one", "One  ", "one two", "a b c", "A  b\tC", "é É x y", "x" * 100_000, "ab cd " * 20_000]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(300)] = "other"
        texts.append(" ".join(copy))
    rows = [(k if k != 5 else None, t) for k, t in enumerate(texts)] + [(11, texts[11]), (None, None)]
    table = spark.createDataFrame([(*r, "b", "c") for r in rows], "doc_id long, text string, bits string, component_id string").repartition(4)
    got = simhash.near_duplicates(table)
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got.collect()) == expected(rows)
    assert simhash.near_duplicates(table.limit(0)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op11_simhash_near_dedup"](spark, SF_DIR).collect()) == expected(rows)
