"""Periodic run detection against a plain search of every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from codelode.llm import queries, runs

SF_DIR = "/root/testdata/sf0.001"


def plain(words, least=6, times=4):
    found, n = [], len(words)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            own = words[start:i]
            if len(own) >= max(least, times * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.append((start, len(own), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def random_words(rng):
    kinds, n = rng.choice([1, 2, 2, 3, 5]), rng.randrange(1, 70)
    words = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 9)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (5, 3)])
def test_runs_of_random_words(least, times):
    rng = random.Random(least)
    for _ in range(1500):
        words = random_words(rng)
        text = np.frombuffer(" ".join(words).encode(), np.uint8)
        windows = runs.candidates(text, np.array([0, len(text)]), least, times).get(0, [])
        assert runs.runs_of(words, windows, least, times) == plain(words, least, times)


def test_every_square_is_primitive_and_seen():
    rng = random.Random(8)
    for _ in range(300):
        words = [rng.randrange(2) for _ in range(rng.randrange(30))]
        want = set()
        for q in range(1, len(words) // 2 + 1):
            for e in range(2 * q, len(words) + 1):
                half = words[e - q : e]
                if half == words[e - 2 * q : e - q] and not any(half == half[:p] * (q // p) for p in range(1, q) if q % p == 0):
                    want.add((e - 1, q))
        assert set(runs.squares(words)) == want


def test_rows(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "x y " * 50_000, "é é " * 9, "A a A a A a A a", "z" * 100_000, " ".join(str(k % 1000) for k in range(20_000))]
    texts += [" ".join(random_words(rng)) for _ in range(80)]
    rows = [(k if k else None, t, "n", "r") for k, t in enumerate([*texts, texts[5]])]
    table = spark.createDataFrame(rows, "doc_id long, text string, n_words string, runs string").repartition(3)
    got = {r.doc_id: (r.n_words, [tuple(x) for x in r.runs], r.text) for r in runs.find_runs(table).collect()}
    assert len(got) == len(rows)
    for i, text, _, _ in rows:
        words = split(text)
        if i == 6:
            assert got[i] == (100_000, [(0, 100_000, 2)], "x y")
        elif i == 10:
            assert got[i] == (20_000, [(0, 20_000, 1000)], " ".join(map(str, range(1000))))
        else:
            own = plain(words)
            assert got[i] == (len(words), own, collapsed(words, own))
    assert runs.find_runs(table.limit(0)).count() == 0


def test_query(spark):
    documents = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for r in queries.QUERIES["op12_periodic_runs"](spark, SF_DIR).collect():
        words, h = split(documents.pop(r.doc_id)), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        own = plain(words) if n < 2000 else [tuple(x) for x in runs.runs_of(words, [(0, n)])]
        best = min(own, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        listed = "".join(f"{s},{m},{q}\n" for s, m, q in own)
        assert tuple(r)[:5] == (r.doc_id, len(own), *best) and r.exponent_milli == (1000 * best[1] // best[2] if own else None)
        assert r.runs_sha256 == hashlib.sha256(listed.encode()).hexdigest() and r.collapsed_sha256 == hashlib.sha256(collapsed(words, own).encode()).hexdigest()
    assert not documents


def test_planted_texts_on_awkward_rows(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate([None, "", "  ", "one", " a  b\tc "] * 20)] + [(None, "a b")], "doc_id long, text string")
    got = queries.planted(table).collect()
    assert len(got) == 101
    for r in got:
        if r.doc_id is not None:
            words, h = split([None, "", "  ", "one", " a  b\tc "][r.doc_id % 5]), zlib.crc32(str(r.doc_id).encode())
            if h % 10 == 0 and words:
                a = h // 10 % len(words)
                p = 1 + (len(words) - a) // (3 + h // 10 % 8)
                words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            assert split(r.text) == words
