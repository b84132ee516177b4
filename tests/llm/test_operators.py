"""The training-data operators against plain versions, and on awkward rows."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from codelode.llm import bytebpe, classifier, encode, exact_dedup, jaccard, lines, lm, neighbours, packing, pii, radix, spans, token_counts

SF_DIR = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to there again today"
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, BASE), (5, BASE.upper()), (6, BASE.replace(" ", "  ")), (7, BASE + " now"), (8, "one two"), (9, "One  Two"),
    (10, "don't 'tis we'll\r\n\r\n x　 日本 １２ é <|endoftext|>s's 😀"), (11, "x" * 50_000), (12, "ab cd " * 20_000), (13, BASE + "\n" + BASE + "\nshort line\n"),
    (None, BASE), (4, BASE), (15, "mail a.b@c-d.org, +1 (555) 123-4567 or 10.0.0.1; card 4111 1111 1111 1111"), (15, "another text under the same id as the one before it"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    schema = "doc_id long, text string, source string, ids string, spans string, score string, kept string, set_id string, row string, text_hash string, first string, gid string"
    rows = [(i, t, ["a", "b", None][k % 3], *"xxxxxxxxx") for k, (i, t) in enumerate(AWKWARD)]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]


def shingles(text, short=True):
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w and short else [])
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def similar(a, b):
    both = len(a & b)
    return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)


def test_classifier(spark, awkward, empty):
    labels, documents = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("labels", "documents"))
    model = classifier.fit(documents, labels.where(classifier.fold(F.col("doc_id"), 3) != 1))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in classifier.score(documents, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1 and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    rows = classifier.score(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert classifier.score(empty, model).count() == 0
    none = classifier.fit(documents, labels.limit(0))
    assert {r.score for r in classifier.score(awkward, none).collect()} == {0.5}
    assert classifier.keep(awkward, none).columns == awkward.columns


@pytest.mark.parametrize("collide", [False, True])
def test_exact_dedup(awkward, empty, collide):
    found = exact_dedup.exact_dedup(awkward, content_hash=F.lit(0) if collide else None, subtree_bytes=1 << 10)
    groups = collections.defaultdict(list)
    for i, t in AWKWARD:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    want = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in found.collect())
    assert exact_dedup.exact_dedup(empty).count() == 0
    left = exact_dedup.deduplicated(awkward)
    assert left.columns == awkward.columns and left.count() == len(groups)


def test_radix_trie():
    rng, trie, want = random.Random(1), radix.RadixTrie(), {}
    for k in range(2000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(12)))
        node = trie.at(key)
        if key not in want:
            assert node.owner is None
            node.owner = want[key] = k
        assert node.owner == want[key]
    assert sorted(trie.owners()) == sorted(want.values())


def awkward_texts():
    rng = random.Random(5)
    letters = "abc'stredlvm \n\t!1é½　日 <|>A"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [t or "" for _, t in AWKWARD] + ["a<|endoftext|>b<|endoftext|>", " " * 300 + "x", "Ã" * 3000]


def test_bpe_equals_the_library(library):
    texts, bpe = awkward_texts(), bytebpe.load(BPE)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, cuts = bpe.encode(data, offsets)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[cuts[k] : cuts[k + 1]].tolist() for k in range(len(texts))] == want
    assert bpe.decode(ids).tobytes() == data.tobytes()
    assert token_counts.compiled(BPE).count(data, offsets).tolist() == [len(w) for w in want]
    rng = random.Random(2)
    for _ in range(300):  # exact merging of one word, of many, and of a word made of any bytes
        word = bytes(rng.choice(b"the aing\xc3\xa9") for _ in range(rng.randrange(1, 30)))
        many = np.frombuffer(word, np.uint8)
        assert bpe.merge_many(many, np.array([0]), np.array([len(word)]))[1].tolist() == bpe.merge_exactly(word)


def test_encode_and_count_rows(awkward, empty, library):
    want = collections.Counter()
    for i, t in AWKWARD:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert want == collections.Counter(map(tuple, encode.digests(encode.encode(awkward, BPE)).collect()))
    counted = collections.Counter(map(tuple, token_counts.token_counts(awkward, BPE, 1024).collect()))
    assert counted == collections.Counter((i, len((t or "").encode()), n, n > 1024) for i, t in AWKWARD for n in [len(library.encode(t or "", add_special_tokens=False).ids)])
    assert encode.encode(empty, BPE).count() == token_counts.token_counts(empty, BPE, 1).count() == 0


@pytest.mark.parametrize("proportions", [None, {"a": 3.0, "b": 1.0}])
def test_packing(awkward, empty, library, proportions):
    pieces = packing.digests(packing.pack(awkward, BPE, 1, 64, proportions)).toPandas()
    texts = collections.defaultdict(list)
    for i, t in AWKWARD:
        texts[i].append([*library.encode(t or "", add_special_tokens=False).ids, 1])
    assert pieces.length.sum() == sum(len(x) for own in texts.values() for x in own)
    for p in pieces.itertuples():
        own = texts[None if math.isnan(p.doc_id) else int(p.doc_id)]
        assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in own)
    at = pieces.sort_values(["sequence_id", "offset"])
    assert (at.offset == at.groupby("sequence_id").length.cumsum() - at.length).all()
    full = at.groupby("sequence_id").length.sum()
    assert (full.sort_index().iloc[:-1] == 64).all() and full.iloc[-1] <= 64 and list(full.index) == list(range(len(full)))
    assert packing.pack(empty, BPE, 1).count() == 0


def test_mixture_in_windows():
    docs = [{"doc_id": k, "source": "abc"[k % 3], "tokens": 700 + k} for k in range(300)]
    total = sum(d["tokens"] for d in docs)
    queues = [{"source": s, "share": sum(d["tokens"] for d in docs if d["source"] == s) / total, "deficit": 0.0} for s in "abc"]
    taken = collections.defaultdict(collections.Counter)
    for doc, _, length, place in packing._fill(docs, queues, 0, 2048):
        taken[place // 2048][docs[doc]["source"]] += length
    for window in list(taken)[:-2]:
        assert sum(taken[window].values()) == 2048 and all(abs(taken[window][s] - 2048 / 3) < 2 * packing.MIN_PIECE for s in "abc")


def components_of(items):
    up = list(range(len(items)))

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(items)):
        for b in range(a):
            if similar(items[a], items[b]):
                up[find(a)] = find(b)
    return [find(k) for k in range(len(items))]


@pytest.mark.parametrize("block_sets", [2, 2000])
def test_jaccard_join(spark, documents, awkward, empty, block_sets):
    rng, tokens, rows = random.Random(3), [f"w{k}" for k in range(60)], [tuple(r) for r in documents.select("doc_id", "text").limit(150).collect()]
    for k in range(60):  # near copies of one text, some only linked through others
        copy = list(tokens)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(60)] = f"e{rng.randrange(9)}"
        rows.append((1000 + k, " ".join(copy)))
    rows += [(i, t) for i, t in AWKWARD if i != 4 and i != 15 and i is not None]
    sets = [shingles(t) for _, t in rows]
    roots, least = components_of(sets), {}
    for (i, _), root in zip(rows, roots, strict=True):
        least[root] = min(i, least.get(root, i))
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block_sets=block_sets)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()}
    want = {(i, len(s), least[root]) for (i, _), s, root in zip(rows, sets, roots, strict=True) if i > 1999 or (i, len(s)) in {(g[0], g[1]) for g in got}}
    assert want <= got and len(got) == len({(i, len(s), least[r]) for (i, _), s, r in zip(rows, sets, roots, strict=True)})
    if block_sets > 2:
        assert jaccard.near_duplicates(awkward).count() == len(AWKWARD) and jaccard.near_duplicates(empty).count() == 0
        left = jaccard.keep_one(awkward)
        assert left.columns == awkward.columns and {1, 2, 3, 4, 8} <= {r.doc_id for r in left.collect()}


@pytest.mark.parametrize("block_sets", [2, 2000])
def test_line_dedup(documents, awkward, empty, block_sets):
    rows = sorted((r.doc_id, r.text) for r in documents.limit(120).collect())
    gone, before = collections.defaultdict(list), []
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            own = shingles(line, False)
            if any(similar(own, other) for other in before):
                gone[i].append(k)
            if own:
                before.append(own)
    found = {r.doc_id: r for r in lines.dedup_lines(documents.limit(120), block_sets=block_sets).collect()}
    for i, text in rows:
        assert list(found[i].removed) == gone[i] and found[i].n_lines == text.count("\n") + 1
        assert found[i].text == "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone[i])
    if block_sets > 2:
        assert lines.dedup_lines(awkward).count() == len(AWKWARD) and lines.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("block_sets", [2, 2000])
def test_line_dedup_by_tokens(spark, documents, awkward, empty, block_sets):
    twenty = [f"word{k}" for k in range(20)]
    rows = sorted((r.doc_id, r.text) for r in documents.limit(60).collect())
    rows += [(90_000, "Home\nHome | About\n\n" + " ".join(twenty)), (90_001, "home\n\nmore\n" + " ".join(["other" if w == "word9" else w for w in twenty]))]
    rows += [(90_002, "a a a b\na a b\na b\nHome |  About"), (90_003, "x1 x2 x3 x4\nx1 x2 x3 x4 x5\nx1 x2 x3")]
    gone, before = collections.defaultdict(list), []
    for i, text in rows:
        for k, line in enumerate(text.split("\n")):
            own = collections.Counter(words(line))
            n = own.total()
            if any(5 * (both := (own & other).total()) >= 4 * (n + other.total() - both) and both for other in before):
                gone[i].append(k)
            if n:
                before.append(own)
    assert gone[90_001] == [0, 3] and gone[90_002] == [3] and gone[90_003] == [1]
    found = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), words=lines.TOKENS, block_sets=block_sets).collect()
    assert {r.doc_id: list(r.removed) for r in found} == {i: gone[i] for i, _ in rows}
    if block_sets > 2:
        assert lines.dedup_lines(awkward, words=lines.TOKENS).count() == len(AWKWARD) and lines.dedup_lines(empty, words=lines.TOKENS).count() == 0


def test_language_model(documents, awkward, empty):
    training = documents.where(classifier.fold(F.col("doc_id"), 10) != 0)
    texts = [words(r.text) + ["</s>"] for r in training.collect()]
    counts = collections.Counter(w for t in texts for w in t)
    n, v = sum(counts.values()), len(counts)
    for r, (_, text) in zip(sorted(lm.score(awkward.where("doc_id <> 4 AND doc_id <> 15"), training).collect(), key=lambda r: r.doc_id), [x for x in AWKWARD if x[0] not in (None, 4, 15)], strict=True):
        own = words(text) + ["</s>"]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(counts[w] > 0 for w in own), n) and math.isclose(r.base_score, base, rel_tol=1e-9)
    assert lm.score(empty, training).count() == 0
    assert {(r.base_score, r.train_tokens) for r in lm.score(awkward, empty).collect()} == {(0.0, 0)}
    totals, grams, masses = lm._model(training.select("text"), 3, 2)
    known, mass = ({r.gram & 2**64 - 1: r[1] for r in rows.collect()} for rows in (grams, masses))

    def facts(grams):
        return np.array([known.get(x, 0) for x in grams.tolist()], np.int64), np.array([mass.get(x, 0.0) for x in grams.tolist()])

    # after any history the probabilities of all words, of the end and of an unseen word add up to 1
    vocabulary = sorted(counts.keys() - {"</s>"})
    for history in ([], texts[0][:1], texts[0][:2], texts[1][:7], texts[2][3:5], ["never", "seen"], [texts[0][0], "never"]):
        lists = [[*history, w] for w in [*vocabulary, "\x01unseen"]]
        names, whole, bounds = lm._names(*spans.flat(pa.array(map(" ".join, [*lists, history]))), 3)
        machine = lm.Automaton(names, whole, facts, totals, 2)
        before = machine.walk(1, 1 + len(history))
        total = sum(10 ** (machine.walk(int(a) + 1, int(b) - 1) - before) for a, b in zip(bounds[:-2], bounds[1:-1], strict=True))
        total += 10 ** (machine.walk(int(bounds[-2]) + 1, int(bounds[-1])) - before)
        assert math.isclose(total, 1, rel_tol=1e-6)


def test_steps_of_hashes():
    rng = np.random.default_rng(5)
    for grams in ([7], [0, 1, 2**64 - 1], [], rng.integers(0, 2**63, 1000).tolist(), range(5)):
        if len(grams):
            grams = np.unique(np.array(grams, np.uint64))
            assert (lm._unpacked(lm._packed(grams)) == grams).all()


@pytest.mark.parametrize("share", [1e-6, 1e-3])
def test_language_model_keeps_every_ngram_seen_twice(spark, documents, awkward, share):
    # 210,000 tokens, so that a share of 1e-5 would ask for three occurrences
    filler = [(10_000 + k, " ".join(f"f{(k * 97 + j * j) % 5003}" for j in range(2100))) for k in range(100)]
    twice = [(20_000 + k, f"a rare phrase {k % 2} was seen twice only") for k in range(4)]
    training = documents.select("doc_id", "text").limit(100).unionByName(spark.createDataFrame(filler + twice, "doc_id long, text string"))
    asked = training.where("doc_id < 10003 OR doc_id >= 20000").unionByName(awkward.where("doc_id <> 4 AND doc_id <> 15").select((F.col("doc_id") + 30_000).alias("doc_id"), "text"))
    texts = [[*words(r.text), "</s>"] for r in training.collect()]
    seen = [collections.Counter(g for t in texts for g in zip(*(["<s>", *t][k:] for k in range(n)))) for n in (1, 2, 3)]
    tokens, distinct = sum(map(len, texts)), len({w for t in texts for w in t})
    assert tokens > 200_000
    mass = collections.Counter()
    for kept in seen[1:]:
        for g, c in kept.items():
            if c > 1:
                mass[g[:-1]] += c - lm.DISCOUNT

    def p(w, h):
        if not h:
            return (seen[0][w,] + 0.1) / (tokens + 0.1 * (distinct + 1))
        all_h = seen[len(h) - 1][h]
        own = seen[len(h)][(*h, w)]
        return ((own - lm.DISCOUNT) / all_h if own > 1 else 0) + (1 - mass[h] / all_h if all_h > 1 else 1) * p(w, h[1:])

    want = {}
    for r in asked.collect():
        t = ["<s>", *words(r.text), "</s>"]
        want[r.doc_id] = sum(math.log10(p(t[k], tuple(t[max(0, k - 2) : k]))) for k in range(1, len(t)))
    got = {r.doc_id: r.score for r in lm.score(asked, training, lexicon_share=share).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_nearest(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    vectors[100:400] = vectors[7]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [1.0] * 3), (None, [1.0] * 16), (5080, [None] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = neighbours.nearest(table, table.where("vec_id % 100 = 0"), 10).toPandas()
    hit = 0
    for q, own in found.groupby("query_id"):
        scores = vectors.astype(float) @ vectors[q].astype(float)
        scores[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(scores, 9)))[:10]
        hit += len(set(own.vec_id) & set(best))
        assert list(own["rank"]) == list(range(1, 11)) and np.allclose(own.score, scores[own.vec_id]) and (np.diff(own.score) <= 0).all()
    assert found.query_id.nunique() == 30 and hit >= 0.9 * 300
    few = table.where("vec_id < 5")
    assert neighbours.nearest(few, few, 20).count() == 5 * 4
    assert neighbours.nearest(table.limit(0), table.limit(0)).count() == 0
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(50)], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in neighbours.nearest(same, same.where("vec_id = 3"), 5).orderBy("rank").collect()] == [0, 1, 2, 4, 5]


def test_nearest_with_repeated_rows(spark):
    rows = [(3, [1.0, 0.0])] * 30 + [(k, [1.0, 0.0]) for k in range(10, 20)] + [(40, [0.9, 0.1])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, table.where("vec_id = 40"), 5).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in found] == [(1, 3), (2, 10), (3, 11), (4, 12), (5, 13)]


def tight_groups(rng, n):
    """Five eighths of the rows in groups of fifty near copies, the others apart."""
    centres = rng.normal(size=(n // 80, 64))
    grouped = np.repeat(centres, 50, axis=0) / 8 + rng.normal(size=(n // 80 * 50, 64)) * 0.01
    return np.concatenate([grouped, rng.normal(size=(n - len(grouped), 64)) / 8]), len(grouped)


@pytest.mark.parametrize("kind", ["groups", "uniform", "copies"])
def test_recall_of_each_kind_of_table(spark, kind):
    rng = np.random.default_rng(11)
    if kind == "groups":
        vectors, inside = tight_groups(rng, 8000)
    elif kind == "uniform":
        vectors, inside = rng.normal(size=(6000, 16)), 0
    else:  # unit vectors along few axes with very small differences
        vectors, inside = np.eye(32)[rng.integers(0, 32, 6000)] + rng.normal(size=(6000, 32)) * 1e-3, 0
    vectors = vectors.astype(np.float32).astype(np.float64)
    order = rng.permutation(len(vectors))
    table = spark.createDataFrame([(int(k), vectors[j].tolist()) for k, j in enumerate(order)], "vec_id long, embedding array<double>").repartition(4)
    found = neighbours.nearest(table, table.where("vec_id % 20 = 0"), 20).toPandas()
    placed = vectors[order]
    shares, apart = [], []
    for q, own in found.groupby("query_id"):
        scores = placed @ placed[q]
        scores[q] = -np.inf
        kth = np.partition(scores, -20)[-20]
        share = float((own.score >= kth - 1e-9).sum()) / 20
        shares.append(share)
        if order[q] >= inside:
            apart.append(share)
    assert len(shares) == len(placed[::20]) and np.mean(shares) >= 0.9 and np.mean(apart) >= 0.9
    assert np.quantile(shares, 0.05) >= 0.6


def plain_pii(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0:
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii(awkward, empty):
    rng = random.Random(3)
    for _ in range(20_000):
        letters = rng.choice(["ab@.1 ", "1.25 ", "0- 4", "+1() .-23a", "a@b.c+1-é"])
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(45)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == plain_pii(text)
    rows = pii.summary(pii.find_pii(awkward)).collect()
    want = collections.Counter((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_pii(t or "")).encode()).hexdigest()) for i, t in AWKWARD)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in rows) == want
    assert pii.find_pii(empty).count() == 0 and pii.redacted(awkward).columns == awkward.columns
    assert pii.redact("x a@b.co y", pii.find("x a@b.co y")) == "x <email> y"
    assert ("account", 5, 32) in pii.find("IBAN DE89 3704 0044 0532 0130 00") and not pii.find("an account of 1999, see https://a.org/b")


ANCHORS = ["http://", "a://@/", "://", "://@", "xmailto:", "mailto:", "tel:.", "a@", "@a.", "+1 ", "+", "1.1.", "1-", "iban ", "iban1 ", "account no. ", "a/c 1 "]


def old_url(text, kind, start, end):
    """The parser as first written, which reads every address to its end."""
    stop = end
    while stop < len(text) and text[stop] not in pii._URL_END:
        stop += 1
    while stop > end and text[stop - 1] in ".,;:!?)]":
        stop -= 1
    if kind == "person":
        return None if (start and text[start - 1] in pii._ALNUM) or not any(c in pii._ALNUM for c in text[end:stop]) else (start, stop)
    host = text[end:stop].split("/", 1)[0]
    while start and text[start - 1] in pii._SCHEME:
        start -= 1
    return (start, stop) if "@" in host.strip("@") and start < end - 3 else None


def test_url_parser():
    rng = random.Random(12)
    for _ in range(20_000):
        text = "".join(rng.choice(["a", "://", "@", "/", ".", " ", "mailto:", "x+y", ")", "1"]) for _ in range(rng.randrange(14)))
        for mark, kind in (("://", "scheme"), ("mailto:", "person")):
            for m in re.finditer(mark, text):
                assert pii._url(text, kind, m.start(), m.end()) == old_url(text, kind, m.start(), m.end())


@pytest.mark.parametrize("anchor", ANCHORS)
def test_pii_takes_linear_time(anchor):
    def seconds(count):
        begun = time.perf_counter()
        pii.find(anchor * count)
        return time.perf_counter() - begun

    assert seconds(100_000) < 20 * max(0.05, seconds(10_000))  # a square would be a hundredfold


def test_row_slices():
    batch = pa.RecordBatch.from_pylist([{"k": k, "text": t} for k, t in enumerate(["a" * 30, None, "", "b" * 300, "c", "d" * 99])])
    parts = list(spans.row_slices(batch, "text", 100))
    assert [p.num_rows for p in parts] == [3, 1, 2] and pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert list(spans.row_slices(batch.slice(0, 0), "text")) == []


def test_slices_keep_every_text():
    offsets = np.array([0, 0, 5, 5, 900, 901])
    seen = [(a, b) for a, b, _, _ in spans.slices(np.zeros(901, np.uint8), offsets, 100)]
    assert seen[0][0] == 0 and seen[-1][1] == 5 and all(x[1] == y[0] for x, y in zip(seen, seen[1:], strict=False))


def test_pipeline(spark, documents, library):
    pieces = corpus_pipeline.run(spark, SF_DIR).toPandas()
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = classifier.fit(documents, labels.where(classifier.fold(F.col("doc_id"), 3) != 1))
    rows = sorted((r.doc_id, r.text) for r in documents.collect() if model.score((r.text or "").encode()) >= 0.5)
    texts: dict[str, tuple] = {}
    for i, t in rows:
        texts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    rows = list(texts.values())
    sets = [shingles(t) for _, t in rows]
    kept = [rows[k] for k, root in enumerate(components_of(sets)) if k == min(j for j, r in enumerate(components_of_cache(sets)) if r == root)]
    want = {i: [*library.encode(pii.redact(t, pii.find(t)), add_special_tokens=False).ids, 1] for i, t in kept}
    assert pieces.length.sum() == sum(map(len, want.values())) and set(pieces.doc_id) == set(want)
    for p in pieces.itertuples():
        assert zlib.crc32(np.array(want[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32


def test_pipeline_stages_on_no_rows_and_awkward_ones(spark, documents):
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, " \n", None, "b", 2), (3, "word " * 30_000, "en", "a", 150_000), (4, BASE, "en", "c", 90), (5, BASE, "de", None, 90)]
    awkward_docs = spark.createDataFrame(odd, documents.schema)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, documents.limit(0), SF_DIR)
        assert none.count() == 0
        kept = stage(spark, awkward_docs, SF_DIR)
        if name != "packing":
            assert none.columns == documents.columns and kept.columns == documents.columns
        else:
            assert kept.agg(F.sum("length")).first()[0] >= len(odd)  # an empty text still has its last id
        kept.collect()


_CACHE: dict[int, list[int]] = {}


def components_of_cache(sets):
    if id(sets) not in _CACHE:
        _CACHE[id(sets)] = components_of(sets)
    return _CACHE[id(sets)]
