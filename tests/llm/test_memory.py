"""What a Python worker holds: the tokenizer's cache, and n-grams on their way to a shuffle."""

import collections
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from codelode.llm import bytebpe, lm, spans

BPE = public_tokenizers.path("byte_bpe_50k.json")


def made_up(count, seed):
    """Texts of different invented words; every 1,000 words are one text."""
    letters = np.random.default_rng(seed).integers(97, 123, (count, 7)).astype(np.uint8)
    raw = [bytes(row).decode() for row in letters]
    return [" ".join(raw[k : k + 1000]) for k in range(0, count, 1000)]


def held(work):
    """Bytes that stay, and the most at once, above what there was before."""
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        work()
        return [x - before for x in tracemalloc.get_traced_memory()]
    finally:
        tracemalloc.stop()


def test_cache_of_words_is_compact():
    bpe, words = bytebpe.ByteBPE(BPE), 100_000
    pieces = [spans.flat(pa.array([text])) for text in made_up(words, 1)]
    stays, _ = held(lambda: [bpe.encode(*piece) for piece in pieces])
    assert stays / words < 80  # a dict of hashes and slots alone takes more
    assert len(bpe.seen) >= 0.99 * words


@pytest.mark.parametrize("limit", [10, 1500, 1_500_000])
def test_cache_forgets_and_stays_right(monkeypatch, limit):
    monkeypatch.setattr(bytebpe, "CACHE_WORDS", limit)
    bpe, library = bytebpe.ByteBPE(BPE), Tokenizer.from_file(BPE)
    texts = made_up(6000, 2)
    for text in [*texts, *texts[::-1], "", texts[0] + " x\n\ny" + texts[1]]:
        ids, cuts = bpe.encode(*spans.flat(pa.array([text])))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and cuts.tolist() == [0, len(ids)]


class _Driver:
    """Stands for a table: keeps the function that its tasks run."""

    sparkSession = property(lambda self: self)
    sparkContext = property(lambda self: self)
    run = None

    def broadcast(self, value):
        self.value = value
        return self

    def mapInArrow(self, run, schema):
        _Driver.run = staticmethod(run)
        raise StopIteration


def sent(texts, size, bits=6):
    full = np.full(1 << 20, ~np.uint64(0))
    with pytest.raises(StopIteration):
        lm._grams(_Driver(), size, full, 1, bits)
    return lambda: _Driver.run(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))


def test_slice_of_ngrams_is_sent_in_parts():
    texts = made_up(1_000_000, 3)
    run, most = sent(texts, 2), []
    top = held(lambda: most.extend(batch.nbytes for batch in run()))[1]
    assert max(most) <= 16 << 20  # a slice of 8 bytes a word has 24 bytes for each
    assert top < 18 * sum(map(len, texts))


@pytest.mark.parametrize("size", [2, 3])
@pytest.mark.parametrize("at_once", [1, 50, 1 << 18])
def test_every_ngram_is_sent_once(monkeypatch, size, at_once):
    monkeypatch.setattr(lm, "SENT_GRAMS", at_once)
    texts = ["a b a b c", None, "", "a b", *made_up(3000, 4)]
    found = {}
    for batch in sent(texts, size)():
        for row in batch.to_pylist():
            grams, lefts, counts = (np.frombuffer(row[c], np.int64).tolist() for c in ("grams", "lefts", "counts"))
            assert all(np.uint64(g & 2**64 - 1) >> np.uint64(58) == row["range"] for g in grams) and lefts == sorted(lefts, key=lambda x: x & 2**64 - 1)
            found |= {g: (left, n) for g, left, n in zip(grams, lefts, counts, strict=True)} if not found.keys() & set(grams) else pytest.fail("sent twice")
    names, whole, _ = lm._names(*spans.flat(pa.array(texts)), size)
    places = np.flatnonzero(whole[-1])
    expected = collections.Counter(names[-1][places].view(np.int64).tolist())
    left = dict(zip(names[-1][places].view(np.int64).tolist(), names[-2][places].view(np.int64).tolist(), strict=True))
    assert found == {g: (left[g], n) for g, n in expected.items()}
