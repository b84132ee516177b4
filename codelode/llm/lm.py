"""Language-model scoring by a weighted backoff automaton that grows with the corpus.

Counting.  Words and n-grams are counted over all training texts.  An n-gram is kept if
it occurs at least ``LEAST`` times, whatever the size of the corpus; only n-grams whose
two shorter parts are kept are counted.  All counts stay distributed tables.

Model.  One word:  p(w) = (c + 0.1) / (N + 0.1 (V + 1)).  After a history h:

    p(w | h) = (c(h w) - D) / c(h)  for a kept n-gram  +  b(h) p(w | h without its first word)
    b(h)     = 1 - sum of (c(h w) - D) / c(h) over the kept n-grams of h

so probabilities after each history add up to 1.

Automaton.  Kept histories are states, kept n-grams are arcs, and each state has a failure
arc of weight log b(h) to the history without its first word.  What defines a state or an
arc are two numbers, the count of its n-gram and the mass ``sum of (c(h w) - D)`` of the
n-grams that go on from it.  A text can only meet states and arcs whose words stand in it,
so each slice of texts asks once for each of its distinct n-grams, gets those two numbers,
builds the part of the automaton that it can meet and walks each text from left to right.

N-grams with a share of at least ``LEXICON_SHARE`` of the tokens (1 / share of each length
at most) are sent to the tasks.  The others are asked for in sorted blocks: a block holds
what one slice wants of one range of hashes, and a range of requests meets the same range
of states in one task.  None of these n-grams is frequent and a slice names each once, so
ranges are alike in size; their number grows with the tokens.  A bitmap of fixed size says
which n-grams may be in the table; once it is full of bits more are asked for in vain and
the result stays the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.llm import spans, tables

ORDER = 3
LEXICON_SHARE = 1e-6
LEAST = 2
DISCOUNT = 0.75
COUNT_BYTES = 16 << 20
SENT_GRAMS = 1 << 18
WALK_BYTES = 4 << 20
RANGE_TOKENS = 1 << 18
FIRST_NAME, END_NAME = (int(x) for x in spans.mix(np.array([0x5EED1, 0x5EED2], np.uint64)))

#: Count and mass of each of some n-grams; zeros for those that are not kept.
Facts = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


class Totals(NamedTuple):
    """Training tokens (words and ends), distinct ones, and texts."""

    tokens: int
    distinct: int
    texts: int


class Automaton:
    """The states and arcs that the words of some texts meet, by position.

    ``names`` and ``whole`` are those of :func:`_names`.  The history of k words that ends at
    a position is one state, told by its length; ``arcs[k]`` has for each position the weight
    of the arc from the k words before it to its word, NaN where there is none; ``fails[k]``
    the weight of the failure arc of the k words that end there; ``ones`` the weight of the
    word itself from the empty history.
    """

    def __init__(self, names: list[np.ndarray], whole: list[np.ndarray], facts: Facts, totals: Totals, least: int):
        size_of_all = len(names[0])
        grams, order, runs = _distinct(names[0])
        of_place = _ranks(order, runs)
        count, mass = facts(grams)
        p = (count + 0.1) / (totals.tokens + 0.1 * (totals.distinct + 1))
        self.known, self.log_one = (count > 0)[of_place], np.log10(p)[of_place]
        self.ones, self.lasting = self.log_one.tolist(), (count >= least)[of_place].astype(int).tolist()
        self.arcs: list[list[float]] = [[]]
        self.fails: list[list[float]] = [[]]
        for size in range(2, len(names) + 1):
            back = np.maximum(1e-12, 1 - mass / np.maximum(count, 1))
            weights = np.zeros(size_of_all)
            ends = np.arange(size_of_all) if size == 2 else place + size - 2
            weights[ends] = np.log10(back)[of_place]
            self.fails.append(weights.tolist())
            place = np.flatnonzero(whole[size - 1])
            gram, order, runs = _distinct(names[size - 1][place])
            first, inverse = order[runs[:-1]], _ranks(order, runs)
            longer, longer_mass = facts(gram)
            fine = longer >= least
            row = np.zeros(size_of_all, np.int64)
            row[ends - size + 2] = of_place
            at = place[first[fine]]
            left, right = row[at], row[at + 1]
            own = np.full(len(gram), np.nan)
            own[fine] = (longer[fine] - DISCOUNT) / count[left] + back[left] * p[right]
            weights = np.full(size_of_all, np.nan)
            weights[place + size - 1] = np.log10(own)[inverse]  # NaN stays NaN
            self.arcs.append(weights.tolist())
            count, mass, p, of_place = longer, longer_mass, own, inverse

    def walk(self, first: int, last: int) -> float:
        """Log10 probability of the words from ``first`` to before ``last``; the mark of the
        beginning stands before ``first``.  One walk from left to right that carries the state."""
        ones, lasting, arcs, fails = self.ones, self.lasting, self.arcs, self.fails
        longest, total = len(arcs) - 1, 0.0
        length = min(lasting[first - 1], longest)
        for at in range(first, last):
            while length:
                weight = arcs[length][at]
                if weight == weight:
                    total += weight
                    if length < longest:
                        length += 1
                    break
                total += fails[length][at - 1]
                length -= 1
            else:
                total += ones[at]
                length = lasting[at] if longest else 0
        return total


def _word_counts(training: DataFrame) -> DataFrame:
    """(gram, n): counts of word hashes, summed up per slice before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.flat(batch.column(0))
            for _, _, outer, bounds in spans.slices(data, offsets, COUNT_BYTES):
                hashes = [spans.word_hashes(part, at)[0] for _, _, part, at in spans.slices(outer, bounds)]
                word, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

    return training.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _names(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For lengths 1 to ``size``: the names of the n-grams that begin at each position of the
    texts with their marks, and whether they end in the same text; then the texts' offsets."""
    hashes, at = spans.word_hashes(data, offsets)
    bounds = at + 2 * np.arange(len(at))
    names = np.full(len(hashes) + 2 * (len(at) - 1), FIRST_NAME, np.uint64)
    names[spans.spread_positions(bounds[:-1] + 1, np.diff(at))] = hashes
    names[bounds[1:] - 1] = END_NAME
    inside = np.ones(len(names), bool)
    inside[bounds[1:] - 1] = False
    every, whole = [names], [np.ones(len(names), bool)]
    while len(every) < size:
        left, right = every[-1][:-1], every[-1][1:]
        whole.append(inside[:-1] if len(every) == 1 else whole[-1][:-1] & whole[-1][1:])
        every.append(_joined(left, right))
    return every, whole, bounds


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of the n-grams whose first and last words but one have these names."""
    return spans.mix(left * np.uint64(0xD1342543DE82EF95) + spans.mix(right + np.uint64(0x9E3779B97F4A7C15)))


def _grams(training: DataFrame, size: int, parts: np.ndarray, least: int, bits: int) -> DataFrame:
    """(gram, left, n): all n-grams of ``size`` words with a count of at least ``least``, and
    their histories; ``parts`` is a bitmap of the kept ones of one word less.

    A slice sends its distinct n-grams as one block for each range of hashes, histories side
    by side so that they compress; a range holds about ``RANGE_TOKENS`` n-grams at most."""
    shared = training.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.flat(batch.column(0))
            for _, _, outer, outer_at in spans.slices(data, offsets, COUNT_BYTES):
                held: list[list[np.ndarray]] = [[], []]
                for _, _, part, at in spans.slices(outer, outer_at):
                    names, whole, _ = _names(part, at, size)
                    fine = tables.has_bit(shared.value, names[-2])
                    at_gram = np.flatnonzero(whole[-1] & fine[:-1] & fine[1:])
                    held[0].append(names[-1][at_gram])
                    held[1].append(names[-2][at_gram])
                # One array after the other, so that a slice is held three times over at most.
                gram = np.concatenate(held.pop(0))
                gram, places, runs = _distinct(gram)
                first, n = places[runs[:-1]], np.diff(runs)
                del places, runs
                left = np.concatenate(held.pop())[first]
                del first
                yield from _sent(gram, left, n, bits)

    def merge(blocks: pa.Table) -> pa.Table:
        gram, left, n = (np.frombuffer(b"".join(blocks[c].to_pylist()), np.int64) for c in ("grams", "lefts", "counts"))
        gram, places, runs = _distinct(gram)
        n = np.diff(np.append(0, np.cumsum(n[places]))[runs])
        kept = n >= least
        return pa.table({"gram": gram[kept], "left": left[places[runs[:-1]][kept]], "n": n[kept]})

    sent = training.mapInArrow(run, "range long, grams binary, lefts binary, counts binary")
    return tables.kept(sent.groupBy("range").applyInArrow(merge, "gram long, left long, n long"), "grams")


def _sent(gram: np.ndarray, left: np.ndarray, n: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Ascending n-grams with histories and counts as blocks by range of hashes, some ranges at once."""
    places = np.flatnonzero(np.diff((gram >> np.uint64(64 - bits)).astype(np.int64), prepend=-1))
    ends, first = np.append(places[1:], len(gram)), 0
    while first < len(places):
        last = max(first + 1, int(np.searchsorted(ends, places[first] + SENT_GRAMS, "right")))
        low, high = places[first], ends[last - 1]
        ranges, cuts = (gram[low:high] >> np.uint64(64 - bits)).astype(np.int64), places[first:last] - low
        order = np.lexsort((left[low:high], ranges))
        blocks = [_blocks(values[low:high][order], cuts) for values in (gram, left, n)]
        yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts]), *blocks], ["range", "grams", "lefts", "counts"])
        first = last


def _blocks(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Runs of 64-bit values as bytes, each up to the next cut."""
    return pa.array([b.tobytes() for b in np.split(values, cuts[1:])] if len(cuts) else [], pa.binary())


def _range_bits(totals: Totals) -> int:
    """Ranges of hashes are named by so many leading bits."""
    return max(1, (totals.tokens // RANGE_TOKENS).bit_length())


def _model(training: DataFrame, order: int, least: int) -> tuple[Totals, DataFrame, DataFrame]:
    """The totals, (gram, n) of all words and kept n-grams, (gram, mass) of the histories."""
    words = tables.kept(_word_counts(training), "word-counts")
    seen = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    texts = training.count()
    marks = training.sparkSession.createDataFrame([(int(np.uint64(m).view(np.int64)), texts) for m in (FIRST_NAME, END_NAME)], "gram long, n long")
    totals = Totals(seen["n"] + texts, seen["v"] + (texts > 0), texts)
    counts, masses = [words.unionByName(marks.where("n > 0"))], []
    parts = tables.bitmap(counts[0].where(F.col("n") >= least), "gram")
    for size in range(2, order + 1):
        if not parts.any():
            break
        counted = _grams(training, size, parts, least, _range_bits(totals))
        counts.append(counted.select("gram", "n"))
        masses.append(counted.groupBy(F.col("left").alias("gram")).agg(F.sum(F.col("n") - DISCOUNT).alias("mass")))
        if size < order:
            parts = tables.bitmap(counted, "gram")
    none = marks.select("gram", F.lit(0.0).alias("mass")).where("false")
    mass = tables.kept(reduce(DataFrame.unionByName, masses, none), "masses")
    return totals, reduce(DataFrame.unionByName, counts), mass


class _Frequent(NamedTuple):
    """Counts and masses of the n-grams that tasks have, by name, and a bitmap of the others."""

    grams: np.ndarray
    counts: np.ndarray
    masses: np.ndarray
    others: np.ndarray

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of n-grams, and whether they are there."""
        return _find(self.grams, grams)

    def wanted(self, names: list[np.ndarray], whole: list[np.ndarray]) -> np.ndarray:
        """The distinct n-grams, in order, that must be asked for."""
        every = (n[w] for n, w in zip(names, whole, strict=True))
        grams = np.sort(np.concatenate([n[tables.has_bit(self.others, n)] for n in every]))
        grams = grams[np.flatnonzero(np.diff(grams, prepend=~grams[:1]))]  # much faster than np.unique
        return grams[~self.find(grams)[1]]


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, the places of all values in order, and where each value's run of places begins."""
    order = np.argsort(values)  # not stable: any place will do, and that is faster than np.unique
    ordered = values[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]))
    return ordered[starts], order, np.append(starts, len(values))


def _ranks(order: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
    return ranks


def _find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def _slices(rows: DataFrame) -> DataFrame:
    """(slice, texts): runs of rows with a few megabytes of text, one compressed blob each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in spans.row_slices(batch, "text", WALK_BYTES):
                blob = pa.BufferOutputStream()
                with pa.ipc.new_stream(blob, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([blob.getvalue().to_pybytes()], pa.binary())], ["slice", "texts"])
                number += 1

    return tables.kept(rows.mapInArrow(run, "slice long, texts binary"), "slices", {"parquet.block.size": str(WALK_BYTES * 4)})


def _texts(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _requests(slices: DataFrame, shared, order: int, bits: int) -> DataFrame:
    """(slice, range, grams): what slices ask for, by ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names, whole, _ = _names(*spans.flat(_texts(blob.as_buffer()).column(1)), order)
                grams = shared.value.wanted(names, whole)
                ranges = (grams >> np.uint64(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(ranges, prepend=-1))
                blocks = pa.array([_packed(b) for b in np.split(grams, cuts[1:])] if len(cuts) else [], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), number)), pa.array(ranges[cuts]), blocks], ["slice", "range", "grams"])

    return slices.mapInArrow(run, "slice long, range long, grams binary")


def _packed(grams: np.ndarray) -> bytes:
    """Ascending numbers: the first one, then steps of as many bytes as the largest takes."""
    steps = np.diff(grams)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + grams[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpacked(block: bytes) -> np.ndarray:
    width = block[0]
    steps = np.frombuffer(block, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(steps) + 1, 8), np.uint8)
    wide[1:, :width] = steps
    wide[0] = np.frombuffer(block, np.uint8, 8, 1)
    return np.cumsum(wide.reshape(-1).view(np.uint64), dtype=np.uint64)


def _answer(asked: pa.Table, states: pa.Table) -> pa.Table:
    """Counts and masses of the n-grams asked for in a range of hashes, in the order asked."""
    known, row = np.unique(states["gram"].to_numpy().view(np.uint64), return_inverse=True)
    count = np.bincount(row, states["n"].to_numpy(), len(known)).astype(np.int64)
    mass = np.bincount(row, states["mass"].to_numpy(), len(known))
    counts, masses = [], []
    for block in asked["grams"].to_pylist():
        at, there = _find(known, _unpacked(block))
        counts.append((count[at] * there if len(known) else np.zeros(len(at), np.int64)).tobytes())
        masses.append((mass[at] * there if len(known) else np.zeros(len(at))).tobytes())
    return pa.table({"slice": asked["slice"], "range": asked["range"], "counts": pa.array(counts, pa.binary()), "masses": pa.array(masses, pa.binary())})


def _known(training: DataFrame, order: int, least: int, lexicon_share: float) -> tuple[Column, Totals, DataFrame, DataFrame, _Frequent]:
    """The model's tables, which of its rows tasks have, and those."""
    with tables.tidy(training.sparkSession):
        totals, counts, mass = _model(training, order, least)
        often = F.col("n") >= max(1.0, lexicon_share * totals.tokens)
        hot = counts.where(often).join(mass, "gram", "left").select("gram", "n", F.coalesce("mass", F.lit(0.0)).alias("mass")).toArrow()
        grams = hot["gram"].to_numpy().view(np.uint64)
        by_name = np.argsort(grams)
        others = tables.bitmap(counts.where(~often), "gram")
    return often, totals, counts, mass, _Frequent(grams[by_name], hot["n"].to_numpy()[by_name], hot["mass"].to_numpy()[by_name], others)


def score(documents: DataFrame, training: DataFrame, order: int = ORDER, lexicon_share: float = LEXICON_SHARE, least: int = LEAST, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    ``training`` holds the texts to learn from.  A token is a word (A-Z lowered) or the
    end of the text; NULL text is empty and has only its end.  Without training texts
    every token has probability 1, as V and N are 0.  Rows with equal ids stay apart.
    """
    often, totals, counts, mass, frequent = _known(training.select(F.col(text_column)), order, least, lexicon_share)
    shared = documents.sparkSession.sparkContext.broadcast(frequent)
    bits = _range_bits(totals)
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def walk(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts, answers = _texts(texts["texts"][0].as_buffer()), answers.sort_by("range")
        data, offsets = spans.flat(texts.column(1))
        names, whole, bounds = _names(data, offsets, order)
        asked = shared.value.wanted(names, whole)
        counts = np.frombuffer(b"".join(answers["counts"].to_pylist()), np.int64)
        masses = np.frombuffer(b"".join(answers["masses"].to_pylist()), np.float64)

        def facts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            count, mass = np.zeros(len(grams), np.int64), np.zeros(len(grams))
            for known, n, m in ((shared.value.grams, shared.value.counts, shared.value.masses), (asked, counts, masses)):
                at, there = _find(known, grams)
                count[there], mass[there] = n[at[there]], m[at[there]]
            return count, mass

        machine = Automaton(names, whole, facts, totals, least)
        sums = [np.zeros(texts.num_rows), np.zeros(texts.num_rows, np.int64), np.zeros(texts.num_rows)]
        for k, (first, last) in enumerate(zip(bounds[:-1] + 1, bounds[1:], strict=True)):
            sums[0][k], sums[1][k], sums[2][k] = machine.log_one[first:last].sum(), machine.known[first:last].sum(), machine.walk(int(first), int(last))
        return pa.table({"doc_id": texts.column(0), "n_tokens": np.diff(bounds) - 1, "n_known": sums[1], "train_tokens": np.full(texts.num_rows, totals.tokens), "base_score": sums[0], "score": sums[2]})

    slices = _slices(rows)
    states = counts.where(~often).select("gram", "n", F.lit(0.0).alias("mass")).unionByName(mass.select("gram", F.lit(0).cast("long").alias("n"), "mass"))
    ranged = states.select(F.shiftrightunsigned("gram", 64 - bits).alias("range"), "gram", "n", "mass")
    asked = _requests(slices, shared, order, bits)
    answers = tables.kept(asked.groupBy("range").cogroup(ranged.groupBy("range")).applyInArrow(_answer, "slice long, range long, counts binary, masses binary"), "answers", {"compression": "zstd"})
    return slices.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(walk, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
