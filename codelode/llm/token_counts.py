"""Token counts by a finite-state transducer.

The vocabulary is compiled to a deterministic transducer over bytes.  After a prefix
of a pre-token a state knows, for each place where a token that is not finished may
have begun, the path in the token trie, the token before it and how many tokens lie
behind it.  Reading a byte, exactly one path closes a token that is compatible with
the one before it; the transition is annotated with the change of the token count.
States are made when they are first met and kept per worker; beyond ``STATES`` of
them the table starts anew, which changes no result.

A text is read in chunks of ``CHUNK`` bytes that run side by side.  A chunk's state map
is constant behind its first pre-token border, so the map is kept as the bytes before
that border, the count behind it and the exit state.  Maps are composed from left to
right over all texts at once; only chunks without any border need a further round.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import bytebpe, spans

CHUNK = 512
STATES = 500_000
IDLE, START = 0, 1
_BIAS, _SHIFT = 126, 24  # a token has up to 128 bytes, so a count falls by 126 at most in one step
_BEHIND = 160
_HASH = 0x9E3779B97F4A7C15


def _packed(parts: list[tuple[int, int, int]]) -> bytes:
    """Parts (trie node, token before, change of the count) as a compact key; a part's change lies within one token's bytes."""
    return array("q", [node << 40 | (last + 1) << 8 | behind + _BEHIND for node, last, behind in parts]).tobytes()


class Transducer:
    def __init__(self, bpe: bytebpe.ByteBPE):
        self.bpe = bpe
        self.kids: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for piece, i in bpe.greedy.items():
            node = 0
            for b in piece:
                if b not in self.kids[node]:
                    self.kids[node][b] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                node = self.kids[node][b]
            self.token[node] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self._restart()

    def _restart(self) -> None:
        self.states: dict[bytes, int] = {b"": IDLE, _packed([(0, -1, 0)]): START}
        self.parts: list[bytes] = list(self.states)
        self._resize(1 << 16)
        for byte in range(256):
            self._put(IDLE << 8 | byte, _BIAS << _SHIFT | IDLE)

    def _resize(self, size: int) -> None:
        """Transitions by (state, byte) in an open-addressed table, so that memory follows those in use."""
        old = [(k, v) for k, v in zip(self.keys.tolist(), self.values.tolist(), strict=True) if k >= 0] if size > 1 << 16 else []
        self.keys, self.values, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
        self.down = np.uint64(65 - size.bit_length())
        for k, v in old:
            self._put(k, v)

    def _put(self, key: int, value: int) -> None:
        at = (key * _HASH & (1 << 64) - 1) >> int(self.down)
        while self.keys[at] >= 0:
            at = (at + 1) % len(self.keys)
        self.keys[at], self.values[at] = key, value
        self.filled += 1
        if self.filled * 3 > len(self.keys):
            self._resize(2 * len(self.keys))

    def _get(self, keys: np.ndarray) -> np.ndarray:
        """The transitions; -1 where none is made yet."""
        at = ((keys.astype(np.uint64) * np.uint64(_HASH)) >> self.down).astype(np.int64)
        there = self.keys[at]
        found = np.where(there == keys, self.values[at], -1)
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.keys)
            there = self.keys[at[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return found

    def _compile(self, state: int, byte: int) -> None:
        rest, change, closed = [], None, -1
        for part in memoryview(self.parts[state]).cast("q"):
            node, last, behind = part >> 40, (part >> 8 & 0xFFFFFFFF) - 1, (part & 255) - _BEHIND
            kid = self.kids[node].get(byte)
            if kid is None:
                continue
            if self.kids[kid]:
                rest.append((kid, last, behind))
            token = self.token[kid]
            if token >= 0 and change is None:
                fits = last < 0 or self.fits.get((last, token))
                if fits is None:
                    fits = self.fits[last, token] = self.bpe.compatible_pair(last, token)
                if fits:
                    change, closed = behind + 1, token
        parts = _packed([*((kid, last, behind - change) for kid, last, behind in rest), (0, closed, 0)])
        after = self.states.setdefault(parts, len(self.parts))
        if after == len(self.parts):
            self.parts.append(parts)
        self._put(state << 8 | byte, (change + _BIAS) << _SHIFT | after)

    def run(self, data: np.ndarray, opens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit state and change of the count of many byte runs, side by side."""
        order = np.argsort(-lengths, kind="stable")
        place, state, change = starts[order], entry[order].astype(np.int64), np.zeros(len(order), np.int64)
        live = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        for n in live.tolist():
            at = place[:n]
            before = np.where(opens[at], START, state[:n])
            keys = before << 8 | data[at]
            packed = self._get(keys)
            unknown = packed < 0
            if unknown.any():
                for key in np.unique(keys[unknown]).tolist():
                    self._compile(key >> 8, key & 255)
                packed[unknown] = self._get(keys[unknown])
            change[:n] += (packed >> _SHIFT) - _BIAS
            state[:n] = packed & ((1 << _SHIFT) - 1)
            place[:n] += 1
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return state[back], change[back]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of texts that lie side by side."""
        bounds, single = self.bpe.segments(data, offsets)
        sizes = np.diff(bounds)
        if single:  # a special string is one token and no text
            special = np.isin(bounds[:-1], list(single))
            counts = self._count(data, bounds[:-1], np.where(special, 0, sizes)) + special
            total = np.concatenate([[0], np.cumsum(counts)])
            return np.diff(total[np.searchsorted(bounds, offsets)])
        return self._count(data, bounds[:-1], sizes)

    def _count(self, data: np.ndarray, heads: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(sizes), np.int64)
        if not sizes.sum():
            return counts
        if len(self.parts) > STATES:
            self._restart()
        opens = bytebpe.pretoken_starts(data, heads[heads < len(data)])
        chunks = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(sizes)), chunks)
        number = spans.spread_positions(np.zeros(len(sizes), np.int64), chunks)
        starts = heads[text] + number * CHUNK
        lengths = np.minimum(CHUNK, heads[text] + sizes[text] - starts)
        # The state maps: bytes before the first border, exit state and count behind it.
        exits, change = self.run(data, opens, starts, lengths, np.full(len(starts), IDLE))
        borders = np.append(np.flatnonzero(opens), len(data))
        head = np.minimum(borders[np.searchsorted(borders, starts)] - starts, lengths)
        constant = head < lengths
        counts += np.bincount(text, change, len(sizes)).astype(np.int64)
        # Their composition: a head is read from the exit of the chunk before it.
        known = constant.copy()
        todo = np.flatnonzero(head > 0)
        while len(todo):
            ready = todo[known[todo - 1]]
            end, change = self.run(data, opens, starts[ready], head[ready], exits[ready - 1])
            counts += np.bincount(text[ready], change, len(sizes)).astype(np.int64)
            through = ready[~constant[ready]]
            exits[through] = end[~constant[ready]]
            waiting = ~known[todo - 1]
            known[through] = True
            todo = todo[waiting]
        return counts


@lru_cache(2)
def compiled(path: str) -> Transducer:
    """One transducer per Python worker."""
    return Transducer(bytebpe.load(path))


def token_counts(documents: DataFrame, tokenizer: str, limit: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and whether there are more than ``limit`` tokens.

    NULL text counts as empty: 0 bytes, 0 tokens.  There is no shuffle.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(tokenizer)
        for batch in batches:
            data, offsets = spans.flat(batch.column(1))
            counts = [machine.count(part, at) for _, _, part, at in spans.slices(data, offsets)]
            tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
