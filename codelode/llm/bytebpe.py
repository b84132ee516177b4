"""Byte-level BPE by speculation and verification.

A word is first cut by greedy longest match.  A cut is the true BPE cut exactly
if every adjacent pair of its tokens is *compatible*: merging the two tokens'
bytes on their own never merges across their border.  Pairs of all new words of a
slice are tested together with array operations; only words with a failing pair
are merged step by step.  Words already seen by the worker come from a cache.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pandas as pd
import regex

from codelode.llm import spans

LETTER, NUMBER, OTHER, SPACE = range(4)
NEVER = np.int64(1 << 40)
CACHE_WORDS = 1_500_000
LONG_WORD = 40
FILTER_BITS = 22


@lru_cache(1)
def _classes() -> np.ndarray:
    """The pre-tokenizer's class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        table[[ord(c) for c in regex.findall(pattern, every)]] = kind
    return table


def byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character; all bytes of a character have the same."""
    kinds = _classes()[:256][data]
    high = np.flatnonzero(data >= 0xC0)
    if len(high):
        padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
        lead, a, b, c = (padded[high + k] for k in range(4))
        two = (lead & 31) << 6 | a & 63
        three = (lead & 15) << 12 | (a & 63) << 6 | b & 63
        four = (lead & 7) << 18 | (a & 63) << 12 | (b & 63) << 6 | c & 63
        point = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, np.minimum(four, 0x10FFFF)))
        kind = _classes()[point]
        for k, some in ((0, slice(None)), (1, slice(None)), (2, lead >= 0xE0), (3, lead >= 0xF0)):
            at = high[some] + k
            kinds[at[at < len(data)]] = kind[some][at < len(data)]
    return kinds


def pretoken_starts(data: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Marks the first byte of each pre-token; ``heads`` are the first bytes of texts."""
    opens = np.zeros(len(data), bool)
    if not len(data):
        return opens
    kinds = byte_classes(data)
    head = np.zeros(len(data) + 3, bool)
    head[heads] = True
    head[len(data) :] = True
    opens[1:] = kinds[1:] != kinds[:-1]
    opens[heads] = True
    # The last white space before a word stands alone, or belongs to the word if it is a blank.
    after = 1 + np.flatnonzero((kinds[1:] != SPACE) & (kinds[:-1] == SPACE) & ~head[1 : len(data)])
    before = after - 1
    for _ in range(3):
        before = before - ((data[before] & 0xC0) == 0x80)
    opens[before] = True
    opens[after[data[after - 1] == 32]] = False
    # Endings such as 's and 'll, where the apostrophe opens a pre-token.
    quote = np.flatnonzero((data == 39) & opens)
    quote = quote[~head[quote + 1]]
    quote = quote[kinds[quote + 1] == LETTER]
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[quote + 1], np.where(head[quote + 2], 0, padded[quote + 2])
        length = np.where(np.isin(one, list(b"stmd")), 1, 0)
        for ending in (b"re", b"ve", b"ll"):
            length[(one == ending[0]) & (two == ending[1])] = 2
        quote, length = quote[length > 0], length[length > 0]
        opens[quote + 1] = False
        rest = quote + 1 + length
        rest = rest[~head[rest]]
        opens[rest] = True
    return opens


def _byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBPE:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.bytes_of |= {i: t for t, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        self.id_of = {self.bytes_of[i]: i for i in vocab.values()}
        self.rank = np.full(self.size, -1, np.int64)
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = (merge.split(" ") if isinstance(merge, str) else merge)
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank[z], self.left[z], self.right[z] = k, x, y
            self.merges[x, y] = (k, z)
        keys = np.array([x << 32 | y for x, y in self.merges], np.int64)
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_ranks = np.array([k for k, _ in self.merges.values()], np.int64)[order]
        self.spine = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        usable = self._reachable()
        self.greedy = {t: i for t, i in self.id_of.items() if usable[i]}
        self.longest = max(map(len, self.greedy))
        # One table of all token bytes, and the hashes of those that greedy matching may take.
        pieces = [self.bytes_of.get(i, b"") for i in range(self.size)]
        self.token_length = np.array([len(p) for p in pieces], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.array(sorted(self.greedy.values()), np.int64)
        hashed = spans.SpanHasher(self.token_bytes)(self.token_start[ids], self.token_start[ids] + self.token_length[ids])
        order = np.argsort(hashed)
        self.hash_keys, self.hash_ids = hashed[order], ids[order]
        self.made_by_rank = np.argsort(np.where(self.rank < 0, NEVER, self.rank))
        self.byte_id = np.array([self.id_of.get(bytes([k]), 0) for k in range(256)], np.int64)
        self.hash_filter = np.zeros(1 << FILTER_BITS, bool)
        self.hash_filter[hashed >> np.uint64(64 - FILTER_BITS)] = True
        self._forget()

    def _forget(self) -> None:
        """Words seen: hashes in order and the slot of each; a dict takes several times as much."""
        self.seen = np.zeros(0, np.uint64)
        self.slots = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.starts = np.zeros(1 << 14, np.int32)
        self.counts = np.zeros(1 << 14, np.int32)

    def pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keys = x << 32 | y
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NEVER)

    def compatible(self, x: np.ndarray, y: np.ndarray, inner: bool = False) -> np.ndarray:
        """Whether no merge crosses the border of x and y.

        Goes back in time from the finished tokens: the symbol formed last at the
        border falls apart first.  A merge across happens if its rank comes before
        both neighbours grow on (of equal ranks the left place goes first).
        ``inner``: the finished tokens themselves may merge.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        good = np.ones(len(x), bool)
        until_x, until_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        at, first = np.arange(len(x)), True
        while len(at):
            if not (first and inner):
                rank = self.pair_rank(x[at], y[at])
                bad = (rank < until_x[at]) & (rank <= until_y[at])
                good[at[bad]] = False
                at = at[~bad]
            first = False
            rank_x, rank_y = self.rank[x[at]], self.rank[y[at]]
            at, rank_x, rank_y = (v[np.maximum(rank_x, rank_y) >= 0] for v in (at, rank_x, rank_y))
            split = rank_x >= rank_y
            left, right = at[split], at[~split]
            until_x[left], x[left] = rank_x[split], self.right[x[left]]
            until_y[right], y[right] = rank_y[~split], self.left[y[right]]
        return good

    def compatible_pair(self, x: int, y: int) -> bool:
        """:meth:`compatible` for one pair."""
        until_x = until_y = NEVER
        rank, left, right = self.spine
        while True:
            if (found := self.merges.get((x, y))) and found[0] < until_x and found[0] <= until_y:
                return False
            if rank[x] < 0 and rank[y] < 0:
                return True
            if rank[x] >= rank[y]:
                until_x, x = rank[x], right[x]
            else:
                until_y, y = rank[y], left[y]

    def _reachable(self) -> np.ndarray:
        """Tokens that their own bytes are merged to."""
        made = np.flatnonzero(self.rank >= 0)
        fine = np.zeros(self.size, bool)
        fine[[i for i in self.id_of.values() if self.rank[i] < 0 and len(self.bytes_of[i]) == 1]] = True
        sound = self.compatible(self.left[made], self.right[made], inner=True)
        for i, ok in sorted(zip(made.tolist(), sound.tolist(), strict=True), key=lambda p: self.rank[p[0]]):
            fine[i] = ok and fine[self.left[i]] and fine[self.right[i]]
        return fine

    def merge_exactly(self, word: bytes) -> list[int]:
        """Plain BPE of one word: the lowest rank first, of equal ranks the leftmost."""
        symbols = [self.id_of[word[k : k + 1]] for k in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
        heap = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < len(word) and (found := self.merges.get((symbols[k], symbols[after[k]]))):
                heapq.heappush(heap, (found[0], k, symbols[k], symbols[after[k]], found[1]))

        for k in range(len(word)):
            offer(k)
        while heap:
            _, k, x, y, made = heapq.heappop(heap)
            if symbols[k] != x or after[k] >= len(word) or symbols[after[k]] != y:
                continue
            gone = after[k]
            symbols[k], symbols[gone], after[k] = made, -1, after[gone]
            if after[gone] < len(word):
                before[after[gone]] = k
            offer(before[k])
            offer(k)
        return [s for s in symbols if s >= 0]

    def merge_many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Plain BPE of many short words side by side, one merge of each per round: word of each token, token."""
        lengths = ends - starts
        owner = np.repeat(np.arange(len(starts)), lengths)
        symbol = self.byte_id[data[spans.spread_positions(starts, lengths)]]
        done_owner, done_symbol = [], []

        def ranks(at: np.ndarray) -> np.ndarray:
            after = np.minimum(at + 1, len(symbol) - 1)
            return np.where((at < after) & (owner[at] == owner[after]), self.pair_rank(symbol[at], symbol[after]), NEVER)

        rank = ranks(np.arange(len(symbol)))
        while len(symbol):
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            sizes = np.diff(heads, append=len(owner))
            least = np.minimum.reduceat(rank, heads)
            over = np.repeat(least == NEVER, sizes)
            if over.any():
                done_owner.append(owner[over])
                done_symbol.append(symbol[over])
                owner, symbol, rank, sizes, least = owner[~over], symbol[~over], rank[~over], sizes[least < NEVER], least[least < NEVER]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            at = at[np.diff(owner[at], prepend=-1) != 0]
            symbol[at] = self.made_by_rank[rank[at]]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            owner, symbol, rank = owner[stay], symbol[stay], rank[stay]
            at = at - np.arange(len(at))
            rank[at] = ranks(at)
            left = at[at > 0] - 1
            rank[left] = ranks(left)
        word = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        token = np.concatenate(done_symbol) if done_symbol else np.zeros(0, np.int64)
        return word, token

    def _speculate(self, hasher: spans.SpanHasher, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of many words at once: word of each token, token; in order by word."""
        words, tokens, place, owner = [], [], starts.copy(), np.arange(len(starts))
        while len(owner):
            room = ends[owner] - place
            found = np.full(len(owner), -1, np.int64)
            for length in range(min(self.longest, int(room.max())), 0, -1):
                some = np.flatnonzero((found < 0) & (room >= length))
                if len(some):
                    keys = hasher(place[some], place[some] + length)
                    likely = self.hash_filter[keys >> np.uint64(64 - FILTER_BITS)]
                    some, keys = some[likely], keys[likely]
                    at = np.minimum(np.searchsorted(self.hash_keys, keys), len(self.hash_keys) - 1)
                    hit = (self.hash_keys[at] == keys) & (self.token_length[self.hash_ids[at]] == length)
                    found[some[hit]] = self.hash_ids[at[hit]]
            words.append(owner)
            tokens.append(found)
            place = place + self.token_length[found]
            keep = place < ends[owner]
            place, owner = place[keep], owner[keep]
        word = np.concatenate(words) if words else np.zeros(0, np.int64)
        token = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return word[order], token[order]

    def _greedy_long(self, word: bytes) -> list[int]:
        found, k = [], 0
        while k < len(word):
            for length in range(min(self.longest, len(word) - k), 0, -1):
                if (token := self.greedy.get(word[k : k + length])) is not None:
                    break
            found.append(token)
            k += length
        return found

    def encode_words(self, data: np.ndarray, hasher: spans.SpanHasher, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of the words, one word after the other, and their number in each word."""
        long = ends - starts > LONG_WORD
        word, token = self._speculate(hasher, starts[~long], ends[~long])
        word = np.flatnonzero(~long)[word]
        for k in np.flatnonzero(long).tolist():
            more = self._greedy_long(data[starts[k] : ends[k]].tobytes())
            word, token = np.append(word, np.full(len(more), k)), np.append(token, more)
        if long.any():
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        same = word[1:] == word[:-1]
        pairs, where = np.unique(token[:-1][same] << 32 | token[1:][same], return_inverse=True)
        bad = ~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failing = np.unique(word[1:][same][bad[where]])
        if len(failing):
            keep = ~np.isin(word, failing)
            word, token = [word[keep]], [token[keep]]
            short = failing[~long[failing]]
            some, exact = self.merge_many(data, starts[short], ends[short])
            word.append(short[some])
            token.append(exact)
            for k in failing[long[failing]].tolist():
                exact = self.merge_exactly(data[starts[k] : ends[k]].tobytes())
                word.append(np.full(len(exact), k))
                token.append(np.array(exact, np.int64))
            word, token = np.concatenate(word), np.concatenate(token)
            order = np.argsort(word, kind="stable")
            word, token = word[order], token[order]
        return token, np.bincount(word, minlength=len(starts))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that lie side by side, and the n + 1 offsets of each text's ids.

        Texts that hold a special token's string are cut around it, as the library does.
        """
        bounds, single = self.segments(data, offsets)
        if not single:
            return self._encode(data, offsets)
        ids, at = self._encode(data, bounds)
        parts, lengths = [], []
        for k, low in enumerate(bounds[:-1].tolist()):
            part = np.array([single[low]], np.uint32) if low in single else ids[at[k] : at[k + 1]]
            parts.append(part)
            lengths.append(len(part))
        total = np.concatenate([[0], np.cumsum(lengths)])
        return np.concatenate(parts), total[np.searchsorted(bounds, offsets)]

    def segments(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Bounds of texts and special strings, and the special id that starts at a bound."""
        text = data.tobytes()
        cuts = [(m.start(), m.end(), i) for s, i in self.special.items() if s in text for m in regex.finditer(regex.escape(s), text)]
        if cuts:
            heads = set(offsets.tolist())
            cuts = [c for c in cuts if not heads.intersection(range(c[0] + 1, c[1]))]
        if not cuts:
            return offsets, {}
        return np.unique(np.concatenate([offsets, np.array([p for c in cuts for p in c[:2]], np.int64)])), {c[0]: c[2] for c in cuts}

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        heads = offsets[:-1][offsets[:-1] < len(data)]
        starts = np.flatnonzero(pretoken_starts(data, heads))
        ends = np.append(starts[1:], len(data))
        hasher = spans.SpanHasher(data)
        codes, unique = pd.factorize(hasher(starts, ends))
        slot = np.full(len(unique), -1, np.int64)
        if len(self.seen):
            at = np.minimum(np.searchsorted(self.seen, unique), len(self.seen) - 1)
            slot = np.where(self.seen[at] == unique, self.slots[at], slot)
        fresh = np.flatnonzero(slot < 0)
        if len(fresh):
            if len(self.seen) + len(fresh) > CACHE_WORDS:
                self._forget()
                fresh = np.arange(len(unique))
            first = np.full(len(unique), len(codes), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            token, count = self.encode_words(data, hasher, starts[first[fresh]], ends[first[fresh]])
            slot[fresh] = self._store(unique[fresh], token, count)
        slot = slot[codes]
        counts = self.counts[slot].astype(np.int64)
        ids = self.pool[spans.spread_positions(self.starts[slot], counts)]
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, offsets)]

    def _store(self, hashes: np.ndarray, token: np.ndarray, count: np.ndarray) -> np.ndarray:
        slots = np.arange(len(self.seen), len(self.seen) + len(hashes))
        while self.used + len(token) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while slots[-1] >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        self.pool[self.used : self.used + len(token)] = token
        self.starts[slots] = self.used + np.cumsum(count) - count
        self.counts[slots] = count
        self.used += len(token)
        order = np.argsort(hashes)
        at = np.searchsorted(self.seen, hashes[order])
        self.seen = np.insert(self.seen, at, hashes[order])
        self.slots = np.insert(self.slots, at, slots[order])
        return slots

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        return self.token_bytes[spans.spread_positions(self.token_start[ids], self.token_length[ids])]


@lru_cache(2)
def load(path: str) -> ByteBPE:
    """One vocabulary per Python worker; only its path travels with the task."""
    return ByteBPE(path)
