"""Periodic runs of words: a suffix automaton whose link tree is accessed as a link-cut tree.

1. Words that can lie in a run.  Behind its first period every word of a run recurs within
   one period, and a run of ``r`` words behind its first period has a period of at most
   ``r / (times - 1)``.  So a stretch of words that recur can only hold periods up to that
   share of its length, words that recur farther away split it, and so on until nothing
   changes.  What is left, with one period before it, holds every run; nothing is lost.
2. The suffix automaton of such a stretch is built.  Then its words are appended one by
   one: access of the state of the prefix recolours the path to the root with the word's
   position.  The path consists of segments of equal last occurrence; where the distance
   from there to the position lies within the lengths of a segment, the words between
   form a primitive square.  Preferred paths are splay trees, so a text of n words takes
   O(n log n) steps in all.
3. A square is extended to both sides once for each run.

A task works on slices of about a megabyte of text.  The automaton takes a few hundred
bytes for each word of the longest such stretch of one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm import spans

LEAST = 6
TIMES = 4
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
RUNS_SQL = "n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


class SuffixAutomaton:
    """States are numbered from 1, the root; 0 is none.  ``ends`` are the states of the prefixes."""

    def __init__(self, words: list[int]):
        self.length, self.link, self.ends = [0, 0], [0, 0], []
        length, link, steps = self.length, self.link, [{}, {}]
        last = 1
        for word in words:
            state = len(length)
            length.append(length[last] + 1)
            link.append(1)
            steps.append({})
            at = last
            while at and word not in steps[at]:
                steps[at][word] = state
                at = link[at]
            if at:
                onto = steps[at][word]
                if length[onto] == length[at] + 1:
                    link[state] = onto
                else:
                    copy = len(length)
                    length.append(length[at] + 1)
                    link.append(link[onto])
                    steps.append(steps[onto].copy())
                    link[onto] = link[state] = copy
                    while at and steps[at].get(word) == onto:
                        steps[at][word] = copy
                        at = link[at]
            last = state
            self.ends.append(state)


class LinkCutAccess:
    """Preferred paths of a rooted tree as splay trees; each path has one colour.

    ``over`` is the parent in the splay tree, or for its root the node above the path."""

    def __init__(self, parents: list[int]):
        self.over = list(parents)
        self.left, self.right, self.colour = ([0] * len(parents) for _ in range(3))

    def _splay(self, x: int) -> None:
        over, left, right = self.over, self.left, self.right
        root = x
        while (p := over[root]) and (left[p] == root or right[p] == root):
            root = p
        if root == x:
            return
        while (p := over[x]) and (left[p] == x or right[p] == x):
            g = over[p]
            if g and (left[g] == p or right[g] == p):
                self._rotate(p if (left[g] == p) == (left[p] == x) else x)
            self._rotate(x)
        self.colour[x] = self.colour[root]

    def _rotate(self, x: int) -> None:
        over, left, right = self.over, self.left, self.right
        p = over[x]
        g = over[p]
        if left[p] == x:
            b = left[p] = right[x]
            right[x] = p
        else:
            b = right[p] = left[x]
            left[x] = p
        if b:
            over[b] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        over[x], over[p] = g, x

    def access(self, node: int, colour: int) -> Iterator[tuple[int, int, int]]:
        """Recolours the path from ``node`` to the root; yields what its segments were:
        colour (0: none), deepest node, and the node above the segment (0: none)."""
        x, below = node, 0
        while x:
            self._splay(x)
            deeper = self.right[x]
            if deeper:
                self.colour[deeper] = self.colour[x]
            self.right[x] = below
            yield self.colour[x], x, self.over[x]
            below, x = x, self.over[x]
        self.colour[below] = colour
        self._splay(node)


def squares(words: list[int]) -> Iterator[tuple[int, int]]:
    """(last word, period) of every primitive square."""
    automaton = SuffixAutomaton(words)
    tree, length = LinkCutAccess(automaton.link), automaton.length
    for k, state in enumerate(automaton.ends, 1):
        for before, deepest, above in tree.access(state, k):
            if before and length[above] < k - before <= length[deepest]:
                yield k - 1, k - before


def runs_of(words: list[int], windows: list[tuple[int, int]], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """The runs (start, length, period) of at least ``least`` words and ``times`` periods, in order."""
    found, latest, n = set(), {}, len(words)
    for low, high in windows:
        for last, period in squares(words[low:high]):
            end, start = low + last, low + last - 2 * period + 1
            seen = latest.get(period)
            if seen and seen[0] <= start and end <= seen[1]:
                continue
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            while end + 1 < n and words[end + 1] == words[end + 1 - period]:
                end += 1
            latest[period] = start, end
            if end - start + 1 >= max(least, times * period):
                found.add((start, end - start + 1, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def candidates(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> dict[int, list[tuple[int, int]]]:
    """Windows of words of each text that can hold runs; texts without any are left out."""
    starts, ends = spans.word_spans(data, offsets)
    if not len(starts):
        return {}
    own = spans.SpanHasher(data)(starts, ends)  # a clash only makes a window larger
    firsts = np.searchsorted(starts, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
    order = np.argsort(own, kind="stable")
    same = (own[order[1:]] == own[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    distance = np.full(len(starts), np.iinfo(np.int64).max)
    distance[order[1:][same]] = (order[1:] - order[:-1])[same]
    kept = np.flatnonzero(distance <= np.diff(firsts)[text] // times)
    while len(kept):
        opens = (np.diff(kept, prepend=-2) != 1) | (np.diff(text[kept], prepend=-1) != 0)
        first = np.flatnonzero(opens)
        size = np.diff(np.append(first, len(kept)))
        bound = np.where(size + size // (times - 1) >= least, size // (times - 1), 0)
        stay = distance[kept] <= np.repeat(bound, size)
        if stay.all():
            break
        kept = kept[stay]
    windows: dict[int, list[tuple[int, int]]] = {}
    if len(kept):
        for at, count, period in zip(kept[first].tolist(), size.tolist(), bound.tolist(), strict=True):
            own_first = int(firsts[text[at]])
            windows.setdefault(int(text[at]), []).append((max(0, at - own_first - period), at - own_first + count))
    return windows


def _work(least: int, times: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = spans.flat(batch.column("text"))
            for first, last, part, cuts in spans.slices(data, offsets):
                windows, raw = candidates(part, cuts, least, times), part.tobytes()
                counts, found, texts = [], [], []
                for k in range(last - first):
                    words = raw[cuts[k] : cuts[k + 1]].split()  # bytes are split at the six ASCII blanks only
                    counts.append(len(words))
                    runs: list[tuple[int, int, int]] = []
                    if k in windows:
                        numbers: dict[bytes, int] = {}
                        runs = runs_of([numbers.setdefault(w, len(numbers)) for w in words], windows[k], least, times)
                        gone = np.zeros(len(words), bool)
                        for start, length, period in runs:
                            gone[start + period : start + length] = True
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                    texts.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(counts, pa.int64()), pa.array(found, _RUN), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "text"])

    return run


def find_runs(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per row: doc_id, n_words, runs and text.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared byte by byte.  ``runs`` lists every stretch
    with smallest period q of at least ``max(least, times * q)`` words that no neighbour
    extends, by start, then period.  ``text`` is the words joined by one blank without
    those that lie in a run behind its first period.  NULL and empty texts have no words,
    no runs and an empty text; ids are passed on as they are, repeated rows each count, and
    no rows give no rows.  Other columns are not read.  ``times`` is at least 2.
    """
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(_work(least, times), f"doc_id {dict(rows.dtypes)['doc_id']}, {RUNS_SQL}")
