"""SHA-256 over many rows at once, with states that can be kept, copied and resumed.

A child of a Merkle node enters its parent as 64 hexadecimal digits, which is exactly one
block of SHA-256.  The state between two children is therefore eight whole words, so a
copy of it is a plain value that tables can hold.  Arrays are words x rows, 32 bits wide.
"""

from __future__ import annotations

import numpy as np

ROWS_AT_ONCE = 4096


def _root_fractions(count: int, power: int) -> np.ndarray:
    """The first 32 bits after the point of the roots of the first primes, as the standard defines its constants."""
    primes = [p for p in range(2, 400) if all(p % q for q in range(2, p))][:count]
    found = []
    for p in primes:
        low, high = 0, 1 << 40
        while low + 1 < high:
            middle = (low + high) // 2
            low, high = (middle, high) if middle**power <= p << (32 * power) else (low, middle)
        found.append(low & 0xFFFFFFFF)
    return np.array(found, np.uint32)


START = _root_fractions(8, 2).reshape(8, 1)
_ROUND = _root_fractions(64, 3)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def _compress(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    w = list(words)
    for t in range(16, 64):
        x, y = w[t - 15], w[t - 2]
        w.append(w[t - 16] + w[t - 7] + (_turned(x, 7) ^ _turned(x, 18) ^ (x >> np.uint32(3))) + (_turned(y, 17) ^ _turned(y, 19) ^ (y >> np.uint32(10))))
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + _ROUND[t] + w[t]
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return np.stack(np.broadcast_arrays(a, b, c, d, e, f, g, h)) + state


def absorb(state: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The states after one more block each."""
    count = max(state.shape[1], words.shape[1])
    out = np.empty((8, count), np.uint32)
    for low in range(0, count, ROWS_AT_ONCE):
        part = slice(low, low + ROWS_AT_ONCE)
        out[:, part] = _compress(state[:, part] if state.shape[1] > 1 else state, words[:, part] if words.shape[1] > 1 else words)
    return out


def digits(digest: np.ndarray) -> np.ndarray:
    """The block of 64 hexadecimal digits of each digest."""
    out = np.empty((16, digest.shape[1]), np.uint32)
    for half, x in enumerate((digest >> np.uint32(16), digest & np.uint32(0xFFFF))):
        nibbles = ((x & np.uint32(0xF000)) << np.uint32(12)) | ((x & np.uint32(0x0F00)) << np.uint32(8)) | ((x & np.uint32(0x00F0)) << np.uint32(4)) | (x & np.uint32(0xF))
        letters = ((nibbles + np.uint32(0x06060606)) >> np.uint32(4)) & np.uint32(0x01010101)
        out[half::2] = nibbles + np.uint32(0x30303030) + letters * np.uint32(39)
    return out


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages that ended after that many whole blocks."""
    padding = np.zeros((16, len(blocks)), np.uint32)
    padding[0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    padding[14], padding[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return absorb(state, padding)


def from_bytes(values: list[bytes]) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b"".join(values), ">u4").reshape(len(values), 8).T.astype(np.uint32))


def to_bytes(words: np.ndarray) -> list[bytes]:
    data = np.ascontiguousarray(words.T).astype(">u4").tobytes()
    return [data[k : k + 32] for k in range(0, len(data), 32)]
