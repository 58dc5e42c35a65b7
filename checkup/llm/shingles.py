"""Word shingles of Arrow text columns, as 63-bit hashes, without per-word Python.

Words are maximal runs of bytes other than blank and ``\\t \\n \\v \\f \\r``,
with A-Z lower-cased. A word's hash is a polynomial over its bytes (through a
table of random numbers) mod 2^64, a shingle's hash a polynomial over its
words' mixed hashes, mixed again. Two different shingles of one comparison
collide with a probability of about 2^-63.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _TABLE[_c] = _TABLE[_c + 32]
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_WORD = np.uint64(0xD6E8FEB86659FD93)
_POWERS: dict = {}


def _powers(n: int):
    """Powers of the base and of its inverse, mod 2^64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the n + 1 offsets of its rows; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if not len(column) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(buffers[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[at[0]:at[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all rows, and the n + 1 offsets of the rows."""
    data, at = text_bytes(column)
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    word = ~_WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    stop = word.copy()
    stop[:-1] &= ~word[1:] | cut[1:n]
    first, last = np.flatnonzero(start), np.flatnonzero(stop) + 1
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[data] * up[:n], out=total[1:])
    h = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * _WORD
    return mix(h), np.searchsorted(first, at)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Each row's distinct shingles as sorted int64 (63 bits). A row with fewer
    words than ``width`` has one shingle of all its words; none: an empty set."""
    words, at = word_hashes(column)
    k = np.uint64(_BASE)
    if len(words) >= width:
        h = words[:len(words) - width + 1].copy()
        for j in range(1, width):
            h = h * k + words[j:len(words) - width + 1 + j]
        h = (mix(h) >> np.uint64(1)).astype(np.int64)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= width:
            s = np.sort(h[a:b - width + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            v = int(words[a])
            for w in words[a + 1:b].tolist():
                v = (v * _BASE + w) % 2**64
            v = np.array([v + (b - a)], np.uint64)
            out.append((mix(v) >> np.uint64(1)).astype(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out


def set_digest(tokens: np.ndarray) -> int:
    """A signed 64-bit digest of a sorted set."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)
