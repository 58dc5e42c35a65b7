"""Content-chosen anchors: every window of ``length`` bytes holds one, and equal
windows hold the same one at the same place.

A window's anchor is its k-gram with the smallest hash (the leftmost of equal
ones), so neighbouring windows share theirs. A *stretch* is a run of window
starts with one anchor: its bytes go from the first start to the end of the last
window. Equal windows of any two texts lie in stretches with the same anchor hash.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 16 << 20  # a longer text is cut here; a cut stretch is still found by its anchor
_POS_BITS = 26
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _table(seed: int) -> np.ndarray:
    """256 words from a counter."""
    return _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_GRAM, _BYTES, _BYTES2 = _table(11), _table(12), _table(13)
_GRAM_BASE, _BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_UNBASE = pow(_BASE, -1, 1 << 64)


class _Powers:
    """Powers of the base and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int):
        if len(self.up) < n:
            up, down = np.full(n, _BASE, _U), np.full(n, _UNBASE, _U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up, self.down


_POWERS = _Powers()


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes from each place (k a power of two)."""
    h, size, base = _GRAM[data], 1, _GRAM_BASE
    while size < k:
        h = h[:len(h) - size] * _U(base) + h[size:]
        size, base = 2 * size, base * base % (1 << 64)
    return _mix(h)


def range_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes from each ``lo`` to ``hi``."""
    up, down = _POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((_BYTES2 if second else _BYTES)[data] * up[:len(data)], out=sums[1:])
    return _mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(_U) * _U(0xA0761D6478BD642F))


def _smallest(keys: np.ndarray, width: int) -> np.ndarray:
    """The smallest of the ``width`` keys from each place."""
    m, span = keys, 1
    while 2 * span <= width:
        m = np.minimum(m[:len(m) - span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[:len(m) - rest], m[rest:]) if rest else m


def stretches(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """Stretches of the texts that lie in ``data`` from ``offsets[i]`` to ``offsets[i + 1]``:
    (anchor hash, hash of the stretch, text, first start, number of starts), starts in
    bytes of the text. Texts shorter than ``length`` have none."""
    out = []
    # whole texts up to a segment together, longer ones in parts
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SEGMENT, side="right")) - 1)
        begin, end = int(offsets[first]), int(offsets[last])
        for at in range(begin, max(begin + 1, end), SEGMENT):
            stop = min(end, at + SEGMENT + length - 1)
            cuts = np.clip(offsets[first:last + 1], at, stop) - at
            got = _segment(data[at:stop], cuts, length, k)
            if got is not None:
                h, c, text, lo, n = got
                text = text + first
                out.append((h, c, text, lo + at - offsets[text], n))
        first = last
    if not out:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    return tuple(np.concatenate(x) for x in zip(*out))


def _segment(data, cuts, length, k):
    if len(data) < length:
        return None
    width = length - k + 1
    grams = gram_hashes(data, k)
    keys = (grams & ~_U((1 << _POS_BITS) - 1)) | np.arange(len(grams), dtype=_U)
    place = (_smallest(keys, width) & _U((1 << _POS_BITS) - 1)).astype(np.int64)
    inside = np.ones(len(data) - length + 1, bool)  # windows that do not cross the end of their text
    for e in cuts[1:]:
        inside[max(0, int(e) - length + 1):int(e)] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return None
    anchor = place[starts]
    new = np.empty(len(starts), bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    lo, n, anchor = starts[at], np.diff(np.append(at, len(starts))), anchor[at]
    content = range_hashes(data, lo, lo + n + length - 1) ^ _mix((anchor - lo).astype(_U) + _U(1))
    text = np.searchsorted(cuts, lo, side="right") - 1
    return grams[anchor].view(np.int64), content.view(np.int64), text, lo, n
