"""Vectorised hashing of the bytes of many texts at once: words, shingles, q-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PRIME = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(PRIME, -1, 1 << 64)
#: Bytes of text hashed in one go.
SLICE = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, SLICE + 1), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def prefix(raw: np.ndarray) -> np.ndarray:
    """h with h[i] = sum of (raw[j] + 1) * PRIME ** j over j < i."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(PRIME, len(raw)), out=out[1:])
    return out


def between(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the bytes [a, b), equal for equal bytes wherever they stand."""
    return (h[b] - h[a]) * powers(INVERSE, len(h))[a]


def slices(column: pa.Array, size: int = SLICE):
    """Consecutive texts of a string column in slices of about size bytes: (first row, bytes, offsets)."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (runs without ASCII white space, ASCII letters in lower case), and of which text."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    solid = ~_SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    first[edges] |= solid[edges]
    last[edges - 1] |= solid[edges - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    return mixed(between(prefix(_LOWER[raw]), a, b)), np.searchsorted(offsets, a, "right") - 1


def shingles(words: np.ndarray, text: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of k words of each text; a text of fewer words has one, of all of them."""
    n = len(words)
    if not n:
        return words, text
    whole = np.arange(n)
    end = np.searchsorted(text, text, "right")
    begin = np.searchsorted(text, text, "left")
    out = np.zeros(n, np.uint64)
    for t in range(k):
        at = whole + t
        inside = at < end
        out += np.where(inside, mixed(words[np.minimum(at, n - 1)], t + 1), np.uint64(0))
    keep = (whole + k <= end) | ((end - begin < k) & (whole == begin))
    return mixed(out[keep], 99), text[keep]
