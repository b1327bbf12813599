"""Names (64-bit hashes) of words and of stretches of bytes or words, for a whole slice of texts at once.

A stretch is hashed from eight bytes (or one word) at a time, each mixed in by a multiplication and a shift. No sum of powers is used:
sums modulo 2**64 give equal hashes to doubled sequences (a b b a ...) and their complements.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLY = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
#: Longer stretches of bytes are hashed one by one.
LONG = 512
BLOCK = 1 << 15
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    x = x ^ (x >> _HALF)
    x = x * _MULTIPLY
    x ^= x >> _HALF
    x *= _MULTIPLY
    return x ^ (x >> _HALF)


def _seed(seed: int) -> np.uint64:
    return np.uint64((seed * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) % 2**64)


def eights(data: np.ndarray) -> np.ndarray:
    """For each place the eight bytes from there on as a number, zeros beyond the end: a view, not a copy for each place."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _step(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x) * _MULTIPLY
    h ^= h >> _HALF
    return h


def of_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1, view: np.ndarray | None = None) -> np.ndarray:
    """The names of data[start:end], wherever they stand. view: eights(data), where it is at hand."""
    view = eights(data) if view is None else view
    size = end - start
    h = np.full(len(start), _seed(seed), np.uint64)
    short = np.flatnonzero((size > 0) & (size <= LONG))
    k = 0
    while len(short):
        left = size[short] - 8 * k
        h[short] = _step(h[short], view[start[short] + 8 * k] & MASKS[np.minimum(left, 8)])
        short = short[left > 8]
        k += 1
    long = np.flatnonzero(size > LONG)
    if len(long):
        import xxhash

        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[s:e], seed) for s, e in zip(start[long].tolist(), end[long].tolist())]
    return mix(h + size.astype(np.uint64) * _ODD)


def of_numbers(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """The names of values[start:end], 64-bit numbers that stand for words."""
    size = end - start
    h = np.full(len(start), _seed(seed), np.uint64)
    live, k = np.flatnonzero(size > 0), 0
    while len(live):
        h[live] = _step(h[live], values[start[live] + k])
        k += 1
        live = live[size[live] > k]
    return mix(h + size.astype(np.uint64) * _ODD)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _MULTIPLY
    h += b
    h ^= h >> _HALF
    return h


def each(values: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """The names of all stretches of `size` bytes or numbers, by doubling: a stretch is two of half its size."""
    n = max(0, len(values) - size + 1)
    out = np.empty(n, np.uint64)
    for lo in range(0, n, BLOCK):  # what a processor's cache holds
        hi = min(n, lo + BLOCK)
        out[lo:hi] = _each(values[lo : hi + size - 1], size, seed)
    return out


def _each(values: np.ndarray, size: int, seed: int) -> np.ndarray:
    n = len(values) - size + 1
    if values.dtype == np.uint8:
        if size < 8:
            at = np.arange(n)
            return of_bytes(values, at, at + size, seed)
        h, have = eights(values)[: len(values) - 7] ^ _seed(seed), 8
    else:
        h, have = values ^ _seed(seed), 1
    h *= _ODD
    h ^= h >> _HALF
    while 2 * have <= size:
        h = _joined(h[:-have], h[have:])
        have *= 2
    if have < size:
        h = _joined(h[:n], h[size - have : size - have + n])
    h *= _MULTIPLY
    h ^= h >> _HALF
    return h


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words [^\\x20\\x09-\\x0D]+ of the texts data[bounds[i]:bounds[i + 1]]: start, end, and each text's first word (n + 1 of them)."""
    black = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=black[1:-1])
    edge = np.flatnonzero(black[1:] != black[:-1])
    start, end = edge[::2], edge[1::2]
    # a word that runs over a text's end is two words
    inner = bounds[1:-1]
    if len(inner) and len(start):
        inner = np.unique(inner[(inner > 0) & (inner < len(data))])
        cut = inner[black[inner] & black[inner + 1]]
        if len(cut):
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end, np.searchsorted(start, bounds)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of values[bounds[i]:bounds[i + 1]] for each i; empty ones are 0."""
    out = np.zeros(len(bounds) - 1, np.float64 if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = np.add.reduceat(values[: bounds[full[-1] + 1]], bounds[full], dtype=out.dtype)
    return out


def cut_long(values: np.ndarray, bounds: np.ndarray, limit: int, overlap: int):
    """(values, bounds, the first of its texts, how many values of that text stand before) in parts of about `limit`.

    Only a text alone is cut; its parts overlap, so that every stretch of overlap + 1 values is whole in just one part
    that it begins within the first `limit` values of.
    """
    if len(bounds) != 2 or len(values) <= limit + overlap:
        yield values, bounds, 0
        return
    for at in range(0, len(values) - overlap, limit):
        some = values[at : at + limit + overlap]
        yield some, np.array([0, len(some)], np.int64), at
