"""Vectorized 64-bit hashing of word sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers; arithmetic wraps."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= M1
    x ^= x >> np.uint64(27)
    x *= M2
    x ^= x >> np.uint64(31)
    return x


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive word hashes; all words together where there are fewer than k."""
    words = words.view(np.uint64)
    k = max(1, min(k, len(words)))
    n = len(words) - k + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(k):
            out = mix(out + GOLDEN + words[j : j + n])
    return out


def groups(rows: list[np.ndarray], size: int) -> Iterator[slice]:
    """Slices of consecutive rows of about `size` elements, so that memory follows the elements and not the rows."""
    start = total = 0
    for i, r in enumerate(rows):
        total += len(r)
        if total >= size:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(rows):
        yield slice(start, len(rows))


#: Random odd codes of the bytes, those of white space 0; and the ASCII capitals' small letters. Fixed, so that every task hashes alike.
CODES = mix(np.arange(1, 257, dtype=np.uint64) * GOLDEN) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CODES[SPACE] = 0
CODES[65:91] = CODES[97:123]
BASE = 0x9DDFEA08EB382D69
#: Bytes that are hashed at once.
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """The powers of BASE and of its inverse, n at least."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, b, np.uint64)]) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers


def ascii_words(column: pa.Array) -> list[np.ndarray]:
    """The hashes of the words (runs between ASCII white space) of each text, ASCII capitals read as small letters; null is empty.

    A word is a polynomial in its bytes' codes, modulo 2^64 and mixed. All texts of a batch are hashed together, a block of bytes at a time."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends, valid = offsets[1:], ~column.is_null().to_numpy(zero_copy_only=False)
    out, counts, at = [], np.zeros(len(column), np.int64), offsets[0]
    while at < ends[-1]:
        to = min(at + BLOCK, ends[-1])
        while to < ends[-1] and not SPACE[data[to]] and not _is_end(ends, to):
            ahead = np.flatnonzero(SPACE[data[to : to + BLOCK]])
            stop = ends[np.searchsorted(ends, to, "right")]  # the text's end
            to = min(stop, to + (int(ahead[0]) if len(ahead) else BLOCK))
        b = data[at:to]
        space = SPACE[b]
        begins = ~space
        begins[1:] &= space[:-1]
        own = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at  # texts that begin here
        begins[own] = ~space[own]
        starts = np.flatnonzero(begins)
        if len(starts):
            up, down = _power(len(b))
            out.append(np.add.reduceat(CODES[b] * up[: len(b)], starts) * down[starts])
            counts += np.bincount(np.searchsorted(ends, starts + at, "right"), minlength=len(column))
        at = to
    flat = mix(np.concatenate(out) + GOLDEN) if out else np.zeros(0, np.uint64)
    cuts = np.cumsum(np.r_[0, counts])
    return [flat[a:b] if v else flat[:0] for a, b, v in zip(cuts[:-1], cuts[1:], valid)]


def _is_end(ends: np.ndarray, at: int) -> bool:
    i = np.searchsorted(ends, at)
    return i < len(ends) and ends[i] == at
