"""Words, shingles and their hashes for whole Arrow columns of text, in numpy.

Words are runs of bytes outside 0x20 and 0x09-0x0D. A word's hash is the value of its bytes as a polynomial modulo the
prime 2^61 - 1 at a seeded random point, mixed with its length: no construction of equal hashes is known that does not
use the point, and equal words have equal hashes at any place. Words longer than BLOCK bytes take 64 bits of BLAKE2b.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SHINGLE = 5
#: Text bytes that are hashed at a time; a longer document is a piece of its own.
PIECE = 1 << 19
#: Bytes whose powers are kept, and the seed of the point that the words' polynomials are evaluated at.
BLOCK, SEED = 1 << 19, 20240229
PRIME = (1 << 61) - 1
_POINT = int(np.random.default_rng(SEED).integers(1 << 32, PRIME))
_Q = 0xD6E8FEB86659FD93

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def _shifted(x: np.ndarray) -> np.ndarray:
    """x 2^32, below 2^63, with the same remainder; 2^61 is 1."""
    return (x >> U(29)) + ((x & U((1 << 29) - 1)) << U(32))


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a b modulo the prime, for remainders."""
    low = U((1 << 32) - 1)
    a1, a0, b1, b0 = a >> U(32), a & low, b >> U(32), b & low
    end = a0 * b0
    return _reduced(_reduced(((a1 * b1) << U(3)) + _shifted(a1 * b0 + a0 * b1)) + (end & U(PRIME)) + (end >> U(61)))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    width = 1
    while width < n:
        step = U(pow(base, width, PRIME))
        out[width : 2 * width] = _times(out[: min(width, n - width)], np.full(1, step))
        width *= 2
    return out


_KEPT: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Halves of the point's first BLOCK powers, and the inverse powers."""
    if not _KEPT:
        up = _powers(_POINT, BLOCK)
        _KEPT.extend([up & U((1 << 32) - 1), up >> U(32), _powers(pow(_POINT, -1, PRIME), BLOCK)])
    return _KEPT


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """Hash of each data[start:end], spans in order and apart; with fold, A-Z count as a-z."""
    low, high, back = _tables()
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = int(np.searchsorted(ends, a + BLOCK, "right"))
        if j <= i:  # one longer than a block
            whole = data[a : ends[i]]
            out[i] = int.from_bytes(hashlib.blake2b((LOWER[whole] if fold else whole).tobytes(), digest_size=8).digest(), "big")
            i += 1
            continue
        part = data[a : ends[j - 1]]
        part = (LOWER[part] if fold else part).astype(np.uint64) + U(1)
        s, e = starts[i:j] - a, ends[i:j] - a
        sums = []
        for half in (low, high):
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * half[: len(part)], out=total[1:])
            sums.append(total[e] - total[s])
        value = _reduced(_reduced(sums[0]) + _shifted(sums[1]))
        out[i:j] = mix(_times(value, back[s]) + ((e - s).astype(np.uint64) << U(40)))
        i = j
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the len+1 offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, off, raw = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    if raw is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): runs of whole rows with about `most` bytes each."""
    data, off = text_bytes(column)
    n, at = len(off) - 1, 0
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1))
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each row the index of its first word (len(rows)+1)."""
    solid = ~WHITE[data]
    left, right = solid.copy(), solid.copy()
    if len(data):
        cut = off[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        left[1:] &= ~solid[:-1]
        left[cut] = solid[cut]
        right[:-1] &= ~solid[1:]
        right[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(left), np.flatnonzero(right) + 1
    return starts, ends, np.searchsorted(starts, off)


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hash of each run of `size` words in one row; fewer words give the whole sequence as one."""
    if not len(words):
        return words
    width = min(size, len(words))
    out = np.zeros(len(words) - width + 1, np.uint64)
    for j in range(width):
        out = (out + words[j : len(words) - width + 1 + j]) * U(_Q)
    return mix(out + U(width))


def shingle_rows(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """For each row, its shingle hashes in text order."""
    starts, ends, first = word_spans(data, off)
    words = span_hashes(data, starts, ends)
    whole = shingle_hashes(words) if len(words) >= SHINGLE else words
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        yield whole[a : b - SHINGLE + 1] if b - a >= SHINGLE else shingle_hashes(words[a:b])
