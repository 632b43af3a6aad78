"""Words and their 64-bit hashes of whole Arrow string columns, by numpy over the UTF-8 bytes.

A word is a run of anything but blank, tab, line feed, VT, FF and CR. Hashes are polynomial in
randomised byte values, modulo 2**64, from running sums, those of words over 64 bytes XXH3; a column is walked in pieces of about a
quarter of a megabyte cut between words, so memory follows the piece and the number of words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE = 1 << 18
LONG = 64  # bytes; sums modulo 2**64 part short words, but long ones can be built that share a sum
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection), on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    upper = np.arange(65, 91)
    lower = values.copy()
    lower[upper] = values[upper + 32]
    word = np.ones(256, dtype=bool)
    word[[9, 10, 11, 12, 13, 32]] = False
    return values, lower, word


VALUES, LOWER_VALUES, IS_WORD = _tables()


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after the other, and the offsets (one more than texts). Null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_hashes(column: pa.Array, lower: bool = True, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, first)``: the words of text ``i`` are ``hashes[first[i]:first[i + 1]]``.

    With ``prefixes`` a row has the word's hash and those of its first bytes, for each of these numbers of bytes.
    """
    raw, offsets = utf8(column)
    values = LOWER_VALUES if lower else VALUES
    hashes, starts_at = [], []
    at, n = 0, len(raw)
    inner = offsets[1:-1]
    while at < n:
        stop = min(at + PIECE, n)
        while stop < n:  # back to the last word end, or on to the next one
            tail = IS_WORD[raw[at:stop]]
            gaps = np.flatnonzero(~tail)
            if len(gaps):
                stop = at + int(gaps[-1]) + 1
                break
            stop = min(stop + PIECE, n)
        piece = raw[at:stop]
        word = IS_WORD[piece]
        cut = inner[np.searchsorted(inner, at, "right"):np.searchsorted(inner, stop, "left")] - at
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        begin[cut] = word[cut]
        end = word.copy()
        end[:-1] &= ~word[1:]
        end[cut - 1] = word[cut - 1]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        size = 1 << max(18, int(len(piece) - 1).bit_length())
        up, down = _powers(size)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(values[piece] * up[:len(piece)], dtype=np.uint64, out=sums[1:])
        own = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        for i in np.flatnonzero(e - s > LONG).tolist():
            long = piece[s[i]:e[i]].tobytes()
            own[i] = xxhash.xxh3_64_intdigest(long.translate(LOWER) if lower else long)
        if prefixes:
            parts = [mix64((sums[np.minimum(e, s + k)] - sums[s]) * down[s] + np.uint64(k << 32)) for k in prefixes]
            own = np.stack([own, *parts], 1)
        hashes.append(own)
        starts_at.append(s + at)
        at = stop
    empty = np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
    h = np.concatenate(hashes) if hashes else empty
    s = np.concatenate(starts_at) if starts_at else np.zeros(0, np.int64)
    return h, np.searchsorted(s, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` adjacent words."""
    n = len(hashes) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j:j + n]
    return mix64(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of one text; with fewer words the whole sequence is the only one."""
    if not len(hashes):
        return hashes
    if len(hashes) < size:
        return shingles(hashes, len(hashes)) + np.uint64(len(hashes))
    return np.unique(shingles(hashes, size))
