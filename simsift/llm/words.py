"""Word scanning of Arrow text columns with numpy, used inside ``mapInArrow``.

A batch is cut into chunks of whole texts; each chunk is one byte buffer with
row offsets, so memory is bounded by the chunk (or by the longest single text).
Words are maximal runs of bytes of a class.  Both classes used here contain
every byte above 0x7F, so working on UTF-8 bytes equals working on characters.

Hashes are 64-bit polynomial hashes of the bytes, finished by a bit mixer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def _class(pred) -> np.ndarray:
    return np.array([bool(pred(b)) for b in range(256)])


#: ``[^\x20\x09-\x0D]+``
SPACED = _class(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``, applied after A-Z are lower-cased
ALNUM = _class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EXACT_BYTES = mix(np.arange(256, dtype=np.uint64))
_LOWER_BYTES = _EXACT_BYTES[_LOWER]


def _grown(powers: np.ndarray, base: int, n: int) -> np.ndarray:
    if len(powers) < n:
        step = np.full(max(n, CHUNK_BYTES), np.uint64(base))
        step[0] = 1
        powers = np.cumprod(step)
    return powers


_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


class Chunk:
    """Consecutive texts as one buffer; text i is ``buf[off[i]:off[i + 1]]``."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off, self.n = buf, off, len(off) - 1

    def spans(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of member bytes; no run crosses
        two texts.  Runs of text i are ``ptr[i]:ptr[i + 1]``."""
        inside = members[self.buf]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        full = self.off[:-1] < self.off[1:]
        a, b = self.off[:-1][full], self.off[1:][full] - 1
        first[a], last[b] = inside[a], inside[b]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.off)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
        """64-bit hash of each byte span; equal bytes (ASCII case folded if
        ``lower``) give equal hashes wherever they stand."""
        global _powers, _inverses
        n = len(self.buf)
        _powers, _inverses = _grown(_powers, _BASE, n + 1), _grown(_inverses, _INVERSE, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((_LOWER_BYTES if lower else _EXACT_BYTES)[self.buf] * _powers[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * _inverses[starts]
                   + (ends - starts).astype(np.uint64) * _LENGTH)

    def text(self, start: int, end: int) -> str:
        return self.buf[start:end].tobytes().decode("utf-8", "replace")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Chunk]]:
    """Cut an Arrow string column into (first row, end row, Chunk); null texts
    are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, Chunk(flat[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
        lo = hi


def windows(words: np.ndarray, ptr: np.ndarray, k: int, whole_if_short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k consecutive words in each text, in order.  With
    ``whole_if_short`` a text of 1 to k - 1 words has one window, all of it."""
    coef = mix(np.arange(1, k + 1, dtype=np.uint64), 7) | np.uint64(1)
    count = np.diff(ptr)
    short = (count > 0) & (count < k) if whole_if_short else np.zeros(len(count), dtype=bool)
    wptr = np.concatenate([[0], np.cumsum(np.maximum(count - k + 1, 0) + short)])
    out = np.empty(wptr[-1], dtype=np.uint64)
    n = max(len(words) - k + 1, 0)
    acc = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        acc += words[j:j + n] * coef[j]
    valid = np.ones(n, dtype=bool)
    for j in range(1, k):
        at = ptr[1:] - j
        valid[at[(at >= ptr[:-1]) & (at < n)]] = False
    from_long = np.ones(len(out), dtype=bool)
    from_long[wptr[:-1][short]] = False
    out[from_long] = acc[valid]
    if short.any():
        size, at = count[short], ptr[:-1][short]
        acc = size.astype(np.uint64) * _LENGTH
        for j in range(k - 1):
            has = size > j
            acc[has] += words[at[has] + j] * coef[j]
        out[wptr[:-1][short]] = acc
    return mix(out), wptr


def distinct_sorted(values: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values, ascending.  ``values`` is sorted in place."""
    for a, b in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True):
        if b - a > 1:
            values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    keep[1:] = values[1:] != values[:-1]
    starts = ptr[:-1][ptr[:-1] < ptr[1:]]
    keep[starts] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], before[ptr]


def list_array(values: np.ndarray, ptr: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ptr.astype(np.int32)), pa.array(values))
