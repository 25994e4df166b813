"""64-bit hashes of whitespace-separated words, vectorised over a text.

A word hash is a polynomial in a fixed odd multiplier over per-byte random
values, taken from prefix sums over the whole buffer, then mixed.  Texts
longer than ``SEGMENT`` bytes are cut at a space, so the working arrays stay
bounded however long a text is.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SEGMENT = 1 << 18
_K = 0x9E3779B97F4A7C15 | 1
_U64 = np.uint64


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    values = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
    values[32] = 0
    return values


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    n = SEGMENT + 2
    up = np.full(n, _K, np.uint64)
    up[0] = 1
    down = np.full(n, pow(_K, -1, 1 << 64), np.uint64)
    down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U64(32))
    h = h * _U64(0xD6E8FEB86659FD93)
    return h ^ (h >> _U64(32))


def _segment_hashes(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, start of each word) of at most SEGMENT bytes."""
    a = np.frombuffer(buf, np.uint8)
    inside = np.empty(len(a) + 2, bool)
    inside[0] = inside[-1] = False
    np.not_equal(a, 32, out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    up, down = _powers()
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_byte_values()[a] * up[:len(a)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U64(0xA24BAED4963EE407)), starts


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of several texts whose words are separated by spaces
    (0x20) only.  Returns (hashes of all words in order, n + 1 offsets: the
    words of text i are ``hashes[offsets[i]:offsets[i + 1]]``)."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts) + 1, np.int64)
    group: list[bytes] = []
    first, size = 0, 0

    def flush(upto: int) -> None:
        nonlocal group, first, size
        if group:
            h, starts = _segment_hashes(b" ".join(group))
            ends = np.cumsum([len(t) + 1 for t in group])
            below = np.searchsorted(starts, ends)
            counts[first + 1:upto + 1] = np.diff(below, prepend=0)
            hashes.append(h)
        group, first, size = [], upto, 0

    for i, t in enumerate(texts):
        if len(t) + 1 > SEGMENT:
            flush(i)
            n = 0
            for part in _cut(t):
                h, _ = _segment_hashes(part)
                hashes.append(h)
                n += len(h)
            counts[i + 1] = n
            first = i + 1
            continue
        if size + len(t) + 1 > SEGMENT:
            flush(i)
        group.append(t)
        size += len(t) + 1
    flush(len(texts))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.cumsum(counts)


def _cut(t: bytes):
    """Parts of a long text, cut at spaces; a single word longer than a part
    is replaced by a short stand-in (its digest), the same wherever it stands."""
    import hashlib
    at = 0
    while at < len(t):
        end = min(len(t), at + SEGMENT)
        if end < len(t) and t[end] != 32:
            back = t.rfind(b" ", at, end)
            if back <= at:
                stop = t.find(b" ", at + (t[at] == 32))
                stop = len(t) if stop < 0 else stop
                word = t[at:stop].strip(b" ")
                yield hashlib.blake2b(word, digest_size=32).hexdigest().encode() if len(word) >= SEGMENT else word
                at = stop
                continue
            end = back
        yield t[at:end]
        at = end
