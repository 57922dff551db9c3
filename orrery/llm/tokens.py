"""Words of UTF-8 text as numpy arrays.

A word is a maximal run of bytes other than space, tab, LF, VT, FF and CR (``[^\\x20\\x09-\\x0D]+``). Arrow string
buffers are read in place, so nothing here loops over words in Python. Hashes are 64 bits, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into words at a time; a longer document is handled alone, and its words hashed so many
#: bytes at a time, so that it takes some bytes a byte and some numbers a word.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        _powers[base] = have = np.cumprod(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word (the finishing steps of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of several documents. ``first[d]:first[d + 1]`` are those of document d; ``bounds`` are its bytes."""

    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none) and the limits of each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = CHUNK_BYTES) -> np.ndarray:
    """Hashes of the words, over ``limit`` bytes at a time (a longer word is taken whole)."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, side="right")))
        base = starts[i]
        s, e = starts[i:j] - base, ends[i:j] - base
        n = int(e[-1])
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE_CODE[data[base : base + n]] * powers(_BASE, n), out=sums[1:])
        hashes = (sums[e] - sums[s]) * powers(_INVERSE, n)[s]
        out[i:j] = mix(hashes + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        i = j
    return out


def split(data: np.ndarray, bounds: np.ndarray, hashed: bool = True) -> Words:
    """Finds and hashes the words."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return Words(data, bounds, none, none, np.zeros(len(bounds), np.int64), np.empty(0, np.uint64))
    space = _SPACE[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    inner = bounds[1:-1]
    before[inner[inner < n]] = True
    after[inner[inner > 0] - 1] = True
    word = ~space
    starts, ends = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    hashes = _hashed(data, starts, ends) if hashed else np.empty(0, np.uint64)
    return Words(data, bounds, starts, ends, np.searchsorted(starts, bounds), hashes)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, hashed: bool = True) -> Iterator[tuple[int, int, Words]]:
    """The words of documents lo:hi, as many whole documents at a time as fit the limit."""
    data, bounds = buffers(texts)
    lo, n = 0, len(bounds) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, side="right")) - 1)
        part = bounds[lo : hi + 1]
        yield lo, hi, split(data[part[0] : part[-1]], part - part[0], hashed)
        lo = hi


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive words, at its first word; those over a document's end are the caller's to drop."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * powers(_INVERSE, len(hashes))[:n] + np.uint64(size))


def whole(words: Words, start: int = 1) -> np.ndarray:
    """A hash of each document's word sequence; another start gives an independent hash."""
    seeded = mix(words.hashes ^ np.uint64(0xA0761D6478BD642F * start % 2**64))
    sums = np.zeros(len(seeded) + 1, np.uint64)
    np.cumsum(seeded * powers(_BASE, max(1, len(seeded)))[: len(seeded)], out=sums[1:])
    lo, hi = words.first[:-1], words.first[1:]
    scale = powers(_INVERSE, len(seeded) + 1)[lo]
    return mix((sums[hi] - sums[lo]) * scale + words.counts.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def joined(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept words of each document, joined by one space: bytes and limits."""
    n = len(words.data)
    owner = np.repeat(np.arange(len(words.bounds) - 1), words.counts)
    kept = np.flatnonzero(keep)
    step = np.zeros(n + 1, np.int8)
    step[words.starts[kept]] += 1
    step[words.ends[kept]] -= 1
    take = np.cumsum(step[:-1], dtype=np.int8) > 0
    out = words.data
    if len(kept) > 1:
        more = owner[kept[:-1]] == owner[kept[1:]]
        gaps = words.ends[kept[:-1]][more]
        out = out.copy()
        out[gaps] = 32
        take[gaps] = True
    upto = np.zeros(n + 1, np.int64)
    np.cumsum(take, out=upto[1:])
    return out[take], upto[words.bounds]
