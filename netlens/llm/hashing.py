"""Vectorised hashing of words and spans straight from Arrow string buffers.

All functions work on the concatenated UTF-8 bytes of many texts at once, so a
batch of documents costs a fixed number of numpy calls and no per-word Python.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Odd multiplier, 5 modulo 8, so that differences of its powers have few factors of two.
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 2**64)
SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def byte_table(lower: bool, seed: int = 1) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower``, A-Z count as a-z."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    if lower:
        table[65:91] = table[97:123]
    return table


EXACT, LOWER = byte_table(False), byte_table(True)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64 (the table is rounded up and kept)."""
    n = int(n)
    return _powers(max(SLICE + 1, 1 << (n - 1).bit_length() if n > 1 else 1), base)[:n]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without nulls; offsets[i]:offsets[i+1] is text i."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, bounds) of the words; words bounds[i]:bounds[i+1] belong to text i.

    A word is a run of bytes other than space and 0x09-0x0D; texts never run together.
    """
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin], last[end] = inside[begin], inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[starts[i]:ends[i]]; starts and ends ascend."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + SLICE, "right")))
        high = ends[j - 1]
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * powers(high - low), out=total[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * powers(high - low + 1, INVERSE)[s] + (e - s).astype(np.uint64))
        i = j
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, bounds per text)."""
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends, table), bounds


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text index of every element."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shingles(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of k words, bounds); a text with 1 to k-1 words has its whole sequence as one."""
    counts = np.diff(bounds)
    coef = mix(np.arange(k, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    short = np.flatnonzero((counts > 0) & (counts < k))
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    to = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(to[-1]) - np.repeat(to[:-1], n) + np.repeat(bounds[:-1], n)
    padded = np.concatenate([words, np.zeros(k, np.uint64)])
    total = np.zeros(len(begin), np.uint64)
    for j in range(k):
        total += padded[begin + j] * coef[j]
    for i in short:
        own = words[bounds[i] : bounds[i + 1]]
        total[to[i]] = (own * coef[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    return mix(total), to


def sequence_keys(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each text's word sequence: equal sequences, equal keys."""
    counts = np.diff(bounds)
    power = powers(int(counts.max(initial=0)) + 1)[np.arange(len(words)) - np.repeat(bounds[:-1], counts)]
    keys = []
    for seed in (0x1234567, 0x89ABCDEF01):
        total = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(mix(words ^ np.uint64(seed)) * power, out=total[1:])
        keys.append(mix(total[bounds[1:]] - total[bounds[:-1]] + counts.astype(np.uint64)).view(np.int64))
    return keys[0], keys[1]


def parts(texts: pa.Array, limit: int = 2 << 20):
    """Slices (first row, array) of about ``limit`` bytes of text each, to bound memory."""
    _, offsets = text_bytes(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, texts.slice(i, j - i)
        i = j
    release()


def release() -> None:
    """Hand freed memory back to the system: Python workers outlive their tasks and would hold the most that any had."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
