"""Words of many texts at once, as hashes and byte ranges, without a Python object for each word.

Words are [^\\x20\\x09-\\x0D]+ of a text's UTF-8 bytes. A word's hash is a sum over its bytes of a random number for the byte
times a power of an odd base, taken from one running sum over all bytes, and then scrambled; words over 64 bytes, for
which such sums are weak, are hashed by xxh3.

Defined results: a null text is an empty one and has no words; words do not reach from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash

SPAN = 1 << 16  # bytes that one running sum covers
LONGEST = 64
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=8)
def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n of an odd number and of its inverse, modulo 2 to the 64th."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        row = np.full(n + 1, np.uint64(b))
        row[0] = 1
        out.append(np.cumprod(row, dtype=np.uint64))
    return out[0], out[1]


def run_sums(h: np.ndarray, length: int, base: int) -> np.ndarray:
    """A hash of every run of `length` numbers, from one running sum."""
    if len(h) < length:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base, 1 << int(len(h)).bit_length())
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[: len(h)], dtype=np.uint64)))
    return mix((total[length:] - total[:-length]) * down[: len(h) - length + 1])


@lru_cache(maxsize=2)
def _byte_tables(lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Whether a byte belongs to a word, and its random number; with lower, A-Z have those of a-z."""
    inside = np.ones(256, dtype=bool)
    inside[[0x20, *range(0x09, 0x0E)]] = False
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        value[0x41:0x5B] = value[0x61:0x7B]
    return inside, value


@dataclass
class Words:
    """hash, and begin and end in data, of each word; first[k] is the number of words before text k."""

    data: np.ndarray
    hash: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column of strings, and where each text begins in them (and the last ends)."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of up to `most` bytes; a longer text is a run of its own."""
    at, n = 0, len(bounds) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, to
        at = to


def hash_words(data: np.ndarray, bounds: np.ndarray, lower: bool = False) -> Words:
    """The words of the texts that lie in data at bounds."""
    inside, value = _byte_tables(lower)
    word = inside[data]
    opens = word.copy()
    opens[1:] &= ~word[:-1]
    cuts = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    opens[cuts] = word[cuts]
    closes = word.copy()
    closes[:-1] &= ~word[1:]
    closes[cuts - 1] = word[cuts - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size = end - begin
    up, down = powers(int(_BASE), SPAN)
    out = np.empty(len(begin), dtype=np.uint64)
    at = 0
    while at < len(begin):
        low = int(begin[at])
        to = max(at + 1, int(np.searchsorted(end, low + SPAN, "right")))
        part = value[data[low : min(int(end[to - 1]), low + SPAN)]]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part * up[: len(part)], dtype=np.uint64)))
        s = begin[at:to] - low
        out[at:to] = (total[np.minimum(end[at:to] - low, len(part))] - total[s]) * down[s]
        at = to
    out = mix(out + size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    for k in np.flatnonzero(size > LONGEST).tolist():
        raw = data[begin[k] : end[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(raw.lower() if lower else raw)
    return Words(data, out, begin, end, np.searchsorted(begin, bounds))
