"""Word shingles and SuperMinHash signatures in numpy.

SuperMinHash (Ertl 2017): every element draws a random permutation of the signature's places one step at a
time; its value at the place drawn in step j is j plus a uniform number. Values of one element at different
places are thus correlated ranks, which lowers the variance of the estimate for small sets, and an element stops as
soon as j exceeds every value that its set still holds. All elements of a batch take step j together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from glyphlake.llm.wordstream import hash_words, mix, slices, text_bytes

PLACES = 128
SLICE_BYTES = 1_000_000
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of `size` words; of all its words, if they are fewer; empty without words.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case.
    """
    data, bounds = text_bytes(texts)
    out = []
    for begin, end in slices(bounds, SLICE_BYTES):
        words = hash_words(data[bounds[begin] : bounds[end]], bounds[begin : end + 1] - bounds[begin], lower=True)
        runs = _runs(words.hash, size)
        for first, stop in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
            n = stop - first
            found = runs[first : stop - size + 1] if n >= size else _runs(words.hash[first:stop], n)
            found = np.sort(found)
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))] if len(found) else found)
    return out


def _runs(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of `size` numbers."""
    if not 0 < size <= len(h):
        return np.zeros(0, dtype=np.uint64)
    total = np.full(len(h) - size + 1, np.uint64(size), dtype=np.uint64)
    for k in range(size):
        total = mix(total * _FACTORS[k % len(_FACTORS)] + h[k : len(h) - size + 1 + k])
    return total


def signatures(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """SuperMinHash signatures: (step << 32 | draw) for every set and place; all ones for empty sets."""
    held = np.full(len(sets) * places, _EMPTY, dtype=np.uint64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if not sizes.sum():
        return held.reshape(len(sets), places)
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.empty((len(element), places), dtype=np.uint8)
    order[:] = np.arange(places)
    here = np.arange(len(element))
    for step in range(places):
        draw = mix(element * np.uint64(2 * step + 3) + _FACTORS[step % 8])
        other = step + ((draw >> np.uint64(32)) % np.uint64(places - step)).astype(np.int64)
        place = order[here, other].copy()
        order[here, other] = order[here, step]
        value = (np.uint64(step) << np.uint64(32)) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(held, owner * places + place, value)
        # A set whose largest value is below the next step cannot change any more.
        largest = held.reshape(len(sets), places).max(axis=1)
        going = (largest >= (np.uint64(step + 1) << np.uint64(32)))[owner]
        if not going.any():
            break
        if going.mean() < 0.7:
            element, owner, order = element[going], owner[going], order[going]
            here = np.arange(len(element))
    return held.reshape(len(sets), places)


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """One key for each run of `rows` places."""
    bands = signature.shape[1] // rows
    keys = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        total = np.full(len(signature), np.uint64(b + 1))
        for k in range(rows):
            total = mix(total * _FACTORS[k % 8] + signature[:, b * rows + k])
        keys[:, b] = total
    return keys
