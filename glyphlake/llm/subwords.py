"""Splitting texts at places where no token of the pattern can reach across, and caching by piece.

A single space between two characters that are not white space always starts a new match of
public_tokenizers.PATTERN, so what lies between such spaces can be encoded by itself. Words
repeat; their ids are kept in a cache of bounded size for the life of a worker.
"""

from __future__ import annotations

import re

_RUN = re.compile(r" \s")
_BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
CACHE_ENTRIES = 400_000
LONGEST_CACHED = 64


def cut(text: str) -> list[str]:
    """Pieces of text; every piece but the first has lost the space it started with.

    Joining the pieces with spaces gives the text back. A space with white space or the end after it may
    belong to a longer run; such texts are cut only between two visible characters.
    """
    if text[-1:] == " " or _RUN.search(text):
        return _BOUNDARY.split(text)
    return text.split(" ")


class PieceCache:
    """Ids of pieces as little-endian unsigned 32-bit bytes.

    encode_all(list of str) -> list of bytes encodes whole pieces. Pieces that start a text lack the
    leading space and are kept apart from the others under a key that no piece can have (they would
    contain an inner boundary).
    """

    def __init__(self, encode_all, entries: int = CACHE_ENTRIES) -> None:
        self._encode_all = encode_all
        self._entries = entries
        self._kept: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        cuts = [cut(t) for t in texts]
        rest: set[str] = set()
        for pieces in cuts:
            rest.update(pieces[1:])
        kept = self._kept
        if len(kept) > self._entries:
            kept.clear()
        missing = [p for p in rest if p not in kept]
        firsts = list({pieces[0] for pieces in cuts})
        found = self._encode_all([" " + p for p in missing] + firsts)
        now = dict(zip(missing, found))
        heads = dict(zip(firsts, found[len(missing) :]))
        if len(missing) > self._entries // 4:
            lookup = {p: kept[p] for p in rest if p in kept} | now
        else:
            lookup = kept
            kept.update(now)
        out = [heads[pieces[0]] + b"".join(map(lookup.__getitem__, pieces[1:])) for pieces in cuts]
        for p in missing:
            if len(p) > LONGEST_CACHED:
                kept.pop(p, None)
        return out
