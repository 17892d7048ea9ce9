"""Byte-level BPE encoding and decoding on padded numpy matrices.

Distinct matches of the splitting pattern are the rows. Rows of like length share a padded matrix of
token ids; in every round each row merges its leftmost pair of minimum rank, looked up in a hash table
of pairs, and finished rows leave the matrix. Decoding gathers token bytes by offset.

Defined results: null text is the empty text, which has no ids; ids and bytes of repeated rows repeat;
matches of any length are encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glyphlake.llm.subwords import PieceCache

_NONE = np.uint32(0xFFFFFFFF)
_LONG_ROW = 256
_CELLS = 2_000_000


class PairTable:
    """Open-addressing hash table from a pair of token ids to the merged id, which is also its rank."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 2.5))))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.full(size, _NONE, dtype=np.uint32)
        keys = self._key(left, right)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            want = todo[free]
            _, first = np.unique(slot[want], return_index=True)
            placed = want[first]
            self.keys[slot[placed]] = keys[placed]
            self.values[slot[placed]] = merged[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; the largest uint32 where a pair does not merge."""
        keys = self._key(left, right)
        slot = self._slot(keys)
        out = np.full(keys.shape, _NONE, dtype=np.uint32)
        flat, keys, slot = out.reshape(-1), keys.reshape(-1), slot.reshape(-1)
        open_rows = np.arange(len(flat))
        for _ in range(self.probes):
            held = self.keys[slot[open_rows]]
            hit = held == keys[open_rows]
            flat[open_rows[hit]] = self.values[slot[open_rows[hit]]]
            open_rows = open_rows[~hit & (held != np.uint64(0xFFFFFFFFFFFFFFFF))]
            if not len(open_rows):
                break
            slot[open_rows] = (slot[open_rows] + 1) & (len(self.keys) - 1)
        return out


class Vocabulary:
    """A rank file: token bytes by id, ids of single bytes, and every pair that merges."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, at in self.rank.items():
            self.token[at] = token
        self.byte_id = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.uint32)
        left, right, merged = [], [], []
        for token, at in self.rank.items():
            for k in range(1, len(token)):
                a, b = self.rank.get(token[:k]), self.rank.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(at)
        self.pairs = PairTable(np.array(left, np.uint32), np.array(right, np.uint32), np.array(merged, np.uint32))
        self.length = np.array([len(t) for t in self.token], dtype=np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))[:-1]
        self.bytes = np.frombuffer(b"".join(self.token), dtype=np.uint8)
        # White space as the Unicode property, not as Python's str.isspace, which has four more characters.
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (matches of the pattern) one after another, and where each word's begin and the last's end."""
        whole = np.fromiter((self.rank.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        counts = (whole >= 0).astype(np.int64)
        todo = np.flatnonzero((whole < 0) & (size > 0))
        todo = todo[np.argsort(size[todo], kind="stable")]
        done = []
        at = 0
        while at < len(todo):
            longest = int(size[todo[at]])
            if longest > _LONG_ROW:
                bucket = todo[at : at + 1]
                ids = self._merge_long(words[bucket[0]])[None, :]
                lengths = np.array([ids.shape[1]])
            else:
                widest = min(longest + 2, _LONG_ROW)
                end = at + int(np.searchsorted(size[todo[at : at + max(1, _CELLS // widest)]], widest, "right"))
                bucket = todo[at:end]
                ids, lengths = self._merge_bucket([words[k] for k in bucket], size[bucket])
            counts[bucket] = lengths
            done.append((bucket, ids, lengths))
            at += len(bucket)
        starts = np.concatenate(([0], np.cumsum(counts)))
        flat = np.empty(starts[-1], dtype=np.uint32)
        known = whole >= 0
        flat[starts[:-1][known]] = whole[known]
        for bucket, ids, lengths in done:
            inside = np.arange(ids.shape[1]) < lengths[:, None]
            flat[(starts[bucket][:, None] + np.arange(ids.shape[1]))[inside]] = ids[inside]
        return flat, starts

    def _merge_bucket(self, words: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of like length in a padded matrix, and how many each row has."""
        lengths = sizes.copy()
        width = int(lengths.max())
        inside = np.arange(width) < lengths[:, None]
        ids = np.full(inside.shape, _NONE, dtype=np.uint32)
        ids[inside] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        ranks = np.full((len(words), width), _NONE, dtype=np.uint32)  # the last column never merges
        ranks[:, :-1] = self.pairs.find(ids[:, :-1], ids[:, 1:])
        out, out_lengths = ids.copy(), lengths.copy()
        row = np.arange(len(words))
        while True:
            at = ranks.argmin(axis=1)  # the leftmost of the least
            here = np.arange(len(row))
            least = ranks[here, at]
            ended = least == _NONE
            if ended.any():
                out[row[ended], : ids.shape[1]] = ids[ended]
                out_lengths[row[ended]] = lengths[ended]
                keep = ~ended
                row, at, least, lengths = row[keep], at[keep], least[keep], lengths[keep]
                if not len(row):
                    return out, out_lengths
                width = int(lengths.max())
                ids, ranks = ids[keep, :width], ranks[keep, :width]
                here = np.arange(len(row))
            # Compaction: everything right of the merged pair moves one place to the left.
            moved = np.arange(1, ids.shape[1]) > at[:, None] + 1
            ids[here, at] = least
            for grid in (ids, ranks):
                grid[:, 1:-1] = np.where(moved[:, 1:], grid[:, 2:], np.where(np.arange(1, ids.shape[1] - 1) <= at[:, None], grid[:, 1:-1], grid[:, 2:]))
                grid[:, -1] = _NONE
            lengths = lengths - 1
            # Only the pairs that touch the merged token have new ranks.
            some = at > 0
            ranks[here[some], at[some] - 1] = self.pairs.find(ids[here[some], at[some] - 1], least[some])
            ranks[here, at] = _NONE
            some = at + 1 < ids.shape[1]
            ranks[here[some], at[some]] = self.pairs.find(least[some], ids[here[some], at[some] + 1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One long row by the same rule, its pairs in a heap by rank and then place, so that a merge costs the logarithm of the row."""
        ids = self.byte_id[np.frombuffer(word, dtype=np.uint8)]
        n = len(ids)
        found = self.pairs.find(ids[:-1], ids[1:])
        where = np.flatnonzero(found != _NONE)
        heap = (found[where].astype(np.int64) * n + where).tolist()
        heapq.heapify(heap)
        tokens = [self.token[k] for k in ids.tolist()]
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = found.tolist() + [int(_NONE)]  # of the token at a place and the one right of it
        held = ids.tolist()

        def pair(at: int) -> None:
            to = right[at]
            rank[at] = self.rank.get(tokens[at] + tokens[to], int(_NONE)) if to < n else int(_NONE)
            if rank[at] != int(_NONE):
                heapq.heappush(heap, rank[at] * n + at)

        while heap:
            least, at = divmod(heapq.heappop(heap), n)
            if rank[at] != least:
                continue
            gone = right[at]
            held[at], tokens[at] = least, tokens[at] + tokens[gone]
            held[gone], rank[gone] = -1, int(_NONE)
            right[at] = right[gone]
            if right[at] < n:
                left[right[at]] = at
            pair(at)
            if left[at] >= 0:
                pair(left[at])
        return np.array([k for k in held if k >= 0], dtype=np.uint32)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian bytes; each match of the pattern is encoded separately.

        Pieces of one space and visible characters keep their matches when they follow each other, so they
        are split together.
        """
        plain = [k for k, p in enumerate(pieces) if p[:1] == " " and p[1:].split() == [p[1:]]]
        others = sorted(set(range(len(pieces))).difference(plain))
        matches = self.split.findall("".join([pieces[k] for k in plain]))
        ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        bounds = np.cumsum(np.fromiter((len(pieces[k]) for k in plain), np.int64, len(plain)))
        last = np.searchsorted(ends, bounds, "right")
        more = [self.split.findall(pieces[k]) for k in others]
        last = np.concatenate((last, len(matches) + np.cumsum(np.fromiter(map(len, more), np.int64, len(more)))))
        for m in more:
            matches += m
        place = {m: k for k, m in enumerate(dict.fromkeys(matches))}
        flat, starts = self.encode_words([m.encode() for m in place])
        word = np.fromiter(map(place.__getitem__, matches), np.int64, len(matches))
        counts = np.diff(starts)[word]
        stops = np.cumsum(counts)
        index = np.arange(stops[-1] if len(stops) else 0) + np.repeat(starts[word] - (stops - counts), counts)
        raw = flat[index].astype("<u4").tobytes()
        cuts = (4 * np.concatenate(([0], stops))[np.concatenate(([0], last)).astype(np.int64)]).tolist()
        out: list = [b""] * len(pieces)
        for k, begin, end in zip([*plain, *others], cuts, cuts[1:]):
            out[k] = raw[begin:end]
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids, gathered by offset."""
        if not len(ids):
            return b""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        index = np.arange(ends[-1]) + np.repeat(self.start[ids] - (ends - lengths), lengths)
        return self.bytes[index].tobytes()


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


@lru_cache(maxsize=2)
def _cache(path: str, pattern: str) -> PieceCache:
    return PieceCache(vocabulary(path, pattern).encode_pieces)


def byte_slices(texts: list[str | None], most: int = 4_000_000) -> Iterator[slice]:
    """Runs of texts of about so many characters, so that a batch of long texts stays small in memory."""
    begin = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield slice(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row of docs: its token ids and what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = vocabulary(path, pattern), _cache(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in byte_slices(texts):
                ids = [np.frombuffer(x, dtype="<u4") for x in cache.encode([t or "" for t in texts[part]])]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([*ids, np.array([], "<u4")]).astype(np.int32)
                yield pa.record_batch([keys[part], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array([vocab.decode(x) for x in ids], pa.binary())], names=[id_column, "ids", "decoded"])

    kind = dict(docs.dtypes)[id_column]
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row, without sending the ids back to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, cache = vocabulary(path, pattern), _cache(path, pattern)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for part in byte_slices(texts):
                ids = [np.frombuffer(x, dtype="<u4") for x in cache.encode([t or "" for t in texts[part]])]
                yield pa.record_batch(
                    [
                        keys[part],
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(" ".join(map(str, x.tolist())).encode()).hexdigest() for x in ids]),
                        pa.array([hashlib.sha256(vocab.decode(x)).hexdigest() for x in ids]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
