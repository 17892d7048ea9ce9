"""Packing token ids into windows of fixed length by best-fit decreasing.

A document longer than a window is first cut into full windows; what is left of each document goes, longest
first, into the open window that it fills most tightly. The tightest window is found in a segment tree
indexed by remaining capacity. Pieces are dealt over groups by their numbers in the written table, so that no task
holds more than a bounded number of pieces, however often a row repeats; a group wastes at most its last windows.

Ids are those that the tokenizers library gives without adding special tokens: added tokens of the vocabulary file, as <|endoftext|>,
are found in a text first, and what lies between them is encoded by itself.

Defined results: a null or empty text is a document of the closing id alone; repeated rows are packed once
each; a null doc_id is a document like any other; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphlake.llm.bpe import byte_slices
from glyphlake.llm.subwords import PieceCache
from glyphlake.llm.workspace import Workspace

PIECES_PER_GROUP = 40_000


class JsonVocabulary:
    """Encoder for a byte-level BPE file in the tokenizers library's JSON format.

    Gives the ids that the library gives without adding special tokens. It reads the same vocabulary but merges with
    tiktoken's engine, which is several times faster; the tests hold it against the library.
    """

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        # The format writes a byte that is a visible Latin-1 character as itself, the others from U+0100 on.
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(visible)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {}
        for token, at in model["vocab"].items():
            if all(c in byte_of for c in token):
                ranks[bytes(byte_of[c] for c in token)] = at
        merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if any(a >= b for a, b in zip(merged, merged[1:])):
            raise ValueError("the file's merges are not in the order of its vocabulary")
        self.encoding = tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.added_tokens = file.get("added_tokens") or []
        self.normalizes = bool(file.get("normalizer"))
        self.length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, at in ranks.items():
            self.length[at] = len(token)

    def splitter(self) -> re.Pattern | None:
        """Finds the file's added tokens, of those that begin at one place the longest; None if there are none."""
        for token in self.added_tokens:
            if token["single_word"] or token["lstrip"] or token["rstrip"] or (token["normalized"] and self.normalizes):
                raise ValueError(f"added token {token['content']!r} is matched by rules that are not supported")
        names = sorted((t["content"] for t in self.added_tokens), key=len, reverse=True)
        return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece as little-endian bytes. Pieces of one space and visible characters keep their ids when they follow each other."""
        out: list = [b""] * len(pieces)
        plain = []
        for k, p in enumerate(pieces):
            if p[:1] == " " and p[1:].split() == [p[1:]]:
                plain.append(k)
            else:
                out[k] = np.array(self.encoding.encode_ordinary(p), dtype="<u4").tobytes()
        ids = np.array(self.encoding.encode_ordinary("".join([pieces[k] for k in plain])), dtype="<u4")
        ends = np.cumsum(self.length[ids])
        bounds = np.cumsum(np.fromiter((len(pieces[k].encode()) for k in plain), np.int64, len(plain)))
        cuts = [0, *(4 * np.searchsorted(ends, bounds, "right")).tolist()]
        raw = ids.tobytes()
        for k, begin, end in zip(plain, cuts, cuts[1:]):
            out[k] = raw[begin:end]
        return out


class TextEncoder:
    """Ids of whole texts as little-endian bytes, by cached pieces; without added_tokens those of the file are plain text."""

    def __init__(self, path: str, pattern: str, added_tokens: bool = True) -> None:
        self.vocabulary = JsonVocabulary(path, pattern)
        self.splitter = self.vocabulary.splitter() if added_tokens else None
        self.cache = PieceCache(self.vocabulary.encode_pieces)
        self.added = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in self.vocabulary.added_tokens}

    def encode(self, texts: list[str]) -> list[bytes]:
        splitter, added = self.splitter, self.added
        if splitter is None or not any(map(splitter.search, texts)):
            return self.cache.encode(texts)
        parts = [splitter.split(t) for t in texts]
        found = iter(self.cache.encode([p for cut in parts for p in cut[::2]]))
        return [b"".join(added[p] if k % 2 else next(found) for k, p in enumerate(cut)) for cut in parts]


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str, added_tokens: bool) -> TextEncoder:
    return TextEncoder(path, pattern, added_tokens)


class CapacityTree:
    """How many open windows have each remaining capacity, as a segment tree over capacities 0..n."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, at: int, by: int) -> None:
        node = at + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of an open window that is at least this; -1 if there is none."""
        node = least + self.leaves
        if self.count[node]:
            return least
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece. Lengths are from 1 to capacity; ties keep their order."""
    tree = CapacityTree(capacity)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    window = np.zeros(len(lengths), dtype=np.int64)
    offset = np.zeros(len(lengths), dtype=np.int64)
    used = 0
    order = np.argsort(-lengths, kind="stable")
    for k, length in zip(order.tolist(), lengths[order].tolist()):
        room = tree.tightest(length)
        if room < 0:
            room, at = capacity, used
            used += 1
        else:
            at = open_at[room].pop()
            tree.add(room, -1)
        window[k], offset[k] = at, capacity - room
        if room > length:
            open_at[room - length].append(at)
            tree.add(room - length, 1)
    return window, offset


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int = 0, added_tokens: bool = True) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens) of each document's full windows and remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, pattern, added_tokens)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in byte_slices(texts):
                owner, start, length, crc, total = [], [], [], [], []
                for k, ids in enumerate(encoder.encode([t or "" for t in texts[part]])):
                    ids += end
                    n = len(ids) // 4
                    for at in range(0, n, capacity):
                        owner.append(part.start + k)
                        start.append(at)
                        length.append(min(capacity, n - at))
                        crc.append(zlib.crc32(ids[4 * at : 4 * (at + capacity)]))
                        total.append(n)
                columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.record_batch(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, path: str, pattern: str, capacity: int = 1024, end_id: int = 0, per_group: int = PIECES_PER_GROUP, added_tokens: bool = True) -> DataFrame:
    """Pieces of docs with sequence_id and offset: each id of each document lies in exactly one piece."""
    spark = docs.sparkSession
    work = Workspace(spark, "packing")
    cut = work.save(pieces(docs, path, pattern, capacity, end_id, added_tokens), "pieces")
    groups = max(1, -(-cut.count() // per_group))
    dealt = cut.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "ids_crc32", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        window, offset = best_fit_decreasing(group["length"].to_numpy(), capacity)
        return group.drop(columns="_group").assign(sequence_id=(int(key[0]) << 32) + window, offset=offset)

    kind = dict(docs.dtypes)["doc_id"]
    return dealt.groupBy("_group").applyInPandas(place, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
