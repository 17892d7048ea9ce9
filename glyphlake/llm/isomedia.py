"""ISO base media files as columns: writing 8-bit samples, walking boxes, decoding sample tables.

A payload is stored losslessly as one track of unsigned 8-bit PCM (sample entry "raw "): an access unit is 64
bytes, a chunk is 1,024 units, and every sixteenth unit is marked as a sync sample. Reading walks the nested
boxes and decodes the sample tables of every track (stsz or stz2, stsc, stco or co64, stts, stss) without
touching the payload; a second function reads given byte ranges.

Defined results: null and empty texts are payloads of 64 zero bytes; a null container, or bytes that are not
one, give a row with an error text and null facts; box sizes that point outside their parent are an error too.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

UNIT = 64
UNITS_PER_CHUNK = 1024
SYNC_EVERY = 16
RATE = 8000
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
_UNITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *body: bytes) -> bytes:
    data = b"".join(body)
    if len(data) + 8 < 1 << 32:
        return struct.pack(">I4s", len(data) + 8, kind) + data
    return struct.pack(">I4sQ", 1, kind, len(data) + 16) + data


def full(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *body)


def pad(data: bytes) -> bytes:
    """Data with zero bytes up to a positive multiple of the unit."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def write(payload: bytes) -> bytes:
    """A container that holds payload (a positive multiple of 64 bytes) as 8-bit samples."""
    units = len(payload) // UNIT
    brand = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ", b"isom")
    header = 16 if len(payload) + 8 >= 1 << 32 else 8
    begin = len(brand) + header
    chunks = -(-units // UNITS_PER_CHUNK)
    offsets = begin + np.arange(chunks, dtype=np.uint64) * (UNIT * UNITS_PER_CHUNK)
    runs = [(1, UNITS_PER_CHUNK, 1)] if units >= UNITS_PER_CHUNK else []
    if units % UNITS_PER_CHUNK:
        runs.append((chunks, units % UNITS_PER_CHUNK, 1))
    wide = bool(offsets[-1] >= 1 << 32)
    where = full(b"co64" if wide else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if wide else ">u4").tobytes())
    sync = np.arange(1, units + 1, SYNC_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">HHIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    table = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), entry),
        full(b"stts", struct.pack(">III", 1, units, UNIT)),
        full(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", UNIT, units)),
        where,
    )
    long = len(payload)
    media = box(
        b"mdia",
        full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, min(long, 0xFFFFFFFF), 0x55C4, 0)),
        full(b"hdlr", bytes(4), b"soun", bytes(12), b"samples\0"),
        box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
    )
    track = full(b"tkhd", struct.pack(">IIIIIQHHHH", 0, 0, 1, 0, min(long, 0xFFFFFFFF), 0, 0, 0, 0x100, 0), _UNITY, bytes(8), flags=7)
    movie = full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, min(long, 0xFFFFFFFF), 0x10000, 0x100), bytes(10), _UNITY, bytes(24), struct.pack(">I", 2))
    return brand + box(b"mdat", payload) + box(b"moov", movie, box(b"trak", track, media))


def walk(data: bytes, begin: int = 0, end: int | None = None, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of types, start of body, end of body) of every box, outer ones first."""
    end = len(data) if end is None else end
    while begin < end:
        if end - begin < 8:
            raise ValueError(f"{end - begin} stray bytes at {begin}")
        size, kind = struct.unpack_from(">I4s", data, begin)
        head = 8
        if size == 1:
            if end - begin < 16:
                raise ValueError(f"cut large box at {begin}")
            size, head = struct.unpack_from(">Q", data, begin + 8)[0], 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} at {begin} has size {size}")
        yield (*path, kind), begin + head, begin + size
        if kind in NESTED:
            yield from walk(data, begin + head, begin + size, (*path, kind))
        begin += size


def _numbers(data: bytes, at: int, end: int, kind: str, count: int) -> np.ndarray:
    if at + np.dtype(kind).itemsize * count > end:
        raise ValueError(f"a table of {count} entries at {at} is cut")
    return np.frombuffer(data, dtype=kind, count=count, offset=at).astype(np.int64)


def _count(data: bytes, at: int) -> int:
    return struct.unpack_from(">I", data, at)[0]


def sample_ranges(tables: dict[bytes, tuple[int, int]], data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offset, size and sync mark of every sample of a track, from its tables alone."""
    if b"stsz" in tables:
        at, end = tables[b"stsz"]
        common, count = struct.unpack_from(">II", data, at + 4)
        sizes = np.full(count, common, np.int64) if common else _numbers(data, at + 12, end, ">u4", count)
    else:
        at, end = tables[b"stz2"]
        width, count = data[at + 7], _count(data, at + 8)
        if width == 4:
            packed = _numbers(data, at + 12, end, "u1", (count + 1) // 2)
            sizes = np.stack((packed >> 4, packed & 15), axis=1).reshape(-1)[:count]
        else:
            sizes = _numbers(data, at + 12, end, {8: "u1", 16: ">u2"}[width], count)
    at, end = tables.get(b"stco") or tables[b"co64"]
    chunks = _numbers(data, at + 8, end, ">u4" if b"stco" in tables else ">u8", _count(data, at + 4))
    at, end = tables[b"stsc"]
    runs = _numbers(data, at + 8, end, ">u4", 3 * _count(data, at + 4)).reshape(-1, 3)
    first = np.concatenate((runs[:, 0] - 1, [len(chunks)]))
    per_chunk = np.repeat(runs[:, 1], np.diff(first))[: len(chunks)]
    if per_chunk.sum() != len(sizes):
        raise ValueError(f"chunks hold {per_chunk.sum()} samples, sizes {len(sizes)}")
    before = np.concatenate(([0], np.cumsum(sizes)))
    starts = np.concatenate(([0], np.cumsum(per_chunk)))[:-1]
    offsets = np.repeat(chunks - before[starts.clip(max=len(sizes))], per_chunk) + before[:-1]
    sync = np.ones(len(sizes), dtype=bool)
    if b"stss" in tables:
        at, end = tables[b"stss"]
        sync[:] = False
        sync[_numbers(data, at + 8, end, ">u4", _count(data, at + 4)) - 1] = True
    return offsets, sizes, sync


def read(data: bytes) -> list[dict]:
    """For each track: codec, handler, timescale, duration, and the samples' offsets, sizes and sync marks."""
    tracks: list[dict] = []
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"tables": {}})
        elif kind == b"mdhd":
            tracks[-1]["timescale"], tracks[-1]["duration"] = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
        elif kind == b"hdlr" and b"trak" in path:
            tracks[-1]["handler"] = data[at + 8 : at + 12].decode("latin-1")
        elif b"stbl" in path[:-1]:
            tracks[-1]["tables"][kind] = (at, end)
            if kind == b"stsd" and end - at >= 16:
                tracks[-1]["codec"] = data[at + 12 : at + 16].decode("latin-1")
    for track in tracks:
        tables = track.pop("tables")
        track["offsets"], track["sizes"], track["sync"] = sample_ranges(tables, data)
        at, end = tables[b"stts"]
        times = _numbers(data, at + 8, end, ">u4", 2 * _count(data, at + 4)).reshape(-1, 2)
        track["ticks"] = int((times[:, 0] * times[:, 1]).sum())
        if len(track["sizes"]) and int((track["offsets"] + track["sizes"]).max()) > len(data):
            raise ValueError("samples lie outside the file")
    return tracks


def merged(offsets: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges (offset, length) with neighbours that touch put together."""
    if not len(offsets):
        return []
    first = np.flatnonzero(np.concatenate(([True], offsets[1:] != offsets[:-1] + sizes[:-1])))
    return list(zip(offsets[first].tolist(), np.add.reduceat(sizes, first).tolist()))


def facts(media: DataFrame, id_column: str, column: str) -> DataFrame:
    """Rows (id, track, codec, handler, timescale, duration, samples, key_offsets, key_sizes, error) of a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for k, data in enumerate(batch.column(1).to_pylist()):
                try:
                    if data is None:
                        raise ValueError("null")
                    tracks = read(data)
                    if not tracks:
                        raise ValueError("no track")
                    new = [{"track": n, "codec": t.get("codec"), "handler": t.get("handler"), "timescale": t.get("timescale"), "duration": t["ticks"], "samples": len(t["sizes"]), "key_offsets": t["offsets"][t["sync"]].tolist(), "key_sizes": t["sizes"][t["sync"]].tolist(), "error": None} for n, t in enumerate(tracks)]
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    new = [{"error": f"{type(e).__name__}: {e}"}]
                rows += new
                owner += [k] * len(new)
            kinds = {"track": pa.int32(), "codec": pa.string(), "handler": pa.string(), "timescale": pa.int64(), "duration": pa.int64(), "samples": pa.int64(), "key_offsets": pa.list_(pa.int64()), "key_sizes": pa.list_(pa.int64()), "error": pa.string()}
            yield pa.record_batch([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array([r.get(c) for r in rows], kind) for c, kind in kinds.items())], names=[id_column, *kinds])

    kind = dict(media.dtypes)[id_column]
    return media.select(id_column, column).mapInArrow(run, f"`{id_column}` {kind}, track int, codec string, handler string, timescale long, duration long, samples long, key_offsets array<long>, key_sizes array<long>, error string")


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary) of every document: its UTF-8 bytes, padded, as a media file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [write(pad((t or "").encode())) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(media, pa.binary())], names=["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, media binary")


def describe(data: bytes) -> tuple[bytes, str]:
    """The stored bytes of the only track, read back by its sample table, and its feature text."""
    (track,) = read(data)
    payload = b"".join(data[at : at + n] for at, n in merged(track["offsets"], track["sizes"]))
    keys = hashlib.md5()
    for at, n in zip(track["offsets"][track["sync"]].tolist(), track["sizes"][track["sync"]].tolist()):
        keys.update(b"%d+%d;" % (at, n))
    feature = f"codec={track['codec'].strip()};rate={track['timescale']};seconds={track['ticks'] / track['timescale']:.6f};samples={len(track['sizes'])};keyframes={int(track['sync'].sum())};ranges={keys.hexdigest()}"
    return payload, feature


def digests(docs: DataFrame) -> DataFrame:
    """Each document stored as a media file, walked and read back; digests of what was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode()
                media = write(pad(raw))
                payload, feature = describe(media)
                rows.append((len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
            yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values()))], names=["doc_id", *kinds])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
