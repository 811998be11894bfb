"""Operator 9, media columns: ISO base media files, written losslessly and walked box by box without decoding payloads."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm._common import chunks, id_and_text

#: Bytes of a sample, samples of a chunk, samples from one keyframe to the next, ticks of a second.
SAMPLE = 192
CHUNK_SAMPLES = 64
KEY_EVERY = 16
TIMESCALE = 48_000
#: Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl"}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


_UNIT = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def write_media(payload: bytes) -> bytes:
    """A file with one track of raw 8-bit samples. It holds no time and no id: equal payloads give equal files."""
    n = len(payload) // SAMPLE
    if n < 1 or n * SAMPLE != len(payload):
        raise ValueError("the payload must be a positive multiple of a sample's bytes")
    n_chunks = -(-n // CHUNK_SAMPLES)
    last = n - (n_chunks - 1) * CHUNK_SAMPLES
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    mdat_header = 16  # always the long form, so that offsets don't depend on the size
    base = len(ftyp) + mdat_header
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16 & 0xFFFFFFFF))
    runs = [(1, CHUNK_SAMPLES, 1)] if last == CHUNK_SAMPLES else [(1, last, 1)] if n_chunks == 1 else [(1, CHUNK_SAMPLES, 1), (n_chunks, last, 1)]
    offsets = base + np.arange(n_chunks, dtype=np.uint64) * np.uint64(CHUNK_SAMPLES * SAMPLE)
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", SAMPLE, n)),
        _full(b"co64", struct.pack(">I", n_chunks), offsets.astype(">u8").tobytes()),
    )
    minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdhd = struct.pack(">IIIIHH", 0, 0, TIMESCALE, n * SAMPLE & 0xFFFFFFFF, 0x55C4, 0)
    mdia = _box(b"mdia", _full(b"mdhd", mdhd), _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
    tkhd = struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n * SAMPLE & 0xFFFFFFFF, 0, 0, 0x100, 0) + _UNIT + bytes(8)
    mvhd = struct.pack(">IIIIIH10x", 0, 0, TIMESCALE, n * SAMPLE & 0xFFFFFFFF, 0x10000, 0x100) + _UNIT + bytes(24) + struct.pack(">I", 2)
    moov = _box(b"moov", _full(b"mvhd", mvhd), _box(b"trak", _full(b"tkhd", tkhd, flags=7), mdia))
    return ftyp + struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) + payload + moov


def boxes(data: memoryview | bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start and end of the body) of the boxes side by side in data[start:end]. A box that doesn't fit is an error."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a long box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} doesn't fit")
        yield kind, start + head, start + size
        start += size


def _tree(data, start: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    for kind, a, b in boxes(data, start, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from _tree(data, a, b, (*path, kind))


@dataclass(frozen=True)
class Track:
    codec: str
    timescale: int
    duration: int
    offsets: np.ndarray  # of each sample, in the file
    sizes: np.ndarray
    keys: np.ndarray  # numbers of the keyframes, from 0

    def ranges(self, samples: np.ndarray) -> list[tuple[int, int]]:
        """Byte ranges (start, end) of samples, neighbours joined."""
        out: list[tuple[int, int]] = []
        for a, n in zip(self.offsets[samples].tolist(), self.sizes[samples].tolist()):
            if out and out[-1][1] == a:
                out[-1] = (out[-1][0], a + n)
            else:
                out.append((a, a + n))
        return out


def _u32(data, at: int, n: int, end: int) -> np.ndarray:
    if n < 0 or at + 4 * n > end:
        raise ValueError("a table is cut off")
    return np.frombuffer(data, ">u4", n, at).astype(np.int64)


def read_tracks(data: bytes) -> list[Track]:
    """The tracks' sample tables; mdat is stepped over. Without stss every sample is a keyframe."""
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, a, b in _tree(data, 0, len(data)):
        if path[-1] == b"trak":
            tracks.append({})
        elif tracks and path[:2] == (b"moov", b"trak"):
            tracks[-1][path[-1]] = (a, b)
    found = []
    for t in tracks:
        a, b = t[b"mdhd"]
        long = data[a] == 1
        timescale, duration = struct.unpack_from(">IQ" if long else ">II", data, a + (20 if long else 12))
        a, b = t[b"stsd"]
        codec = data[a + 12 : a + 16].decode("latin-1").strip()
        a, b = t[b"stts"]
        times = _u32(data, a + 8, 2 * struct.unpack_from(">I", data, a + 4)[0], b).reshape(-1, 2)
        duration = int((times[:, 0] * times[:, 1]).sum())  # the header's field may be too short for it
        a, b = t[b"stsz"]
        size, n = struct.unpack_from(">II", data, a + 4)
        sizes = np.full(n, size, np.int64) if size else _u32(data, a + 12, n, b)
        if b"co64" in t:
            a, b = t[b"co64"]
            count = struct.unpack_from(">I", data, a + 4)[0]
            if a + 8 + 8 * count > b:
                raise ValueError("a table is cut off")
            at = np.frombuffer(data, ">u8", count, a + 8).astype(np.int64)
        else:
            a, b = t[b"stco"]
            at = _u32(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], b)
        a, b = t[b"stsc"]
        runs = _u32(data, a + 8, 3 * struct.unpack_from(">I", data, a + 4)[0], b).reshape(-1, 3)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(at) + 1)))
        if per_chunk.sum() != n:
            raise ValueError("chunks and samples disagree")
        first = np.cumsum(per_chunk) - per_chunk  # the first sample of each chunk
        before = np.cumsum(sizes) - sizes
        offsets = np.repeat(at - before[first] if len(at) else at, per_chunk) + before
        keys = np.arange(n)
        if b"stss" in t:
            a, b = t[b"stss"]
            keys = _u32(data, a + 8, struct.unpack_from(">I", data, a + 4)[0], b) - 1
        found.append(Track(codec, timescale, duration, offsets, sizes, keys))
    return found


def payload_of(data: bytes, track: Track) -> bytes:
    return b"".join(data[a:b] for a, b in track.ranges(np.arange(len(track.sizes))))


def padded(raw: bytes) -> bytes:
    return raw + b"\x20" * ((-len(raw)) % SAMPLE or (SAMPLE if not raw else 0))


def feature_of(track: Track) -> str:
    """codec;timescale;duration;keyframes;byte ranges of the keyframes as start-end."""
    return f"{track.codec};{track.timescale};{track.duration};{len(track.keys)};" + ",".join(f"{a}-{b}" for a, b in track.ranges(track.keys))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A media file for each input row: doc_id, n_bytes (of the text), media (binary). Null and empty texts become one sample of spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            raw = [t.encode() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_media(padded(x)) for x in raw], pa.large_binary()).cast(pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def described(media: DataFrame, column: str = "media") -> DataFrame:
    """For each file: the media column's sizes, hashes and sample-table features, read back from the stored bytes. Other columns stay."""
    names = [c for c in media.columns if c != column]
    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = ", ".join(f"`{n}` {t}" for n, t in media.select(*names).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                rows = []
                for data in batch.column(len(names)).to_pylist():
                    if data is None:
                        rows.append((None,) * 6)
                        continue
                    track = read_tracks(data)[0]
                    payload = payload_of(data, track)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(track)))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                cols = list(zip(*rows)) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, t) for c, t in zip(cols, types))], [*names, *(f.split()[0] for f in fields.split(", "))])

    return media.select(*names, column).mapInArrow(run, f"{kinds}, {fields}" if kinds else fields)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each input row: the text stored as media, then described from the stored bytes. Equal texts give equal values; repeated rows
    are stored again, an empty table gives no rows, other columns are ignored. There is no shuffle."""
    return described(stored(docs, id_col, text_col))
