"""ISO media containers: write payloads as 8-bit sample tracks, walk nested boxes, index codec, duration and keyframes.

A payload becomes one track of fixed 192-byte samples (codec "raw ", unsigned 8-bit), 32 samples to a chunk, every
eighth sample a sync sample. The index comes from the boxes alone, track by track: stts gives durations, stsz or stz2
sizes, stsc and stco/co64 places, stss the sync samples, and moof/traf/trun what fragments add; no payload byte is decoded
for it. Reading a payload back is a separate step that gathers the samples' byte ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SAMPLE, PER_CHUNK, SYNC_EVERY, TIMESCALE = 192, 32, 8, 8000
#: Boxes whose payload is boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}
#: Deeper nesting than any real file's is malformed. Bytes of texts and containers that a task packs into one batch.
MAX_DEPTH, BATCH_BYTES = 32, 32_000_000
#: Flag of a fragment's sample that isn't a sync sample.
NOT_SYNC = 0x10000
ROWS_SCHEMA = "doc_id long, n_bytes long, media binary"
TRACK_FIELDS = "codec:string,timescale:long,duration:long,n_samples:long,keyframes:array<struct<start:long,end:long>>"
INDEX_SCHEMA = f"struct<{TRACK_FIELDS},tracks:array<struct<track_id:long,kind:string,{TRACK_FIELDS}>>>"


def padded(data: bytes) -> bytes:
    """Spaces appended up to a positive multiple of the sample size."""
    return data.ljust(max(SAMPLE, -(-len(data) // SAMPLE) * SAMPLE), b" ")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body if len(body) + 8 < 2**32 else struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes) -> bytes:
    return _box(kind, b"\0\0\0\0", *parts)


def _table(kind: bytes, rows: np.ndarray, *head: bytes) -> bytes:
    return _full(kind, *head, struct.pack(">I", len(rows)), rows.tobytes())


def write_container(payload: bytes) -> bytes:
    """An ISO container of one 8-bit track holding the payload, whose length is a multiple of the sample size."""
    n = len(payload) // SAMPLE
    ticks = n * SAMPLE
    ftyp = _box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  isom")
    entry = _box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] if n % PER_CHUNK == 0 else [(1, PER_CHUNK, 1)] * (chunks > 1) + [(chunks, n % PER_CHUNK, 1)]

    def movie(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (PER_CHUNK * SAMPLE)
        wide = first + len(payload) >= 2**32
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _table(b"stts", np.array([[n, SAMPLE]], dtype=">u4")),
            _table(b"stss", np.arange(1, n + 1, SYNC_EVERY).astype(">u4")),
            _table(b"stsc", np.array(runs, dtype=">u4")),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _table(b"co64", places.astype(">u8")) if wide else _table(b"stco", places.astype(">u4")),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _box(b"url ", b"\0\0\0\1")))
        minf = _box(b"minf", _full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = _box(b"mdhd", b"\1\0\0\0", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0))
        mdia = _box(b"mdia", mdhd, _full(b"hdlr", bytes(4), b"soun", bytes(13)), minf)
        mvhd = _box(b"mvhd", b"\1\0\0\0", struct.pack(">QQIQIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10 + 36 + 24), struct.pack(">I", 2))
        tkhd = _box(b"tkhd", b"\1\0\0\7", struct.pack(">QQIIQ", 0, 0, 1, 0, ticks), bytes(60))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 2**32 else 8
    moov = movie(len(ftyp) + head)
    moov = movie(len(ftyp) + len(moov) + head)  # offsets change no sizes below 4 GB
    return ftyp + moov + _box(b"mdat", payload)


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, depth first. Truncated, malformed or too deeply nested boxes raise ValueError."""
    inside: list[tuple[tuple[bytes, ...], int]] = [((), len(data))]
    at = 0
    while inside:
        path, end = inside[-1]
        if at >= end:
            inside.pop()
            continue
        if at + 8 > end:
            raise ValueError("truncated box header")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("truncated box header")
            (size,), body = struct.unpack_from(">Q", data, at + 8), at + 16
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError("box exceeds its parent")
        here = (*path, kind)
        yield here, body, stop
        at = stop
        if kind in CONTAINERS:
            if len(here) > MAX_DEPTH:
                raise ValueError("boxes nested too deeply")
            inside.append((here, stop))
            at = body


@dataclass
class Track:
    """One track's sample tables, decoded: place and size of every sample, and which ones are sync samples."""

    track_id: int = 0
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    sync: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))

    def add(self, starts: np.ndarray, sizes: np.ndarray, sync: np.ndarray, duration: int, limit: int) -> None:
        if len(starts) and ((starts < 0).any() or (starts + sizes > limit).any()):
            raise ValueError("sample outside the file")
        if len(sync) and (sync.min() < 0 or sync.max() >= len(sizes)):
            raise ValueError("sync sample outside the track")
        self.sync = np.concatenate([self.sync, sync + len(self.sizes)])
        self.starts, self.sizes = np.concatenate([self.starts, starts]), np.concatenate([self.sizes, sizes])
        self.duration += duration

    def keyframes(self) -> list[tuple[int, int]]:
        first = self.starts[self.sync]
        return list(zip(first.tolist(), (first + self.sizes[self.sync]).tolist(), strict=True))


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _numbers(data: bytes, box: tuple[int, int], kind: str, columns: int = 1, head: int = 4) -> np.ndarray:
    """A box's table of big-endian numbers after its version, flags and count, which has to fit the box."""
    body, stop = box
    _need(body + head + 4 <= stop, "truncated table")
    (n,) = struct.unpack_from(">I", data, body + head)
    _need(n * columns * np.dtype(kind).itemsize <= stop - body - head - 4, "table exceeds its box")
    return np.frombuffer(data, dtype=kind, count=n * columns, offset=body + head + 4).astype(np.int64).reshape(n, columns)


def _sizes(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Sample sizes from stsz, or from stz2 with its fields of 4, 8 or 16 bits."""
    body, stop = boxes.get(b"stsz") or boxes[b"stz2"]
    _need(body + 12 <= stop, "truncated table")
    one, n = struct.unpack_from(">II", data, body + 4)
    room = stop - body - 12
    if b"stsz" in boxes:
        if one:
            _need(one * n <= len(data), "samples exceed the file")
            return np.full(n, one, dtype=np.int64)
        _need(4 * n <= room, "table exceeds its box")
        return np.frombuffer(data, dtype=">u4", count=n, offset=body + 12).astype(np.int64)
    bits = one & 0xFF
    _need(bits in (4, 8, 16) and (n * bits + 7) // 8 <= room, "table exceeds its box")
    if bits == 4:
        packed = np.frombuffer(data, dtype=np.uint8, count=(n + 1) // 2, offset=body + 12)
        return np.stack([packed >> 4, packed & 15], axis=1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, dtype=f">u{bits // 8}", count=n, offset=body + 12).astype(np.int64)


def _moov_track(data: bytes, boxes: dict[bytes, tuple[int, int]]) -> Track:
    _need({b"stsd", b"stts", b"stsc", b"mdhd"} <= boxes.keys() and bool(boxes.keys() & {b"stsz", b"stz2"}) and bool(boxes.keys() & {b"stco", b"co64"}), "no sample tables")
    t = Track()
    for name, at in ((b"tkhd", 12), (b"mdhd", 12)):
        if name in boxes:
            body, stop = boxes[name]
            place = body + at + 8 * (data[body : body + 1] == b"\1")
            _need(place + 4 <= stop, "truncated header")
            (number,) = struct.unpack_from(">I", data, place)
            t.track_id, t.timescale = (number, t.timescale) if name == b"tkhd" else (t.track_id, number)
    t.codec = data[boxes[b"stsd"][0] + 12 : min(boxes[b"stsd"][0] + 16, boxes[b"stsd"][1])].decode("latin-1")
    t.kind = data[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12].decode("latin-1") if b"hdlr" in boxes else ""
    times = _numbers(data, boxes[b"stts"], ">u4", 2)
    sizes = _sizes(data, boxes)
    places = _numbers(data, boxes[b"co64"], ">u8")[:, 0] if b"co64" in boxes else _numbers(data, boxes[b"stco"], ">u4")[:, 0]
    runs = _numbers(data, boxes[b"stsc"], ">u4", 3)
    chunks = np.diff(np.append(runs[:, 0], len(places) + 1)) if len(runs) else np.zeros(0, dtype=np.int64)
    _need(bool((chunks >= 0).all()) and (not len(runs) or runs[0, 0] == 1), "chunks out of order")
    _need(int((chunks * runs[:, 1]).sum()) == len(sizes), "chunks and samples disagree")
    per = np.repeat(runs[:, 1], chunks)
    chunk = np.repeat(np.arange(len(per)), per)
    before = np.cumsum(sizes) - sizes
    first = np.minimum(np.cumsum(per) - per, max(len(sizes) - 1, 0))
    starts = places[chunk] + before - before[first][chunk] if len(sizes) else before
    sync = _numbers(data, boxes[b"stss"], ">u4")[:, 0] - 1 if b"stss" in boxes else np.arange(len(sizes))
    t.add(starts, sizes, sync, int((times[:, 0] * times[:, 1]).sum()), len(data))
    return t


def _run(data: bytes, moof: int, header: dict, body: int, stop: int, after: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(places, sizes, sync samples, duration) of a fragment's run of samples; after: where the run before it ended."""
    _need(body + 8 <= stop, "truncated run")
    flags, n = struct.unpack_from(">II", data, body)
    flags &= 0xFFFFFF
    at, first = body + 8, after
    if flags & 1:
        _need(at + 4 <= stop, "truncated run")
        first, at = header["base"] + struct.unpack_from(">i", data, at)[0], at + 4
    own = None
    if flags & 4:
        _need(at + 4 <= stop, "truncated run")
        own, at = struct.unpack_from(">I", data, at)[0], at + 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    _need(4 * n * len(fields) <= stop - at and (bool(fields) or n * max(1, header["size"]) <= len(data)), "run exceeds its box")
    rows = np.frombuffer(data, dtype=">u4", count=n * len(fields), offset=at).astype(np.int64).reshape(n, len(fields)) if fields else np.zeros((n, 0), dtype=np.int64)
    value = lambda bit, default: rows[:, fields.index(bit)] if bit in fields else np.full(n, default, dtype=np.int64)
    sizes, marks = value(0x200, header["size"]), value(0x400, header["flags"])
    if own is not None and n:
        marks = np.append(own, marks[1:])
    return first + np.cumsum(sizes) - sizes, sizes, np.flatnonzero(marks & NOT_SYNC == 0), int(value(0x100, header["duration"]).sum())


def tracks(data: bytes) -> list[Track]:
    """Every track in order, with the samples of its tables and of the fragments that name it.

    Edit lists shift presentation, not bytes, and are left out. ValueError for media without tracks, and for tables,
    runs or samples that exceed their box or the file.
    """
    found: list[Track] = []
    boxes: dict[bytes, tuple[int, int]] = {}
    defaults: dict[int, tuple[int, int, int]] = {}
    moof, header, after = 0, {}, 0
    open_ = False

    def close() -> None:
        nonlocal open_
        if open_:
            found.append(_moov_track(data, boxes))
            boxes.clear()
        open_ = False

    for path, body, stop in walk(data):
        kind = path[-1]
        if b"trak" not in path:
            close()
        if kind == b"trak":
            close()
            open_ = True
        elif b"trak" in path:
            boxes.setdefault(kind, (body, stop))
        elif path[-2:] == (b"mvex", b"trex"):
            _need(body + 24 <= stop, "truncated defaults")
            number, _, *rest = struct.unpack_from(">5I", data, body + 4)
            defaults[number] = tuple(rest)
        elif kind == b"moof":
            moof = after = body - (8 if data[body - 4 : body] == b"moof" else 16)  # a box of 64-bit size has a longer header
        elif path[-2:] == (b"traf", b"tfhd"):
            header = _fragment_header(data, body, stop, moof, defaults)
            after = header["base"]
        elif path[-2:] == (b"traf", b"trun"):
            t = next((t for t in found if t.track_id == header.get("track")), None)
            _need(t is not None, "fragment of no track")
            starts, sizes, sync, duration = _run(data, moof, header, body, stop, after)
            t.add(starts, sizes, sync, duration, len(data))
            after = int(starts[-1] + sizes[-1]) if len(starts) else after
    close()
    _need(bool(found), "no tracks")
    return found


def _fragment_header(data: bytes, body: int, stop: int, moof: int, defaults: dict[int, tuple[int, int, int]]) -> dict:
    _need(body + 8 <= stop, "truncated fragment header")
    flags, number = struct.unpack_from(">II", data, body)
    at = body + 8
    duration, size, marks = defaults.get(number, (0, 0, 0))
    base = moof
    for bit, name, form in ((1, "base", ">Q"), (2, "", ">I"), (8, "duration", ">I"), (16, "size", ">I"), (32, "flags", ">I")):
        if flags & bit:
            _need(at + struct.calcsize(form) <= stop, "truncated fragment header")
            (value,) = struct.unpack_from(form, data, at)
            at += struct.calcsize(form)
            base, duration, size, marks = (value if name == "base" else base), (value if name == "duration" else duration), (value if name == "size" else size), (value if name == "flags" else marks)
    _need(base <= len(data), "fragment beyond the file")
    return {"track": number, "base": base, "duration": duration, "size": size, "flags": marks}


def read_payload(data: bytes, t: Track | None = None) -> bytes:
    """The bytes of a track's samples in order, the first track's by default; runs of adjoining samples are read at once."""
    t = t or tracks(data)[0]
    if not len(t.sizes):
        return b""
    starts, ends = t.starts, t.starts + t.sizes
    cuts = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    return b"".join(data[a:b] for a, b in zip(starts[np.append(0, cuts)], ends[np.append(cuts - 1, len(ends) - 1)], strict=True))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def flush() -> pa.RecordBatch:
        ids, sizes, media = zip(*rows, strict=True)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode()
            rows.append((doc_id.as_py(), len(raw), write_container(padded(raw))))
            held += len(rows[-1][2])
            if held >= BATCH_BYTES:
                yield flush()
                held = 0
    if rows:
        yield flush()


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 bytes, padded, in a container. Null and empty texts give 192 spaces.

    One row per row, repeated rows too; null ids stay; an empty table gives none; extra columns are not read.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_write, ROWS_SCHEMA)


def index_media(media: Column) -> Column:
    """Struct: the first track's codec, timescale, duration, sample count and keyframes' byte ranges, and the same of all tracks.

    Null for null or malformed media, whatever is wrong with it.
    """
    return F.udf(_index, INDEX_SCHEMA, useArrow=True)(media)


def _index(media: bytes | None) -> tuple | None:
    if media is None:
        return None
    try:
        found = tracks(bytes(media))
    except ValueError:
        return None
    rows = [(t.track_id, t.kind, t.codec, t.timescale, t.duration, len(t.sizes), t.keyframes()) for t in found]
    return (*rows[0][2:], rows)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(*batch.columns, strict=True):
            media = media.as_py()
            t = tracks(media)[0]
            payload = read_payload(media, t)
            ranges = ",".join(f"{a}-{b}" for a, b in t.keyframes())
            feature = f"codec={t.codec.strip()};seconds={t.duration / t.timescale:.3f};samples={len(t.sizes)};keyframes={ranges}"
            rows.append((doc_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)


def media_digests(media: DataFrame) -> DataFrame:
    """Read stored media back: payload and container digests and the features of the index, one row per row.

    For media as store_texts() makes it: null or malformed media is an error there, not a row of nulls; index_media() is the
    column for media of others. Null ids and repeated rows stay; an empty table gives no rows; extra columns are not read.
    """
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
