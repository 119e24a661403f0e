"""MPEG audio columns: write, parse, resynchronise, verify and seek.

A written stream is an ID3v2.3 tag, a frame with the variable-bitrate table, and MPEG-1
Layer III mono frames with a checksum; parsed are Layer III streams of MPEG-1, 2 and 2.5
with ID3v1, v2.3 and v2.4 tags and Xing, Info or VBRI tables. A frame's side information is zero, so it
plays silence and the rest of the frame is ancillary data, where the payload lies
byte for byte. Everything is per row: one narrow pass each way, memory bounded by
one Arrow batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from folio.llm.recent import small_batches
from folio.llm.text import binary_column

# Fixed values of the MPEG Layer III frame header: kbit/s by bitrate index, Hz by rate index.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LOW_BITRATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
#: By the version bits of a header: bitrates, what the rates are divided by, samples a frame, side information if mono or not.
VERSIONS = {3: (BITRATES, 1, 1152, 17, 32), 2: (LOW_BITRATES, 2, 576, 9, 17), 0: (LOW_BITRATES, 4, 576, 9, 17)}
# Encodings of tag texts, by their first byte.
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")
SAMPLES = 1152
RATE = 32000
BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes, c: int = 0xFFFF) -> int:
    """The frame checksum: polynomial 0x8005, most significant bit first."""
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


def frame_bytes(bitrate: int, rate: int = RATE, padding: int = 0) -> int:
    return SAMPLES // 8 * bitrate * 1000 // rate + padding


def _head(index: int, checked: bool) -> bytes:
    return bytes((0xFF, 0xFA if checked else 0xFB, index << 4 | RATES.index(RATE) << 2, 0xC0))


#: Head, checksum and side information of a frame by bitrate index, and the payload it holds.
_PREFIX = {i: (h := _head(i, True)) + struct.pack(">H", crc16(h[2:] + bytes(17))) + bytes(17) for i in range(1, 15)}
_ROOM = {i: frame_bytes(BITRATES[i]) - len(_PREFIX[i]) for i in range(1, 15)}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """The stream that stores the payload; equal payloads give equal streams."""
    return encoded(payload)[0]


def encoded(payload: bytes) -> tuple[bytes, np.ndarray]:
    """The stream, and where in it the frames begin that hold the payload."""
    text = b"\0payload-bytes\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    tag = b"ID3\x03\0\0" + _syncsafe(len(tag)) + tag
    full, rest = divmod(len(payload), _ROOM[14])
    parts = [x for i in range(full) for x in (_PREFIX[14], payload[i * _ROOM[14] : (i + 1) * _ROOM[14]])]
    sizes = [frame_bytes(320)] * full
    if rest:
        i = next(i for i in range(1, 15) if _ROOM[i] >= rest)
        parts += [_PREFIX[i], payload[-rest:].ljust(_ROOM[i], b"\0")]
        sizes.append(frame_bytes(BITRATES[i]))
    first = frame_bytes(64)
    ends = np.cumsum([first, *sizes])
    total, n = int(ends[-1]), len(sizes)
    at = np.arange(100) * n // 100
    toc = bytes(np.minimum(255, ends[at] * 256 // total).astype(np.uint8))
    info = _head(5, False) + bytes(17) + b"Xing" + struct.pack(">III", 7, n, total) + toc
    return tag + info.ljust(first, b"\0") + b"".join(parts), len(tag) + ends[:-1].astype(np.int64)


@dataclass
class Stream:
    """What a parse found. Offsets count from the stream's first byte; duration is samples / rate, exact."""

    tags: dict[str, str] = field(default_factory=dict)
    rate: int = 0
    samples: int = 0
    offsets: list[int] = field(default_factory=list)
    bad_checksums: int = 0
    skipped: int = 0
    declared_frames: int | None = None
    toc: bytes | None = None
    payload: bytes = b""


@dataclass(frozen=True)
class Header:
    size: int
    rate: int
    samples: int
    side: int
    checked: bool


def _header(data: bytes, at: int) -> Header | None:
    """The Layer III header there, if there is one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE6 != 0xE2:
        return None
    version, index, rate = data[at + 1] >> 3 & 3, data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version not in VERSIONS or index in (0, 15) or rate == 3:
        return None
    bitrates, divisor, samples, mono, other = VERSIONS[version]
    hz = RATES[rate] // divisor
    size = samples // 8 * bitrates[index] * 1000 // hz + (data[at + 2] >> 1 & 1)
    return Header(size, hz, samples, mono if data[at + 3] >> 6 == 3 else other, not data[at + 1] & 1)


def _text(raw: bytes) -> str:
    """A tag's text after its encoding byte, up to trailing NULs."""
    if not raw:
        return ""
    return raw[1:].decode(ENCODINGS[raw[0]] if raw[0] < len(ENCODINGS) else "latin-1", "replace").rstrip("\0")


def _syncsafe_value(raw: bytes) -> int:
    return sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0)))


def _tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(texts by name, where audio begins, where it ends) of the ID3v2 tag in front and the ID3v1 tag at the end."""
    tags, stop = {}, len(data)
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        stop -= 128
        for name, a, b in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93)):
            if value := data[stop + a : stop + b].split(b"\0")[0].decode("latin-1").strip():
                tags[name] = value
    if len(data) < 10 or data[:3] != b"ID3":
        return tags, 0, stop
    end = 10 + _syncsafe_value(data[6:10])
    at, number = 10, _syncsafe_value if data[3] >= 4 else lambda raw: int.from_bytes(raw, "big")
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        size = number(data[at + 4 : at + 8])
        body, name = data[at + 10 : at + 10 + size], data[at : at + 4].decode("latin-1")
        if name == "TXXX":
            name, _, value = _text(body).partition("\0")
            tags[name] = value.lstrip("\ufeff")
        elif name.startswith("T"):
            tags[name] = _text(body)
        at += 10 + size
    return tags, end, max(end, stop)


def _table(data: bytes, at: int, h: Header, out: Stream) -> bool:
    """Reads the variable-bitrate table of a first frame, if it holds one."""
    x = at + 4 + 2 * h.checked + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags = int.from_bytes(data[x + 4 : x + 8], "big")
        x += 8
        if flags & 1:
            out.declared_frames, x = int.from_bytes(data[x : x + 4], "big"), x + 4
        x += 4 * bool(flags & 2)
        out.toc = data[x : x + 100] if flags & 4 else None
        return True
    x = at + 36
    if data[x : x + 4] == b"VBRI":
        out.declared_frames = int.from_bytes(data[x + 14 : x + 18], "big")
        n, width = (int.from_bytes(data[x + k : x + k + 2], "big") for k in (18, 22))
        out.toc = data[x + 26 : x + 26 + n * width]
        return True
    return False


def parse(data: bytes) -> Stream:
    """Reads a stream; bytes that are no frame are skipped up to the next two headers in a row (or one that ends the data)."""
    out = Stream()
    out.tags, at, stop = _tags(data)
    body, first, sure = [], True, False
    while at < stop:
        h = _header(data, at)
        if h is None or at + h.size > stop or not (sure or at + h.size == stop or _header(data, at + h.size)):
            nxt = data.find(b"\xff", at + 1, stop)
            out.skipped += (nxt if nxt >= 0 else stop) - at
            at, sure = nxt if nxt >= 0 else stop, False
            continue
        sure, start = True, at + 4 + 2 * h.checked
        if h.checked and crc16(data[at + 2 : at + 4] + data[start : start + h.side]) != int.from_bytes(data[at + 4 : at + 6], "big"):
            out.bad_checksums += 1
        if not (first and _table(data, at, h, out)):
            out.offsets.append(at)
            body.append(data[start + h.side : at + h.size])
            out.samples += h.samples
        out.rate, first = h.rate, False
        at += h.size
    raw, n = b"".join(body), out.tags.get("payload-bytes", "")
    out.payload = raw[: int(n)] if n.isdigit() else raw
    return out


_STORED = "doc_id long, n_bytes long, media binary, samples long, rate int, frame_offsets array<long>"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary), samples and rate (whose quotient is the exact duration in seconds) and frame_offsets.

    The media holds the whole text as UTF-8, zero-padded to a positive multiple of 64; a
    seek to sample s reads from frame_offsets[s div 1152]. A null text is empty; repeated
    rows stay; a null doc_id stays null; an empty table gives no rows; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(i, 500)
                texts = binary_column(part, "text")
                made = [encoded(t.ljust(max(1, -(-len(t) // BLOCK)) * BLOCK, b"\0")) for t in texts]
                cols = [pa.array([len(t) for t in texts], pa.int64()), pa.array([m for m, _ in made], pa.binary()), pa.array([SAMPLES * len(o) for _, o in made], pa.int64()), pa.array([RATE] * len(made), pa.int32()), pa.array([o for _, o in made], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[x.split()[0] for x in _STORED.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, _STORED)


def probe(stored: DataFrame) -> DataFrame:
    """Reads stored media back: digests, exact duration (samples / rate), frame seek offsets and faults.

    A null or damaged stream gives what could be read, with its faults counted: bad
    checksums, skipped bytes, and stored durations or offsets that are not those of the
    stream (stored_as_read).
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, samples long, rate int, bad_checksums int, skipped_bytes long, frame_offsets array<long>, stored_as_read boolean, feature string"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                rows = []
                for doc, n, media, samples, rate, offsets in zip(*(c.to_pylist() for c in batch.slice(i, 500).columns)):
                    s = parse(media := media or b"")
                    seek = np.asarray(s.offsets, "<i8")
                    feature = f"mp3 frames={len(s.offsets)} samples={s.samples} rate={s.rate} seek={zlib.crc32(seek.tobytes()):08x} toc={zlib.crc32(s.toc or b''):08x} faults={s.bad_checksums + s.skipped}"
                    same = (samples, rate, offsets) == (s.samples, s.rate, s.offsets)
                    rows.append((doc, n, len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), s.samples, s.rate, s.bad_checksums, s.skipped, seek, same, feature))
                cols = list(zip(*rows)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")])

    return stored.select("doc_id", "n_bytes", "media", "samples", "rate", "frame_offsets").mapInArrow(run, schema)
