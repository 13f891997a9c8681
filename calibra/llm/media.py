"""Media columns of MPEG audio: writing a payload losslessly into frames, and reading any stream of frames.

A payload is cut into units of 192 bytes. Each goes into the ancillary bytes of one frame (MPEG-1 Layer III,
48 kHz, 80 kbit/s, mono, with a checksum) whose side information declares no audio, so a player hears silence.
In front stand an ID3v2 tag with the unpadded length and an "Info" frame with counts and a seek table.
The reader takes any MPEG-1/2/2.5 stream: it skips tags, resynchronises on headers that a second header follows,
verifies checksums, parses the seek tables of variable bit rates, and reports exact durations and offsets. Frames come
first: an ID3v1 tag is only what follows the last one, so no payload is taken for a tag. Null and empty texts are stored as
one unit of spaces; repeated rows, and rows without doc_id, each give a row; equal texts give equal values; very long texts
are stored whole; an empty table gives no rows; columns besides the key and the text are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibra.llm.common import pieces

UNIT, FRAME, BODY = 192, 240, 23
SEEK_EVERY = 64
# Fixed values of the MPEG audio header: kbit/s by index.
RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
# Hz by version and index.
SAMPLING = {1: [44100, 48000, 32000], 2: [22050, 24000, 16000], 2.5: [11025, 12000, 8000]}


@dataclass
class Header:
    version: float
    layer: int
    crc: bool
    kbps: int
    hz: int
    padding: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """What a header says; None if these four bytes are none (a free bit rate counts as none)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(four[1] >> 3 & 3)
    layer = 4 - (four[1] >> 1 & 3)
    rate, hz = four[2] >> 4, four[2] >> 2 & 3
    if version is None or layer == 4 or rate in (0, 15) or hz == 3 or four[3] & 3 == 2:
        return None
    kbps, hz, pad = RATES[1 if version == 1 else 2, layer][rate], SAMPLING[version][hz], four[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + pad
    return Header(version, layer, not four[1] & 1, kbps, hz, pad, four[3] >> 6 == 3, size, samples)


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, t << 1 ^ 0x8005, t << 1) & 0xFFFF
    return t


def crc16(rows: np.ndarray) -> np.ndarray:
    """The frames' checksum of each row of bytes (polynomial 0x8005, from 0xFFFF)."""
    table, c = _crc_table(), np.full(len(rows), 0xFFFF, np.uint32)
    for k in range(rows.shape[1]):
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ rows[:, k]]
    return c


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


HEAD = bytes([0xFF, 0xFA, 0x64, 0xC0])  # MPEG-1, Layer III, checksum, 80 kbit/s, 48 kHz, mono


def padded(raw: bytes) -> bytes:
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def stream(raw: bytes) -> bytes:
    """The stored form of some bytes."""
    payload = np.frombuffer(padded(raw), np.uint8).reshape(-1, UNIT)
    frames = np.zeros((len(payload) + 1, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEAD, np.uint8)
    frames[:, 4:6] = np.frombuffer(struct.pack(">H", int(crc16(np.concatenate([frames[:1, 2:4], frames[:1, 6:BODY]], axis=1))[0])), np.uint8)
    frames[1:, BODY : BODY + UNIT] = payload
    toc = bytes(min(255, 256 * (1 + len(payload) * p // 100) // (len(payload) + 1)) for p in range(100))
    info = b"Info" + struct.pack(">III", 7, len(payload), frames.size) + toc
    frames[0, BODY : BODY + len(info)] = np.frombuffer(info, np.uint8)
    text = b"\x03payload_bytes\x00" + str(len(raw)).encode()
    tag = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag + frames.tobytes()


@dataclass
class Audio:
    """What a stream holds. offsets: of each audio frame; duration: seconds; bad: frames whose checksum differs; skipped: bytes
    that are in no frame or tag; seek: the byte offsets of the seek table, which lie evenly in time."""

    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, int] = field(default_factory=dict)
    seek: list[int] = field(default_factory=list)
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    duration: Fraction = Fraction(0)
    checked: int = 0
    bad: int = 0
    skipped: int = 0


def _size(four: bytes) -> int:
    return sum((x & 127) << s for x, s in zip(four, (21, 14, 7, 0)))


def _tags(b: bytes) -> tuple[dict[str, str], int]:
    if b[:3] != b"ID3" or len(b) < 10:
        return {}, 0
    size = _size(b[6:10])
    tags, at, end = {}, 10, min(len(b), 10 + size)
    while at + 10 <= end and b[at]:
        name, n = b[at : at + 4].decode("latin-1"), _size(b[at + 4 : at + 8]) if b[3] >= 4 else int.from_bytes(b[at + 4 : at + 8], "big")
        body = b[at + 10 : at + 10 + n]
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value.rstrip("\0")
        at += 10 + n
    return tags, 10 + size


def _vbr(b: bytes, at: int, h: Header) -> tuple[dict[str, int], list[int]]:
    """What the frame at `at` says of the whole stream, if it holds a table, and the table's byte offsets."""
    number = lambda x, n: int.from_bytes(b[x : x + n], "big")
    x = at + 4 + 2 * h.crc + h.side
    if h.layer == 3 and b[x : x + 4] in (b"Xing", b"Info"):
        flags, out, seek, x = number(x + 4, 4), {"table": 1}, [], x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = number(x, 4)
                x += 4
        if flags & 4:
            seek = [at + p * out.get("bytes", len(b) - at) // 256 for p in b[x : x + 100]]
            x += 100
        if flags & 8:
            out["quality"] = number(x, 4)
        return out, seek
    if b[at + 36 : at + 40] == b"VBRI":
        entries, scale, width, seek = number(at + 54, 2), number(at + 56, 2), number(at + 58, 2), [at]
        for k in range(entries):
            seek.append(seek[-1] + scale * number(at + 62 + k * width, width))
        return {"table": 1, "bytes": number(at + 46, 4), "frames": number(at + 50, 4), "quality": number(at + 44, 2)}, seek
    return {}, []


def _last_tag(b: bytes, at: int) -> dict[str, str] | None:
    """The ID3v1 tag that the stream ends with, if it begins at `at`."""
    if at != len(b) - 128 or b[at : at + 3] != b"TAG":
        return None
    cells = {"TIT2": b[at + 3 : at + 33], "TPE1": b[at + 33 : at + 63], "TALB": b[at + 63 : at + 93], "TYER": b[at + 93 : at + 97]}
    return {k: v.split(b"\0")[0].decode("latin-1").strip() for k, v in cells.items()}


def parse(b: bytes) -> Audio:
    """Reads a stream whole. Bytes that are no frames are skipped; a frame counts if it is whole and follows a frame, or a header,
    the last tag or the end follows it, or it is the first and holds a seek table."""
    out = Audio()
    out.tags, at = _tags(b)
    end, view, offsets, sizes, samples, first, follows = len(b), np.frombuffer(b, np.uint8), [], [], Fraction(0), True, -1
    while at + 4 <= end:
        h = header(bytes(b[at : at + 4]))
        if not h or at + h.size > end or not (at == follows or at + h.size == end or header(bytes(b[at + h.size : at + h.size + 4])) or _last_tag(b, at + h.size) or first and _vbr(b, at, h)[0]):
            if (tag := _last_tag(b, at)) is not None:
                out.tags |= {k: v for k, v in tag.items() if v and k not in out.tags}
                break
            at += 1
            out.skipped += 1
            continue
        if first:
            out.vbr, out.seek = _vbr(b, at, h)
            first = False
            if out.vbr:
                at += h.size
                follows = at
                continue
        n = (end - at) // h.size  # as many frames with this very header as follow each other
        rows = view[at : at + n * h.size].reshape(n, h.size)
        same = (rows[:, :4] == rows[0, :4]).all(axis=1)
        n = n if same.all() else int(same.argmin())
        rows = rows[:n]
        offsets.append(at + h.size * np.arange(n, dtype=np.int64))
        sizes.append(np.full(n, h.size, np.int64))
        samples += Fraction(n * h.samples, h.hz)
        if h.crc and h.layer == 3:
            over = np.concatenate([rows[:, 2:4], rows[:, 6 : 6 + h.side]], axis=1)
            out.checked += n
            out.bad += int((crc16(over) != rows[:, 4].astype(np.uint32) << 8 | rows[:, 5]).sum())
        at += n * h.size
        follows = at
    out.duration = samples
    if offsets:
        out.offsets, out.sizes = np.concatenate(offsets), np.concatenate(sizes)
    return out


def payload(b: bytes, a: Audio) -> bytes:
    """The bytes that `stream` put into its frames, wherever these lie. Frames of another size hold none."""
    at = a.offsets[a.sizes == FRAME] if len(a.offsets) else a.offsets
    view = np.frombuffer(b, np.uint8)
    if len(at) and at[-1] - at[0] == FRAME * (len(at) - 1):
        return view[at[0] : at[0] + FRAME * len(at)].reshape(-1, FRAME)[:, BODY : BODY + UNIT].tobytes()
    return view[at[:, None] + np.arange(BODY, BODY + UNIT)].tobytes() if len(at) else b""


def write(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media): every text, whole, as MPEG audio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                raw = (x.as_py() or b"" for x in part.column("text").cast(pa.large_binary()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(stream, raw), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Reads rows (doc_id, media) back: their payload's digests, exact duration, frame checks and seek offsets.

    duration: seconds as a fraction; duration_us: whole microseconds of it; bad_frames: frames whose checksum differs;
    seek_offsets: the byte where every SEEK_EVERY-th frame starts. A stream without frames has zero frames and an empty payload.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration string, duration_us long, bad_frames long, seek_offsets array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), batch.column("media")):
                b = cell.as_py() or b""
                a = parse(b)
                p = payload(b, a)
                n = int(a.tags.get("payload_bytes", len(p)))
                us = int(a.duration * 1_000_000)
                seek = a.offsets[::SEEK_EVERY].tolist()
                feature = f"mpeg frames={len(a.offsets)} listed={a.vbr.get('frames', -1)} checked={a.checked} bad={a.bad} skipped={a.skipped} table={len(a.seek)} us={us} seek={zlib.crc32(a.offsets.astype('<i8').tobytes())}"
                rows.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(b), hashlib.sha256(b).hexdigest(), feature, len(a.offsets), str(a.duration), us, a.bad, seek))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(names), kinds)], names)

    return media.select("doc_id", "media").mapInArrow(run, schema)
