"""Operator 3: MPEG audio columns.

``wrap`` stores a payload losslessly in a valid MPEG-1 Layer III stream (48 kHz, mono, CRC-protected): an ID3v2 tag
with the payload's length, a Xing frame with the frame count, byte count and seek table, then silent frames whose
ancillary part carries the payload, 320 kbit/s each with a shorter last one (variable bitrate), then an ID3v1 tag.
``parse`` reads any such bytes without knowing who wrote them: it skips tags, finds the first header that is
followed by another valid header, resynchronises after damage, checks each protected frame's CRC-16 in all three
layers, reads Xing/Info and VBRI tables with their byte counts, seek points and gapless trim, holds them against the frames
that are there, and gives the exact number of samples and each frame's offset for seeking.

Defined results: a null text is empty; the payload is padded with spaces to a positive multiple of 192 bytes; bytes
without a frame give 0 frames and no version; equal texts give equal values; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Workspace, binaries, table

UNIT = 192
# Fixed values of the MPEG audio format: kbit/s by [version is 1][layer][index], Hz by version bits and index.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
#: Layer II: widths of the bit allocations by subband, as (subbands, bits) runs, of the format's tables a, b, c, d and that of lower rates.
ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}

_crc_table = np.zeros(256, np.uint16)
for _i in range(256):
    _v = _i << 8
    for _ in range(8):
        _v = ((_v << 1) ^ 0x8005 if _v & 0x8000 else _v << 1) & 0xFFFF
    _crc_table[_i] = _v
_CRC = _crc_table.tolist()


def crc16(data: bytes, bits: int = 0) -> int:
    """The CRC of MPEG audio headers (polynomial 0x8005, from 0xFFFF) over data, of whose last byte only the first bits count if bits is given."""
    v = 0xFFFF
    for b in data[: len(data) - bool(bits)]:
        v = ((v << 8) & 0xFF00) ^ _CRC[(v >> 8) ^ b]
    for k in range(bits):
        v = (v << 1 & 0xFFFF) ^ (0x8005 if (v >> 15) ^ (data[-1] >> 7 - k & 1) else 0)
    return v


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbits: int
    hertz: int
    size: int
    samples: int
    mono: bool
    side: int
    joint: int = 32

    @property
    def allocations(self) -> tuple[int, ...]:
        """Layers I and II: the width of each subband's bit allocation."""
        if self.layer == 1:
            return (4,) * 32
        rate = self.kbits // (1 if self.mono else 2)
        if self.version != "1":
            name = "low"
        elif 56 <= rate <= 80 or rate >= 56 and self.hertz == 48000:
            name = "a"
        elif rate >= 96:
            name = "b"
        else:
            name = "d" if self.hertz == 32000 else "c"
        return tuple(width for n, width in ALLOCATIONS[name] for _ in range(n))


_headers: dict[int, Header | None] = {}


def header(word: int) -> Header | None:
    """The meaning of a frame's first four bytes, None if they are not a header (free format counts as none)."""
    if word not in _headers:
        if len(_headers) > 5000:
            _headers.clear()
        _headers[word] = _header(word)
    return _headers[word]


def _header(word: int) -> Header | None:
    version, layer, rate, hz = word >> 19 & 3, 4 - (word >> 17 & 3), word >> 12 & 15, word >> 10 & 3
    if word >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or word & 3 == 2:
        return None
    kbits, hertz, pad = KBITS[(1 if version == 3 else 2, layer)][rate], HERTZ[version][hz], word >> 9 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12000 * kbits // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + pad
    mono = word >> 6 & 3 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(VERSIONS[version], layer, not word >> 16 & 1, kbits, hertz, size, samples, mono, side if layer == 3 else 0, 4 * (word >> 4 & 3) + 4 if word >> 6 & 3 == 1 else 32)


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after a frame's CRC it covers: Layer III its side information, Layer I the bit allocations, Layer II those and
    the choices of scale factors, two bits for each channel of a subband whose allocation is not zero. Subbands from h.joint on share one allocation."""
    if h.layer == 3:
        return 8 * h.side
    channels = 1 if h.mono else 2
    widths = [(w, channels if k < h.joint else 1) for k, w in enumerate(h.allocations)]
    total = sum(w * n for w, n in widths)
    if h.layer == 1:
        return total
    value, left, chosen = int.from_bytes(body[: -(-total // 8)].ljust(-(-total // 8), b"\0"), "big"), 8 * -(-total // 8), 0
    for w, n in widths:
        for _ in range(n):
            left -= w
            chosen += (channels // n) * bool(value >> left & (1 << w) - 1)
    return total + 2 * chosen


def _word(kbits: int) -> int:
    return 0x7FF << 21 | 3 << 19 | 1 << 17 | KBITS[(1, 3)].index(kbits) << 12 | 1 << 10 | 3 << 6


def _frame_head(kbits: int) -> bytes:
    """Header, CRC and the empty side information of a silent mono frame."""
    word, side = _word(kbits).to_bytes(4, "big"), bytes(17)
    return word + crc16(word[2:] + side).to_bytes(2, "big") + side


_HEADS = {k: _frame_head(k) for k in KBITS[(1, 3)][1:]}
_ROOM = {k: 3 * k - len(_HEADS[k]) - 2 for k in _HEADS}
_FULL = 320


def padded(text: bytes) -> bytes:
    return text + b" " * (UNIT - len(text) if not text else -len(text) % UNIT)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def wrap(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    room, head = _ROOM[_FULL], _HEADS[_FULL]
    whole = len(payload) // room
    body = np.zeros((whole, 3 * _FULL), np.uint8)
    body[:, : len(head) + 2] = np.frombuffer(head + room.to_bytes(2, "big"), np.uint8)
    body[:, len(head) + 2 :] = np.frombuffer(payload, np.uint8, whole * room).reshape(whole, room)
    rest, parts = payload[whole * room :], [body.tobytes()]
    if rest:
        kbits = next(k for k in sorted(_ROOM) if _ROOM[k] >= len(rest))
        parts.append(_HEADS[kbits] + len(rest).to_bytes(2, "big") + rest + bytes(_ROOM[kbits] - len(rest)))
    audio = b"".join(parts)
    frames, size = whole + bool(rest) + 1, len(audio) + 3 * 80
    places = (240 + np.arange(100) * (frames - 1) // 100 * 3 * _FULL) * 256 // size
    toc = np.minimum(places, 255).astype(np.uint8).tobytes()
    xing = (_HEADS[80] + b"Xing" + struct.pack(">III", 7, frames - 1, size) + toc).ljust(240, b"\0")
    note = b"\0payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + _synchsafe(len(note)) + b"\0\0" + note
    tag = b"ID3\4\0\0" + _synchsafe(len(frame)) + frame
    return tag + xing + audio + (b"TAG" + b"payload".ljust(125, b"\0"))


@dataclass
class Audio:
    """What parse found. offsets: each audio frame's place; kbits: its bitrate; gaps: bytes skipped to resynchronise."""

    version: str = ""
    layer: int = 0
    hertz: int = 0
    offsets: list[int] = field(default_factory=list)
    kbits: list[int] = field(default_factory=list)
    samples: int = 0
    checked: int = 0
    bad_crc: int = 0
    gaps: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_at: int = 0
    table_frames: int = -1
    table_bytes: int = -1
    seeks: list[tuple[int, int]] = field(default_factory=list)
    trim: tuple[int, int] = (0, 0)
    largest: int = 0
    end: int = 0

    @property
    def played(self) -> int:
        """Samples without the encoder's delay and padding, where a table tells them."""
        return max(0, self.samples - sum(self.trim))

    @property
    def seconds(self) -> float:
        return self.played / self.hertz if self.hertz else 0.0

    @property
    def table_faults(self) -> list[str]:
        """What the table says that the frames do not: its counts of frames (without its own, or with it) and of bytes, and seek points that
        lie further from the frame they stand for than a table can round."""
        n, size = len(self.offsets), self.end - self.table_at
        out = ["frames"] if self.table_frames not in (-1, n, n + 1) else []
        out += ["bytes"] if self.table_bytes not in (-1, size) else []
        near = self.largest * (1 if self.table == "VBRI" else 2) + size // 256
        if any(abs(at - (self.offsets[k] if k < n else self.end)) > near for k, at in self.seeks):
            out.append("seek")
        return out


def _at(data: bytes, i: int) -> Header | None:
    return header(int.from_bytes(data[i : i + 4], "big")) if i + 4 <= len(data) else None


def _sync(data: bytes, i: int, end: int) -> int:
    """The next place of a header whose frame ends the stream or is followed by a header of the same kind."""
    while 0 <= (i := data.find(b"\xff", i, end)):
        if h := _at(data, i):
            n = _at(data, i + h.size) if i + h.size < end else h
            if i + h.size <= end and n and (n.version, n.layer, n.hertz) == (h.version, h.layer, h.hertz):
                return i
        i += 1
    return end


def parse(data: bytes) -> tuple[Audio, bytes]:
    """What the stream holds, and the ancillary payload of its frames."""
    out, i, end, payload = Audio(), 0, len(data), []
    while data[i : i + 3] == b"ID3" and i + 10 <= end:
        size = sum((b & 127) << s for b, s in zip(data[i + 6 : i + 10], (21, 14, 7, 0), strict=True))
        _id3(data[i + 10 : i + 10 + size], out.tags)
        i += 10 + size
    if data[-128:-125] == b"TAG" and end - i >= 128:
        end -= 128
        out.tags["title"] = data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    out.end = end
    crcs: dict[tuple[bytes, int], int] = {}
    first = True
    while i < end:
        h = _at(data, i)
        if not h or i + h.size > end:
            j = _sync(data, i + 1, end)
            out.gaps += j - i
            i = j
            continue
        if first:
            out.version, out.layer, out.hertz = h.version, h.layer, h.hertz
        start = i + 4 + 2 * h.protected
        if h.protected:
            bits = protected_bits(h, data[start : min(start + 64, i + h.size)])
            covered = data[i + 2 : i + 4] + data[start : start + -(-bits // 8)]
            if (covered, bits) not in crcs:
                if len(crcs) > 1000:
                    crcs.clear()
                crcs[covered, bits] = crc16(covered, bits % 8)
            out.checked += 1
            out.bad_crc += crcs[covered, bits] != int.from_bytes(data[i + 4 : i + 6], "big")
        if first and h.layer == 3 and _table(data[i : i + h.size], start - i + h.side, out):
            out.table_at, first = i, False
            i += h.size
            continue
        first = False
        out.largest = max(out.largest, h.size)
        out.offsets.append(i)
        out.kbits.append(h.kbits)
        out.samples += h.samples
        at = start + h.side
        payload.append(data[at + 2 : at + 2 + int.from_bytes(data[at : at + 2], "big")])
        i += h.size
    if out.table == "VBRI":
        out.seeks = [(k, out.table_at + at) for k, at in out.seeks]
    else:  # hundredths of the time, in 256ths of the bytes
        n, size = len(out.offsets), out.table_bytes if out.table_bytes > 0 else end - out.table_at
        out.seeks = [(k * n // 100, out.table_at + at * size // 256) for k, at in out.seeks]
    return out, b"".join(payload)


def _id3(body: bytes, tags: dict[str, str]) -> None:
    i = 0
    while i + 10 <= len(body) and body[i : i + 4].isalnum():
        size = sum((b & 127) << s for b, s in zip(body[i + 4 : i + 8], (21, 14, 7, 0), strict=True))
        key, value = body[i : i + 4].decode(), body[i + 11 : i + 10 + size].decode("latin-1").strip("\0")
        if key == "TXXX":
            key, _, value = value.partition("\0")
        tags[key] = value
        i += 10 + size


def _table(frame: bytes, at: int, out: Audio) -> bool:
    """Reads a Xing, Info or VBRI table, if the frame holds one."""
    number = lambda p, n: int.from_bytes(frame[p : p + n], "big")
    if (kind := frame[at : at + 4]) in (b"Xing", b"Info"):
        flags, p = number(at + 4, 4), at + 8
        if flags & 1:
            out.table_frames, p = number(p, 4), p + 4
        if flags & 2:
            out.table_bytes, p = number(p, 4), p + 4
        if flags & 4:
            out.seeks, p = list(enumerate(frame[p : p + 100])), p + 100
        p += 4 * bool(flags & 8)
        if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf"):
            out.trim = number(p + 21, 3) >> 12, number(p + 21, 3) & 0xFFF
    elif (kind := frame[36:40]) == b"VBRI":
        out.table_bytes, out.table_frames = number(46, 4), number(50, 4)
        entries, scale, width, step = (number(p, 2) for p in (54, 56, 58, 60))
        sizes = [scale * number(62 + k * width, width) for k in range(entries) if 62 + (k + 1) * width <= len(frame)]
        out.seeks = [(k * step, at) for k, at in enumerate(np.cumsum([len(frame), *sizes]).tolist())]
    else:
        return False
    out.table = kind.decode()
    return True


def feature(a: Audio) -> str:
    """What the columns of a stream say, in one line: the exact duration as samples/hertz, and the seek offsets' digest."""
    seek = zlib.crc32(np.array(a.offsets, "<u8").tobytes())
    rates = f"{min(a.kbits, default=0)}-{max(a.kbits, default=0)}"
    return f"mpeg{a.version} layer{a.layer} frames={len(a.offsets)} duration={a.played}/{a.hertz} kbits={rates} {a.table or 'no table'}={max(0, a.table_frames)}{''.join(f' wrong {x}' for x in a.table_faults)} crc={a.checked - a.bad_crc}/{a.checked} gaps={a.gaps} seek={seek:08x}"


AUDIO_SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "samples long, hertz integer, bad_crc integer, gaps long, table_bytes long, table_faults integer, seek_offsets array<bigint>"
)


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column: each text as an MPEG audio stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binaries(batch.column("__text"))
            for i in range(0, len(texts), 256):
                part = texts[i : i + 256]
                yield table(batch.slice(i, 256), ("__text",), n_bytes=pa.array(map(len, part), pa.int64()), media=pa.array(map(wrap, map(padded, part)), pa.binary()))

    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("media", "binary")
    return docs.select("doc_id", F.col("text").cast("binary").alias("__text")).mapInArrow(run, schema)


def read_media(media: DataFrame) -> DataFrame:
    """The columns of AUDIO_SCHEMA for each stored stream."""

    def row(data: bytes) -> tuple:
        a, payload = parse(data)
        return (
            len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(),
            feature(a), a.played, a.hertz, a.bad_crc, a.gaps, max(0, a.table_bytes), len(a.table_faults), a.offsets,
        )

    names = [x.split()[0] for x in AUDIO_SCHEMA.split(", ")][1:]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(row, binaries(batch.column("media"))), strict=True)) or [()] * len(names)
            yield table(batch, ("media",), **{n: pa.array(c, t) for n, c, t in zip(names, cols, types, strict=True)})

    schema = T.StructType(media.select("doc_id").schema.fields)
    for name, kind in (x.split() for x in AUDIO_SCHEMA.split(", ")):
        schema = schema.add(name, T.ArrayType(T.LongType()) if kind.startswith("array") else kind)
    return media.mapInArrow(run, schema)


def audio_columns(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Stores every text as a media column (Parquet in the shared folder), reads it back and parses it."""
    with Workspace(spark, "audio") as ws:
        return ws.keep(read_media(ws.stage(store_media(docs))))
