"""MPEG audio columns: write payloads as Layer III frames, and parse, verify and index such streams.

``encode`` packs bytes losslessly into MPEG-2 Layer III mono frames at 16 kHz: one frame holds 576
samples and carries 576 payload bytes in its main data, whose two-channel-free side information is all
zero, so a decoder plays silence and skips the bytes as ancillary data.  An ID3v2 tag and an ``Info``
table (frame count, byte count and a 100-entry seek table) come first.

``parse`` reads any byte string that holds MPEG audio: it skips ID3v2, APE and ID3v1 tags, finds the first
header that is confirmed by a second one, resynchronises after damage, verifies the CRC-16 of every protected frame of all three layers,
reads Xing, Info and VBRI tables with their seek entries, the encoder's delay and padding, and gives exact durations and the byte offset of every frame.

Defined results: null is stored as an empty payload; bytes without any confirmed frame give no frames, a duration
of 0 and the status ``empty``; a stream in which bytes had to be skipped has the status ``resynced``.
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

from .batches import slices

UNIT = 576
FILL = 255
# Fixed values of the MPEG audio format: kbit/s by (version 1 or not, layer) and index, Hz by version and index.
_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

# The stored frame: MPEG-2, Layer III, protected, 144 kbit/s, 16 kHz, mono.
_HEADER = bytes((0xFF, 0xF2, 0xD8, 0xC0))
_FRAME = 72 * 144_000 // 16_000
_SIDE = 9
_BODY = 4 + 2 + _SIDE


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ (0x8005 if c & 0x8000 else 0)
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


def crc16(data: bytes, start: int = 0xFFFF) -> int:
    """The frame checksum: polynomial 0x8005, initial value 0xFFFF, most significant bit first."""
    c = start
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def crc16_bits(data: bytes, bits: int, start: int = 0xFFFF) -> int:
    """The same over the first ``bits`` bits."""
    c = crc16(data[: bits // 8], start)
    for i in range(bits % 8):
        c = ((c << 1) & 0xFFFF) ^ (0x8005 if (c >> 15) ^ (data[bits // 8] >> (7 - i) & 1) else 0)
    return c


_PLAIN_CRC = crc16(_HEADER[2:] + bytes(_SIDE))


@dataclass(frozen=True)
class Header:
    """One frame header."""

    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    hz: int
    padding: int
    channels: int
    samples: int
    length: int
    bound: int  # from this subband on, both channels share one allocation


def header(word: bytes) -> Header | None:
    """The header in four bytes, or None where they hold none (free-format streams count as none)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = (word[1] >> 3) & 3, 4 - ((word[1] >> 1) & 3)
    rate, hz = word[2] >> 4, (word[2] >> 2) & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or word[3] & 3 == 2:
        return None
    bitrate, hz, padding = _RATES[version == 3, layer][rate] * 1000, _HZ[version][hz], (word[2] >> 1) & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    length = (12 * bitrate // hz + padding) * 4 if layer == 1 else samples // 8 * bitrate // hz + padding
    return Header(version, layer, not word[1] & 1, bitrate, hz, padding, 1 if word[3] >> 6 == 3 else 2, samples, length, ((word[3] >> 4 & 3) + 1) * 4 if word[3] >> 6 == 1 else 32)


def _side(h: Header) -> int:
    """Bytes of side information that a Layer III checksum covers."""
    if h.layer != 3:
        return 0
    return (17 if h.channels == 1 else 32) if h.version == 3 else (9 if h.channels == 1 else 17)


def _allocation(h: Header) -> tuple[int, ...]:
    """The width of each subband's bit allocation field in Layer I or II: fixed values of the format, by rate and frequency."""
    if h.layer == 1:
        return (4,) * 32
    if h.version != 3:
        return (4,) * 4 + (3,) * 7 + (2,) * 19
    each = h.bitrate // 1000 // h.channels
    if each <= 48:
        return (4,) * 2 + (3,) * (10 if h.hz == 32000 else 6)
    return (4,) * 11 + (3,) * 12 + (2,) * (4 if h.hz == 48000 or each <= 80 else 7)


def covered_bits(h: Header, body: bytes) -> int:
    """How many bits of ``body``, what follows the checksum, it covers besides the header's last two bytes."""
    if h.layer == 3:
        return 8 * _side(h)
    widths, at, used = _allocation(h), 0, 0
    whole, size = int.from_bytes(body[:64].ljust(64, b"\0"), "big"), 512
    for band, width in enumerate(widths):
        fields = h.channels if band < h.bound else 1
        for _ in range(fields):
            value = whole >> (size - at - width) & ((1 << width) - 1)
            used += bool(value) * (h.channels if fields < h.channels else 1)
            at += width
    return at + 2 * used * (h.layer == 2)  # Layer II: two bits of scale factor selection for each channel of a used subband


def _synchsafe(n: int) -> bytes:
    return bytes(((n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127))


def encode(payload: bytes, size: int) -> bytes:
    """A stream that holds ``payload``, a positive multiple of 576 bytes of which ``size`` are the content."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    n = len(payload) // UNIT
    frames = np.zeros((n + 1, _FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(_HEADER, np.uint8)
    frames[:, 4:6] = np.frombuffer(struct.pack(">H", _PLAIN_CRC), np.uint8)
    frames[1:, _BODY : _BODY + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    total = (n + 1) * _FRAME
    toc = bytes(min(255, ((i * n // 100 + 1) * _FRAME * 256) // total) for i in range(100))
    info = b"Info" + struct.pack(">III", 7, n, total) + toc
    frames[0, _BODY : _BODY + len(info)] = np.frombuffer(info, np.uint8)
    text = b"\x00" + f"payload\0{size}:{zlib.crc32(payload):08x}".encode()
    tag = b"TXXX" + _synchsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _synchsafe(len(tag)) + tag + frames.tobytes()


@dataclass
class Stream:
    """What ``parse`` found: tags, table, frames (header, offset) and how much had to be skipped."""

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    heads: list[Header] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    skipped: int = 0
    checked: int = 0
    bad: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.heads)

    @property
    def duration_us(self) -> int:
        """Exact: the sum of samples over rate, less the encoder's delay and padding where the table has them, in microseconds, rounded down."""
        by: dict[int, int] = {}
        for h in self.heads:
            by[h.hz] = by.get(h.hz, 0) + h.samples
        if self.heads:
            first = self.heads[0].hz
            by[first] = max(0, by[first] - self.table.get("delay", 0) - self.table.get("padding", 0))
        return sum(n * 1_000_000 // hz for hz, n in by.items())

    @property
    def status(self) -> str:
        return "empty" if not self.heads else "damaged" if self.bad else "resynced" if self.skipped else "ok"


def _id3(data: bytes, tags: dict[str, str]) -> int:
    """The length of an ID3v2 tag at the start; its text frames go to ``tags``."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 127:
        return 0
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    at, end, new = 10, min(len(data), 10 + size), data[3] >= 4
    while at + 10 <= end and data[at : at + 4].isalnum():
        name, raw = data[at : at + 4].decode(), data[at + 4 : at + 8]
        n = (raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]) if new else int.from_bytes(raw, "big")
        body = data[at + 10 : min(end, at + 10 + n)]
        if name[0] == "T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            parts = body[1:].decode(coding, "replace").rstrip("\0").split("\0")
            tags[f"{name}:{parts[0]}" if name == "TXXX" and len(parts) > 1 else name] = parts[-1]
        at += 10 + n
    return 10 + size


def _table(data: bytes, at: int, h: Header) -> dict[str, object]:
    """The variable-bitrate table in the frame at ``at``, if any."""
    start = at + 4 + 2 * h.protected + _side(h)
    for where in (start, at + 4 + _side(h)):
        if data[where : where + 4] in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(data[where + 4 : where + 8], "big"), where + 8, {"kind": data[where : where + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = data[p : p + 100]
                p += 100
            p += 4 * bool(flags & 8)
            if data[p : p + 4] in (b"LAME", b"Lavf", b"Lavc") and p + 24 <= at + h.length:
                gap = int.from_bytes(data[p + 21 : p + 24], "big")
                out |= {"delay": gap >> 12, "padding": gap & 0xFFF}
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        number = lambda a, n: int.from_bytes(data[at + a : at + a + n], "big")
        entries, scale, width, per = (number(a, 2) for a in (54, 56, 58, 60))
        out = {"kind": "VBRI", "bytes": number(46, 4), "frames": number(50, 4), "frames_per_entry": per}
        if width in (1, 2, 4) and 62 + entries * width <= h.length:
            out["seek"] = np.cumsum([number(62 + i * width, width) * scale for i in range(entries)]).tolist()
        return out
    return {}


def parse(data: bytes) -> Stream:
    """The stream in ``data``; see the module's text."""
    out = Stream()
    at, end = _id3(data, out.tags), len(data)
    if data[-128:-125] == b"TAG":
        end -= 128
        out.tags["ID3v1"] = data[-125:-95].split(b"\0")[0].decode("latin-1")
    if data[end - 32 : end - 24] == b"APETAGEX":
        end = max(at, end - 32 - int.from_bytes(data[end - 20 : end - 16], "little"))
    known: dict[bytes, Header | None] = {}
    synced, first = False, True
    while at + 4 <= end:
        word = data[at : at + 4]
        h = known[word] if word in known else known.setdefault(word, header(word))
        ok = h is not None and at + h.length <= end
        if ok and not synced:  # a lone header may be chance: the next frame has to start where this one ends, or the stream has to end there
            following = data[at + h.length : at + h.length + 4]
            other = header(following)
            ok = at + h.length == end or other is not None and (other.version, other.layer, other.hz) == (h.version, h.layer, h.hz)
        if not ok:
            found = data.find(b"\xff", at + 1, end)
            step = (found if found >= 0 else end) - at
            out.skipped += step
            at += step
            synced = False
            continue
        if h.protected:
            out.checked += 1
            stored = int.from_bytes(data[at + 4 : at + 6], "big")
            if word == _HEADER and not any(data[at + 6 : at + 6 + _SIDE]):
                expected = _PLAIN_CRC
            else:
                body = data[at + 6 : min(end, at + h.length)]
                expected = crc16_bits(word[2:] + body, 16 + min(8 * len(body), covered_bits(h, body)))
            out.bad += stored != expected
        synced = True
        if first:
            first = False
            out.table = _table(data, at, h)
            if out.table:
                at += h.length
                continue
        out.heads.append(h)
        out.offsets.append(at)
        at += h.length
    out.skipped += max(0, end - at)
    return out


def payload(data: bytes, stream: Stream) -> bytes:
    """The payload bytes that ``encode`` stored, from the frames' main data."""
    if not stream.offsets:
        return b""
    whole = np.frombuffer(data, np.uint8)
    at = np.asarray(stream.offsets)
    if len(at) > 1 and (np.diff(at) == _FRAME).all():
        block = whole[at[0] : at[0] + len(at) * _FRAME].reshape(-1, _FRAME)[:, _BODY : _BODY + UNIT]
        return block.tobytes()
    return b"".join(data[a + _BODY : a + _BODY + UNIT] for a in at.tolist())


def feature(stream: Stream) -> str:
    """A short, stable summary of a parsed stream."""
    rates = sorted({h.bitrate // 1000 for h in stream.heads})
    seek = zlib.crc32(np.asarray(stream.offsets, "<i8").tobytes())
    return f"{stream.status};frames={len(stream.heads)};us={stream.duration_us};hz={stream.heads[0].hz if stream.heads else 0};kbps={','.join(map(str, rates))};crc={stream.checked - stream.bad}/{stream.checked};table={stream.table.get('frames', '-')};seek={seek:08x}"


def padded(raw: bytes) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of 576."""
    return raw + bytes((FILL,)) * (-len(raw) % UNIT if raw else UNIT)


MEDIA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, seek_offsets array<long>"


def media_columns(documents: DataFrame, text: str = "text", key: str = "doc_id", media: bool = False, seek: bool = True) -> DataFrame:
    """Store every text as an MPEG audio stream, parse the stored bytes and describe them.

    One row per input row; equal texts give equal values; other columns of the input play no part.  ``media`` adds the
    stream itself, ``seek`` the byte offset of every frame.  Each text is handled on its own, so memory is bounded by the longest text.
    """
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {MEDIA}" + ", media binary" * media
    names = [x.split()[0] for x in MEDIA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for value in batch.column(1).to_pylist():
                raw = (value or "").encode()
                stored = encode(padded(raw), len(raw))
                stream = parse(stored)
                back = payload(stored, stream)
                row = (int(stream.tags["TXXX:payload"].split(":")[0]), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(stream), stream.duration_us, stream.offsets if seek else None)
                rows.append(row + (stored,) * media)
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * media
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[key, *names, *["media"] * media])

    return documents.select(key, text).mapInArrow(run, schema)
