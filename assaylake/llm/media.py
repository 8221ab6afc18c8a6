"""Media columns: MPEG audio streams. A writer that carries any payload in silent frames, and a reader that
resynchronises on frame headers, parses tags and variable-bitrate tables, verifies checksums, and stores exact durations
and the frames' seek offsets."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import table, tune

#: Fixed by the format: kbit/s by (MPEG-1 or later, layer), sample rates by version, samples a frame.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
CRC_POLY = 0x8005


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """CRC-16 of the format: polynomial 8005, start FFFF, highest bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLY if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


def crc_bits(head: bytes, bits: str) -> int:
    """The checksum over the header's last two bytes and a run of bits, which need not end at a byte."""
    crc = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in head[2:4]) + bits:
        crc = (crc << 1 ^ (CRC_POLY if crc >> 15 ^ (bit == "1") else 0)) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    generation: int
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    bound: int = 32

    def protected_bits(self, body: bytes) -> str:
        """The bits after a layer I or II frame's checksum that it covers: the allocations, and in layer II the scale factor selections."""
        bits = "".join(f"{b:08b}" for b in body[:160])
        channels = 1 if self.mono else 2
        if self.layer == 1:
            return bits[: 4 * (channels * self.bound + 32 - self.bound)]
        runs = self._allocation_bits()
        at, used = 0, 0
        for band, n in enumerate(runs):
            shared = band >= self.bound or channels == 1
            for _ in range(1 if shared else 2):
                used += ("1" in bits[at : at + n]) * (channels if shared else 1)
                at += n
        return bits[: at + 2 * used]

    def _allocation_bits(self) -> list[int]:
        """Bits of each subband's allocation in layer II; fixed by the format."""
        if self.generation == 2:
            return [4] * 4 + [3] * 7 + [2] * 19
        each = self.bitrate // (1 if self.mono else 2)
        if each <= 48:
            return [4] * 2 + [3] * (10 if self.rate == 32000 else 6)
        return [4] * 11 + [3] * 12 + [2] * (4 if self.rate == 48000 or each <= 80 else 7)

    @property
    def side(self) -> int:
        """Bytes of side information (layer 3)."""
        return (17 if self.mono else 32) if self.generation == 1 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def header(four: bytes) -> Header | None:
    """The frame header in four bytes, or None where they are none (free bitrate is not supported)."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    bits, rate = four[2] >> 4, four[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    generation = 1 if version == 3 else 2
    kbit, hz, padding, samples = BITRATES[generation, layer][bits - 1], RATES[version][rate], four[2] >> 1 & 1, SAMPLES[generation, layer]
    size = (12000 * kbit // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbit // hz + padding
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 else 32
    return Header(generation, layer, not four[1] & 1, kbit, hz, four[3] >> 6 == 3, size, samples, bound)


@dataclass
class Stream:
    """What a stream holds: tags, the table of its first frame, and per audio frame its place and header."""

    tags: dict = field(default_factory=dict)
    table: dict | None = None
    seek: list = field(default_factory=list)
    headers: list = field(default_factory=list)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    payload: bytes = b""

    @property
    def duration(self) -> Fraction:
        return sum((Fraction(h.samples, h.rate) for h in self.headers), Fraction(0))

    def feature(self) -> str:
        rates = sorted({h.bitrate for h in self.headers})
        places = zlib.crc32(struct.pack(f"<{len(self.seek)}Q", *self.seek))
        return f"mp{self.headers[0].layer if self.headers else 0};frames={len(self.headers)};duration={self.duration};kbps={','.join(map(str, rates))};table={self.table['kind'] if self.table else None};crc={self.crc_ok}/{self.crc_bad};skipped={self.skipped};seek={places:08x}"


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def _unsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _tags(data: bytes) -> tuple[dict, int]:
    """ID3v2 text frames (versions 2.2 to 2.4, extended headers skipped) at the start, and where they end."""
    if data[:3] != b"ID3" or len(data) < 10:
        return {}, 0
    version, flags, end, at, out = data[3], data[5], 10 + _unsafe(data[6:10]), 10, {}
    if flags & 64 and version > 2:
        if len(data) < at + 4:
            return {}, end
        at += _unsafe(data[at : at + 4]) if version == 4 else 4 + int.from_bytes(data[at : at + 4], "big")
    letters, lead = (3, 6) if version == 2 else (4, 10)
    while at + lead <= min(end, len(data)) and data[at]:
        length = data[at + letters : at + (6 if version == 2 else 8)]
        size = _unsafe(length) if version == 4 else int.from_bytes(length, "big")
        name, body = data[at : at + letters].decode("latin-1"), data[at + lead + 1 : at + lead + size]
        text = body.decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[data[at + lead] & 3], "replace") if size and name[0] == "T" and at + lead < len(data) else ""
        if name in ("TXXX", "TXX"):
            key, _, text = text.partition("\0")
            name += ":" + key
        out[name] = text.rstrip("\0")
        at += lead + size
    return out, end + (10 if flags & 16 else 0)


def _vbr_table(frame: bytes, h: Header) -> dict | None:
    """A Xing, Info or VBRI table, which takes the place of a first frame's sound."""
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        out, flags, p = {"kind": frame[at : at + 4].decode()}, int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[p : p + 4], "big")
                p += 4
        return out | ({"toc": list(frame[p : p + 100])} if flags & 4 else {})
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, each = struct.unpack(">IIHHHH", frame[46:62])
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)], "frames_per_entry": each}
    return None


def read_stream(data: bytes) -> Stream:
    """Frame by frame. Bytes that start no frame are skipped to the next header that another one (or the end, or a tag) follows."""
    out = Stream()
    out.tags, at = _tags(data)
    parts, synced = [], False
    while at + 4 <= len(data):
        if data[at : at + 3] == b"TAG" and len(data) - at == 128:
            break
        h = header(data[at : at + 4])
        fits = h is not None and at + h.size <= len(data)
        if fits and not synced:
            after = at + h.size
            fits = after == len(data) or header(data[after : after + 4]) is not None or data[after : after + 3] == b"TAG"
        if not fits:
            synced, nxt = False, data.find(b"\xff", at + 1)
            nxt = len(data) if nxt < 0 else nxt
            out.skipped += nxt - at
            at = nxt
            continue
        frame, synced = data[at : at + h.size], True
        if not out.headers and out.table is None and h.layer == 3 and (vbr := _vbr_table(frame, h)):
            out.table = vbr
        else:
            out.seek.append(at)
            out.headers.append(h)
            body = 4
            if h.protected:
                body = 6
                found = crc16(frame[2:4] + frame[6 : 6 + h.side]) if h.layer == 3 else crc_bits(frame[:4], h.protected_bits(frame[6:]))
                good = found == int.from_bytes(frame[4:6], "big")
                out.crc_ok, out.crc_bad = out.crc_ok + good, out.crc_bad + (not good)
            parts.append(frame[body + h.side :] if h.layer == 3 else frame[body:])
        at += h.size
    out.payload = b"".join(parts)
    if re.fullmatch("[0-9]{1,18}", n := out.tags.get("TXXX:payload", "")):
        out.payload = out.payload[: int(n)]
    return out


_SIDE = bytes(17)


@lru_cache(maxsize=64)
def _silent(bits: int, padding: int) -> bytes:
    """Header, checksum and empty side information of a mono 44.1 kHz layer 3 frame; what follows them is ancillary data."""
    head = bytes([0xFF, 0xFA, bits << 4 | padding << 1, 0xC0])
    return head + crc16(head[2:] + _SIDE).to_bytes(2, "big") + _SIDE


def write_stream(payload: bytes) -> bytes:
    """A layer 3 stream that carries the payload in its frames' ancillary data: 320 kbit/s frames and a last one just large enough."""
    tag = b"TXXX" + _syncsafe(len(text := b"\x03payload\0%d" % len(payload))) + b"\0\0" + text
    out, room, at = [], [header(_silent(b, 0)[:4]).size - 23 for b in range(1, 15)], 0
    while at < len(payload):
        rest = len(payload) - at
        bits = next((b for b in range(1, 15) if room[b - 1] >= rest), 14)
        piece = payload[at : at + room[bits - 1]]
        out.append(_silent(bits, 0) + piece.ljust(room[bits - 1], b"\0"))
        at += len(piece)
    ends, total = [], 0
    for f in out:
        ends.append(total)
        total += len(f)
    lead = header(_silent(4, 0)[:4]).size
    toc = bytes(min(255, (lead + ends[i * len(out) // 100]) * 256 // (lead + total)) for i in range(100)) if out else bytes(100)
    xing = b"Xing" + struct.pack(">III", 7, len(out), lead + total) + toc
    return b"ID3\x04\0\0" + _syncsafe(len(tag)) + tag + (_silent(4, 0) + xing).ljust(lead, b"\0") + b"".join(out)


def padded(text: str | None, unit: int = 64) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes with zeros up to a positive multiple of ``unit``."""
    data = (text or "").encode()
    return len(data), data.ljust(max(1, -(-len(data) // unit)) * unit, b"\0")


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            both = [padded(t) for t in pc.fill_null(part.column(1), "").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in both], pa.int64()), pa.array([write_stream(p) for _, p in both], pa.binary())], names=["doc_id", "n_bytes", "media"])


READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_num long, duration_den long, seek_offsets array<long>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    for batch in batches:
        out = []
        for media in batch.column(2).to_pylist():
            s = read_stream(media or b"")
            out.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-64:]), len(media or b""), hashlib.sha256(media or b"").hexdigest(), s.feature(), s.duration.numerator, s.duration.denominator, s.seek))
        names = [x.split()[0] for x in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=names)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as an MPEG audio stream. A null text is empty (64 zero bytes); rows are independent."""
    tune(docs.sparkSession)
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(_write, "doc_id long, n_bytes long, media binary")


def read_media(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> the payload's and the stream's figures. Broken streams give what their whole frames hold; a null one has no frame."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, READ)


def op8_media(spark, sf_dir: str) -> DataFrame:
    """Every document's padded bytes written as an MPEG stream and read back from it."""
    return read_media(write_media(table(spark, sf_dir, "documents")))
