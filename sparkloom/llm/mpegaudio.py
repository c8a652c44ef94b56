"""Media columns: MPEG audio files.

Writing stores any bytes without loss as an MPEG-1 Layer III file: an ID3v2 tag with the payload's length, a frame with a
variable-bitrate table (frame and byte counts, seek table), and silent frames with a CRC whose ancillary bytes hold the
payload. The last frame takes the smallest bitrate that fits.

Reading takes any MPEG audio stream (versions 1, 2, 2.5; layers I to III). It parses ID3v2, ID3v1 and APEv2 tags; finds frame
headers, and after damage looks for the next header that agrees with the stream and is followed by another one or the end;
parses Xing/Info (with encoder delay and padding) and VBRI tables; verifies the frames' CRC in all three layers; and gives the
exact duration in samples and the offset of every frame.

Defined results: a null text is an empty payload, which is 64 zero bytes. Bytes that hold no frame, and null media, give no
frames, duration 0 and an empty offset list; a table that its frame cuts short is none. Media that don't hold a whole payload of
this module's have null payload columns. No bytes raise. Rows stay rows, whatever their ids; equal texts give equal values;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import load, map_arrow, utf8

# ---------------------------------------------------------------- fixed values of ISO/IEC 11172-3 and 13818-3

#: kbit/s by bitrate index 1 to 14.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Hz by version (1, 2, 2.5) and sampling index 0 to 2.
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSIONS, LAYERS = {0: 25, 2: 2, 3: 1}, {1: 3, 2: 2, 3: 1}
CRC_POLYNOMIAL = 0x8005
#: Layer II: (subbands, bits of their allocations) of the tables for many bits at 48 kHz or a middle rate, many bits, few bits, few bits at 32 kHz, and versions 2 and 2.5.
ALLOCATIONS = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "lsf": ((4, 4), (7, 3), (19, 2))}


def _crc_table() -> list[int]:
    out = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ (CRC_POLYNOMIAL if crc & 0x8000 else 0)
        out.append(crc & 0xFFFF)
    return out


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    crc = 0xFFFF
    for byte in data:
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[crc >> 8 ^ byte]
    return crc


def crc16_bits(data: bytes, bits: int) -> int:
    """The CRC of the first bits of the data."""
    crc = crc16(data[: bits // 8])
    for k in range(bits // 8 * 8, bits):
        bit = data[k // 8] >> (7 - k % 8) & 1
        crc = (crc << 1 & 0xFFFF) ^ (CRC_POLYNOMIAL if (crc >> 15) ^ bit else 0)
    return crc


def allocation_widths(h: Header) -> list[int]:
    """Bits of each subband's allocation in Layer II."""
    each = h.kbps // h.channels
    table = "lsf" if h.version != 1 else ("d" if h.rate == 32000 else "c") if each <= 48 else "a" if h.rate == 48000 or each <= 80 else "b"
    return [width for bands, width in ALLOCATIONS[table] for _ in range(bands)]


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2 or 25 for 2.5
    layer: int
    crc: bool
    kbps: int
    rate: int
    padding: int
    mode: int  # 3: one channel
    extension: int
    raw: bytes

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 1152 if self.layer == 2 or self.version == 1 else 576

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        one = self.mode == 3
        return (17 if one else 32) if self.version == 1 else (9 if one else 17)

    @property
    def channels(self) -> int:
        return 1 if self.mode == 3 else 2

    def covered(self, data: bytes) -> int:
        """Bits after the CRC that it covers; data is what follows it."""
        if self.layer == 3:
            return 8 * self.side
        bound = 4 * (self.extension + 1) if self.mode == 1 else 32
        if self.layer == 1:
            return 4 * (min(bound, 32) * self.channels + 32 - min(bound, 32))
        # Layer II: the allocations, of a width for each subband, and two bits for each that isn't zero, in each channel
        widths = allocation_widths(self)
        bits, at, chosen = int.from_bytes(data, "big"), 0, 0
        for band, width in enumerate(widths):
            own = self.channels if band < bound else 1
            for _ in range(own):
                value = bits >> max(0, 8 * len(data) - at - width) & ((1 << width) - 1)
                at += width
                chosen += (value > 0) * (self.channels // own)
        return at + 2 * chosen

    def agrees(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(4096)
def parse_header(raw: bytes) -> Header | None:
    """A header's fields, or nothing if its four bytes are no valid header of known size."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(raw[1] >> 3 & 3), LAYERS.get(raw[1] >> 1 & 3)
    index, rate = raw[2] >> 4, raw[2] >> 2 & 3
    if not version or not layer or index in (0, 15) or rate == 3 or raw[3] & 3 == 2:
        return None
    return Header(version, layer, not raw[1] & 1, BITRATES[min(version, 2), layer][index - 1], RATES[version][rate], raw[2] >> 1 & 1, raw[3] >> 6, raw[3] >> 4 & 3, raw)


# ---------------------------------------------------------------- writing

#: 32 kHz: frame sizes are whole numbers of bytes, so none is padded.
_RATE_INDEX, _RATE, _SIDE = 2, 32000, bytes(17)
_SIZES = [144_000 * kbps // _RATE for kbps in BITRATES[1, 3]]
#: A frame's bytes besides payload: header, CRC, side information and the payload's length in the frame.
_BESIDES = 4 + 2 + len(_SIDE) + 2
_OWNER = b"payload-bytes"


@lru_cache(64)
def _frame_start(index: int) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | _RATE_INDEX << 2, 0xC0))
    return head + struct.pack(">H", crc16(head[2:] + _SIDE)) + _SIDE


def _syncsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _unsafe(raw: bytes) -> int:
    return (raw[0] & 0x7F) << 21 | (raw[1] & 0x7F) << 14 | (raw[2] & 0x7F) << 7 | raw[3] & 0x7F


def encode(payload: bytes) -> bytes:
    """An MPEG audio file that holds the payload."""
    most, frames, k = _SIZES[-1] - _BESIDES, [], 0
    full = _frame_start(14) + struct.pack(">H", most)
    for k in range(0, len(payload) - most, most):
        frames.append(full + payload[k : k + most])
    rest = payload[len(frames) * most :]
    index = next(i for i, size in enumerate(_SIZES, 1) if size - _BESIDES >= len(rest))
    frames.append((_frame_start(index) + struct.pack(">H", len(rest)) + rest).ljust(_SIZES[index - 1], b"\0"))
    ends = sum(map(len, frames))
    table = bytes(min(255, 256 * min(p * len(frames) // 100 * _SIZES[-1], ends) // max(1, ends)) for p in range(100))
    size = _SIZES[4]
    xing = bytes((0xFF, 0xFB, 5 << 4 | _RATE_INDEX << 2, 0xC0)) + _SIDE + b"Xing" + struct.pack(">III", 7, len(frames), ends + size) + table
    private = _OWNER + b"\0" + struct.pack(">Q", len(payload))
    tag = b"PRIV" + struct.pack(">I", len(private)) + b"\0\0" + private
    return b"".join((b"ID3\3\0\0", _syncsafe(len(tag)), tag, xing.ljust(size, b"\0"), *frames))


# ---------------------------------------------------------------- reading


@dataclass
class Audio:
    tags: dict[str, bytes] = field(default_factory=dict)
    header: Header | None = None
    offsets: array = field(default_factory=lambda: array("Q"))
    samples: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    skipped: int = 0
    kbps: set = field(default_factory=set)
    vbr: dict = field(default_factory=dict)
    data: list = field(default_factory=list)

    @property
    def seconds(self) -> float:
        return self.samples / self.header.rate if self.header else 0.0

    def payload(self) -> bytes:
        """What encode() stored; ValueError if it isn't here whole."""
        size = self.tags.get("PRIV:" + _OWNER.decode())
        own = b"".join(x[2 : 2 + int.from_bytes(x[:2], "big")] for x in self.data)
        if size is None or len(own) != int.from_bytes(size, "big"):
            raise ValueError(f"{len(own)} payload bytes; the tag says {size!r}")
        return own


def _id3v2(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Parses a tag that begins at ``at``; its end."""
    major, flags, size = data[at + 3], data[at + 5], _unsafe(data[at + 6 : at + 10])
    end = at + 10 + size
    body = data[at + 10 : end]
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    k = 0
    if flags & 0x40 and len(body) >= 4:
        k = _unsafe(body[:4]) if major == 4 else 4 + struct.unpack(">I", body[:4])[0]
    ident, head = (3, 6) if major == 2 else (4, 10)
    while k + head <= len(body) and body[k]:
        name = body[k : k + ident].decode("latin-1")
        raw = body[k + ident : k + 2 * ident]
        n = int.from_bytes(raw, "big") if major < 4 else _unsafe(raw)
        value = body[k + head : k + head + n]
        if name == "PRIV":
            owner, _, value = value.partition(b"\0")
            name += ":" + owner.decode("latin-1")
        tags[name] = value
        k += head + n
    return end + (10 if flags & 0x10 else 0)


def _vbr(frame: bytes, h: Header) -> dict:
    """The variable-bitrate table of a frame, if it has a whole one."""
    at = 4 + 2 * h.crc + h.side
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        found: dict = {"kind": frame[at : at + 4].decode()}
        flags, k = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8
        if k + 4 * (flags & 1) + 2 * (flags & 2) + 25 * (flags & 4) + (flags & 8) // 2 > len(frame):
            return {}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name] = int.from_bytes(frame[k : k + 4], "big")
                k += 4
        if flags & 4:
            found["toc"] = frame[k : k + 100]
            k += 100
        k += 4 * bool(flags & 8)
        if frame[k : k + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= k + 24:
            both = int.from_bytes(frame[k + 21 : k + 24], "big")
            found |= {"delay": both >> 12, "padding": both & 0xFFF}
        return found
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack_from(">II", frame, 46)
        return {"kind": "VBRI", "frames": frames, "bytes": size}
    return {}


def decode(data: bytes) -> Audio:
    out = Audio()
    at, end = 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _id3v2(data, at, out.tags)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags["TAG"] = data[end : end + 128]
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, _, flags = struct.unpack_from("<III", data, end - 20)
        end = max(at, end - size - (32 if flags & 1 << 31 else 0))
        out.tags["APE"] = data[end:]
    lost = True
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        if h and out.header and not h.agrees(out.header):
            h = None
        if h and lost:  # in step again only if another header, or the end, is where this one says
            after = at + h.size
            follows = parse_header(data[after : after + 4]) if after + 4 <= end else None
            if not (after == end or follows and follows.agrees(h)):
                h = None
        if not h or at + h.size > end:
            step = data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped += step - at
            at, lost = step, True
            continue
        frame = data[at : at + h.size]
        lost = False
        if out.header is None:
            out.header = h
            if h.layer == 3 and (table := _vbr(frame, h)):
                out.vbr = table
                at += h.size
                continue
        if h.crc:
            bits = h.covered(frame[6:46])
            checked = h.raw[2:] + frame[6 : 6 + -(-bits // 8)]
            if 8 * len(checked) >= 16 + bits and crc16_bits(checked, 16 + bits) == int.from_bytes(frame[4:6], "big"):
                out.crc_good += 1
            else:
                out.crc_bad += 1
        out.offsets.append(at)
        out.kbps.add(h.kbps)
        out.samples += h.samples
        if h.layer == 3:
            out.data.append(frame[4 + 2 * h.crc + h.side :])
        at += h.size
    out.skipped += max(0, end - at)
    out.samples = max(0, out.samples - out.vbr.get("delay", 0) - out.vbr.get("padding", 0))
    return out


def feature(audio: Audio) -> str:
    """Version, layer, duration, checks and seek offsets (as a CRC of the 64-bit offsets) in one line."""
    h = audio.header
    if h is None:
        return f"frames=0;skipped={audio.skipped}"
    rates = "-".join(map(str, sorted({min(audio.kbps, default=0), max(audio.kbps, default=0)})))
    return (
        f"mpeg={h.version};layer={h.layer};rate={h.rate};frames={len(audio.offsets)};samples={audio.samples};seconds={audio.seconds:.6f};kbps={rates};vbr={audio.vbr.get('kind', 'none')}:{audio.vbr.get('frames', 0)}"
        f";crc={audio.crc_good}/{audio.crc_bad};skipped={audio.skipped};first={audio.offsets[0] if audio.offsets else -1};offsets_crc32={zlib.crc32(audio.offsets.tobytes()):08x}"
    )


# ---------------------------------------------------------------- columns


def padded(text: str | None) -> bytes:
    data = utf8(text)
    return data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes of the text, and its padded bytes as an MPEG audio file in column media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                own = batch.slice(k, 1000)
                texts = own.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array([len(utf8(x)) for x in texts], pa.int64()), pa.array([encode(padded(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, media binary")


FACTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration_samples", pa.int64()), ("sample_rate", pa.int32()), ("seek_offsets", pa.list_(pa.int64()))])


def facts(media: DataFrame) -> DataFrame:
    """What a table of stored media holds, read back from the stored bytes; payload columns are null where there is no whole payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                audio = decode(data or b"")
                try:
                    payload = audio.payload()
                    own = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
                except ValueError:
                    own = (None, None, None)
                stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
                rows.append((doc_id, n, *own, *stored, feature(audio), audio.samples, audio.header.rate if audio.header else None, audio.offsets.tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FACTS)], schema=FACTS)

    return map_arrow(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, seek_offsets array<bigint>")


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(store(load(spark, sf_dir, "documents")))


QUERIES = {"op1_mpeg_audio": op1_mpeg_audio}
ORACLE_SQL: dict[str, str] = {}
