"""MPEG audio columns: payloads stored in the frames of an MPEG-1 Layer III stream, and any such stream read back.

A payload is cut into units of 192 bytes. Frames of 320 kbit/s hold four of them and frames of 80 kbit/s one, as ancillary
data behind an all-zero side information (a decoder plays silence), so the stream has a variable bitrate. An ID3v2 tag
holds the payload's checksum, and the first frame a Xing table of frames, bytes and seek points.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.llm.base import in_small_batches, texts_as_bytes, written

UNIT = 192
# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer), Hz by version bits, samples a frame.
KBITS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


class Frame(NamedTuple):
    """What a frame header says. side: bytes of side information; size: of the whole frame."""

    version: int
    layer: int
    protected: bool
    kbits: int
    hertz: int
    mono: bool
    samples: int
    side: int
    size: int


@lru_cache(4096)
def header(raw: bytes) -> Frame | None:
    """The frame that four bytes begin, None if they are no header."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hertz = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hertz == 3:
        return None
    one, mono, pad = version == 3, raw[3] >> 6 == 3, raw[2] >> 1 & 1
    kbits, hz = KBITS[one, layer][rate - 1], HERTZ[version][hertz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    slot = 4 if layer == 1 else 1
    size = (samples // 8 // slot * kbits * 1000 // hz + pad) * slot
    side = (17 if mono else 32) if one else (9 if mono else 17)
    return Frame({3: 1, 2: 2, 0: 25}[version], layer, not raw[1] & 1, kbits, hz, mono, samples, side if layer == 3 else 0, size)


@lru_cache(8192)
def crc16(raw: bytes) -> int:
    """The frame checksum: polynomial 0x8005, all ones at first."""
    c = 0xFFFF
    for byte in raw:
        c ^= byte << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
    return c


def _head(kbits: int, protected: bool) -> bytes:
    """Header, checksum and side information of a mono 48 kHz frame."""
    start = bytes([0xFF, 0xFA | (not protected), KBITS[True, 3].index(kbits) + 1 << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return start + (struct.pack(">H", crc16(start[2:] + side)) if protected else b"") + side


LARGE, SMALL, FIRST = _head(320, True), _head(80, True), _head(80, False)
REST = {4: bytes(960 - len(LARGE) - 4 * UNIT), 1: bytes(240 - len(SMALL) - UNIT)}


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def stored(payload: bytes) -> bytes:
    """The stream that holds a payload of whole units."""
    if len(payload) % UNIT or not payload:
        raise ValueError(f"a payload has a positive multiple of {UNIT} bytes")
    cut = len(payload) // (4 * UNIT) * 4 * UNIT
    frames = [LARGE + payload[i : i + 4 * UNIT] + REST[4] for i in range(0, cut, 4 * UNIT)]
    frames += [SMALL + payload[i : i + UNIT] + REST[1] for i in range(cut, len(payload), UNIT)]
    text = b"\x00crc32\x00%08x" % zlib.crc32(payload)
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    large, size = cut // (4 * UNIT), 240 + sum(map(len, frames))
    offsets = [240 + (960 * k if k <= large else 960 * large + 240 * (k - large)) for k in (len(frames) * p // 100 for p in range(100))]
    table = b"Xing" + struct.pack(">III", 7, len(frames), size) + bytes(min(255, 256 * o // size) for o in offsets)
    first = FIRST + table
    return b"ID3\x03\x00\x00" + _syncsafe(len(tag)) + tag + first + bytes(240 - len(first)) + b"".join(frames)


def tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """Where the audio begins and ends, and the text frames of an ID3v2.3 or 2.4 tag before it; an ID3v1 tag ends it."""
    start, end, found = 0, len(data), {}
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
        start, at = 10 + size + (10 if data[5] & 16 else 0), 10
        while at + 10 <= min(10 + size, end) and data[at]:
            n = sum((b & 127) << s for b, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True)) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8])
            name, body = data[at : at + 4].decode("latin-1"), data[at + 11 : at + 10 + n].decode("latin-1")
            key, _, value = body.partition("\x00") if name == "TXXX" else (name, "", body)
            found[key] = value
            at += 10 + n
    if end - start >= 128 and data[-128:-125] == b"TAG":
        found.setdefault("TIT2", data[-125:-95].rstrip(b"\x00 ").decode("latin-1"))
        end -= 128
    return min(start, end), end, found


def read(data: bytes) -> dict:
    """Payload and features of a stream.

    Bytes that begin no frame are passed over until a header is found whose successor is a header of the same version,
    layer and rate, or the stream's end; what a frame says is read within the frame; all frames of a stream agree in these. A Xing or Info frame counts neither as audio nor as payload."""
    start, end, found = tags(data)
    at, offsets, parts, samples, skipped, good, tested, rates, table, first = start, [], [], 0, 0, 0, 0, set(), None, None
    kind = lambda x: x and (x.version, x.layer, x.hertz)
    stream, lost = None, True  # the kind of its frames; whether the place of the next one isn't known
    while at + 4 <= end:
        f = header(data[at : at + 4])
        ok = f is not None and at + f.size <= end and stream in (None, kind(f))
        if ok and lost:
            ok = at + f.size + 4 > end or kind(header(data[at + f.size : at + f.size + 4])) == kind(f)
        if not ok:
            at, skipped, lost = at + 1, skipped + 1, True
            continue
        stream, lost = kind(f), False
        body = at + 4 + 2 * f.protected + f.side
        if f.layer == 3 and not offsets and table is None and data[body : body + 4] in (b"Xing", b"Info") and body + 8 <= at + f.size:
            flags, rest, close = struct.unpack(">I", data[body + 4 : body + 8])[0], body + 8, at + f.size
            table = {"kind": data[body : body + 4].decode()}
            for bit, key in ((1, "frames"), (2, "bytes")):
                if flags & bit and rest + 4 <= close:
                    table[key], rest = struct.unpack(">I", data[rest : rest + 4])[0], rest + 4
            if flags & 4 and rest + 100 <= close:
                table["points"] = list(data[rest : rest + 100])
        else:
            if f.protected and f.layer == 3:
                tested += 1
                good += int.from_bytes(data[at + 4 : at + 6]) == crc16(data[at + 2 : at + 4] + data[at + 6 : body])
            offsets.append(at)
            room = at + f.size - body
            parts.append(data[body : body + room // UNIT * UNIT])
            samples += f.samples
            rates.add(f.kbits)
            first = first or f
        at += f.size
    payload = b"".join(parts)
    return {
        "payload": payload, "sample_rate": first.hertz if first else 0, "samples": samples, "duration": samples / first.hertz if first else 0.0,
        "frames": len(offsets), "variable": len(rates) > 1, "checksums": tested, "checksums_good": good, "skipped": skipped + max(0, end - at),
        "payload_good": found.get("crc32") == f"{zlib.crc32(payload):08x}", "table_good": bool(table) and table.get("frames") == len(offsets), "offsets": offsets,
    }


MEDIA = "doc_id long, n_bytes long, media binary"
FEATURES = {
    "payload": pa.binary(), "sample_rate": pa.int32(), "samples": pa.int64(), "duration": pa.float64(), "frames": pa.int64(), "variable": pa.bool_(), "checksums": pa.int64(),
    "checksums_good": pa.int64(), "skipped": pa.int64(), "payload_good": pa.bool_(), "table_good": pa.bool_(), "offsets": pa.list_(pa.int64()),
}


def media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each whole text in UTF-8, with spaces up to a positive multiple of 192 bytes, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                raw = [t or b"" for t in texts_as_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([stored(t.ljust(max(1, -(-len(t) // UNIT)) * UNIT)) for t in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MEDIA)


def read_media(streams: DataFrame) -> DataFrame:
    """streams without its binary column media, with media_bytes, media_sha256 and what `read` finds. Null: an empty stream."""
    keys = [c for c in streams.columns if c != "media"]
    rows = streams.select(F.coalesce("media", F.lit(b"")).alias("media"), *keys, F.coalesce(F.length("media"), F.lit(0)).cast("long").alias("media_bytes"), F.sha2(F.coalesce("media", F.lit(b"")), 256).alias("media_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 500):
                batch = whole.slice(k, 500)
                found = [read(m) for m in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays(batch.columns[1:] + [pa.array([f[n] for f in found], kind) for n, kind in FEATURES.items()], names=[*batch.schema.names[1:], *FEATURES])

    more = "payload binary, sample_rate int, samples long, duration double, frames long, variable boolean, checksums long, checksums_good long, skipped long, payload_good boolean, table_good boolean, offsets array<long>"
    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:]) + ", " + more)


def text_media(docs: DataFrame) -> DataFrame:
    """Whole texts stored as MPEG audio in the shared folder, and everything read back from there.

    A null or empty text is 192 spaces. Equal texts have equal media. A null doc_id stays null, repeated rows are stored
    each, an empty table gives an empty one, other columns are not looked at."""
    return read_media(written(media(docs), "media", compression="zstd"))
