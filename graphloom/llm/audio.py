"""Media columns, MPEG audio (operator 1).

A payload is stored as an MPEG-1 layer III stream: an ID3v2 tag, a Xing header frame, then mono
48 kHz frames that are silent (zero side information) and carry the payload in their ancillary
bytes, each with a checksum. The reader works on any MPEG audio: it finds frame headers again after
damage, reads ID3 tags and the Xing or VBRI table, verifies checksums of layer III alone, and gives exact durations
(samples over rate) and the byte offset of every frame.

Defined results: null text counts as empty (64 zero bytes); equal payloads give equal streams; null
or repeated doc_ids pass through; an empty table gives an empty one; bytes without any frame give
zero frames. Rows are worked on one at a time in Arrow batches, so memory follows one batch.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.frames import pick, read

# Fixed values of the MPEG audio header (ISO 11172-3, 13818-3): kbit/s by bitrate index 1 to 14.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Payload bytes in a full frame; 4 header, 2 checksum, 17 side information, 2 length.
CHUNK, OVERHEAD = 896, 25


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_TABLE = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _TABLE[(c >> 8) ^ b]
    return c


@lru_cache(maxsize=4096)
def frame_header(head: bytes) -> tuple[int, int, int, int, int, bool] | None:
    """4 bytes -> (frame length, samples, rate, side bytes, layer, has checksum), None if no header."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE0 != 0xE0:
        return None
    version, layer = (head[1] >> 3) & 3, 4 - ((head[1] >> 1) & 3)
    rate_at, kbps_at, pad = (head[2] >> 2) & 3, head[2] >> 4, (head[2] >> 1) & 1
    if version == 1 or layer == 4 or rate_at == 3 or kbps_at in (0, 15):
        return None
    kbps, rate = KBPS[1 if version == 3 else 2, layer][kbps_at - 1], RATES[version][rate_at]
    if layer == 1:
        length, samples = (12_000 * kbps // rate + pad) * 4, 384
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        length = samples // 8 * 1000 * kbps // rate + pad
    mono = head[3] >> 6 == 3
    side = 0 if layer != 3 else ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    return length, samples, rate, side, layer, not head[1] & 1


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


@lru_cache(maxsize=32)
def _frame_start(need: int) -> tuple[bytes, int]:
    """Header, checksum and zero side information of the smallest frame for so many payload bytes; its length."""
    at = next(i for i, k in enumerate(KBPS[1, 3], 1) if 3 * k >= need + OVERHEAD)
    head = bytes((0xFF, 0xFA, at << 4 | 1 << 2, 0xC0))
    return head + struct.pack(">H", crc16(head[2:] + bytes(17))) + bytes(17), 3 * KBPS[1, 3][at - 1]


def encode(payload: bytes) -> bytes:
    """The payload as a tagged variable-bitrate MPEG stream."""
    frames = []
    for i in range(0, len(payload), CHUNK):
        part = payload[i : i + CHUNK]
        start, length = _frame_start(len(part))
        frames.append(b"".join((start, struct.pack(">H", len(part)), part, bytes(length - len(start) - 2 - len(part)))))
    lengths = [len(f) for f in frames]
    info_head = bytes((0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0))
    info_length = frame_header(info_head)[0]
    total = info_length + sum(lengths)
    ends, at = [info_length], info_length
    for n in lengths:
        at += n
        ends.append(at)
    seek = bytes(min(255, 256 * ends[p * len(lengths) // 100] // total) for p in range(100))
    info = info_head + bytes(17) + b"Xing" + struct.pack(">III", 7, len(frames), total) + seek
    info += bytes(info_length - len(info))
    text = b"\x00" + str(len(frames) * 1152 * 1000 // 48000).encode()
    tag = b"TLEN" + struct.pack(">IH", len(text), 0) + text
    return b"".join((b"ID3\x03\x00\x00", _synchsafe(len(tag)), tag, info, *frames))


def scan(data: bytes) -> dict:
    """What the stream holds: tags, table, frames, checksums, duration, seek offsets, carried payload."""
    pos, tags, end = 0, {}, len(data)
    while data[pos : pos + 3] == b"ID3" and pos + 10 <= end:
        n = 0
        for b in data[pos + 6 : pos + 10]:
            n = n << 7 | b & 0x7F
        p, stop, version = pos + 10, min(end, pos + 10 + n), data[pos + 3]
        name, head = (3, 6) if version == 2 else (4, 10)
        while version in (2, 3, 4) and p + head <= stop and data[p]:
            size = int.from_bytes(data[p + name : p + 2 * name], "big")
            if version == 4:  # seven bits a byte
                size = sum((size >> 8 * i & 0x7F) << 7 * i for i in range(4))
            tags[data[p : p + name].decode("latin-1")] = data[p + head + 1 : min(stop, p + head + size)].decode("latin-1")
            p += head + size
        pos = min(end, pos + 10 + n + (10 if data[pos + 5] & 0x10 else 0))
    # an ID3v1 tag is one only where the walk over the frames comes to it, never inside a frame
    tail = end - 128 if end - pos >= 128 and data[-128:-125] == b"TAG" else -1
    offsets, parts, samples, rate, resyncs, skipped, bad, checked, table = [], [], 0, 0, 0, 0, 0, 0, None
    lost = True
    while pos + 4 <= end:
        if pos == tail:
            tags["v1"] = data[-125:-95].rstrip(b"\x00 ").decode("latin-1")
            break
        h = frame_header(data[pos : pos + 4])
        whole = h and pos + h[0] <= end
        if whole and pos < tail < pos + h[0] < end and not frame_header(data[pos + h[0] : pos + h[0] + 4]):
            whole = False  # a frame cut short by the tag
        # in step, a header is trusted; out of step, another must follow its frame, or the data end there
        if whole and (not lost or pos + h[0] + 4 > end or pos + h[0] == tail or frame_header(data[pos + h[0] : pos + h[0] + 4])):
            lost = False
            length, n, rate, side, layer, protected = h
            body = pos + 4 + 2 * protected
            after = body + side
            if table is None and not offsets and data[pos + 4 + side : pos + 8 + side] in (b"Xing", b"Info"):
                flags, q = struct.unpack(">I", data[pos + 8 + side : pos + 12 + side])[0], pos + 12 + side
                table = {"kind": "Xing"}
                for bit, name in ((1, "frames"), (2, "bytes")):
                    if flags & bit:
                        table[name] = struct.unpack(">I", data[q : q + 4])[0]
                        q += 4
                if flags & 4:
                    table["seek"] = zlib.crc32(data[q : q + 100])
            elif table is None and not offsets and data[pos + 36 : pos + 40] == b"VBRI":
                table = {"kind": "VBRI", "bytes": struct.unpack(">I", data[pos + 46 : pos + 50])[0], "frames": struct.unpack(">I", data[pos + 50 : pos + 54])[0]}
            else:
                if protected and layer == 3:
                    checked += 1
                    good = crc16(data[pos + 2 : pos + 4] + data[body:after]) == struct.unpack(">H", data[pos + 4 : pos + 6])[0]
                    bad += not good
                if layer == 3:
                    size = struct.unpack(">H", data[after : after + 2])[0] if after + 2 <= pos + length else 0
                    parts.append(data[after + 2 : after + 2 + min(size, pos + length - after - 2)])
                offsets.append(pos)
                samples += n
            pos += length
        else:
            resyncs += not lost
            lost = True
            nxt = data.find(b"\xff", pos + 1, end)
            nxt = nxt if nxt >= 0 else end
            nxt = tail if pos < tail < nxt else nxt
            skipped += nxt - pos
            pos = nxt
    return {"tags": tags, "table": table, "offsets": offsets, "samples": samples, "rate": rate, "resyncs": resyncs, "skipped": skipped, "checked": checked, "bad": bad, "payload": b"".join(parts)}


def padded(raw: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return raw + bytes(64 if not raw else -len(raw) % 64)


_STORED = "doc_id long, n_bytes long, media binary"
_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_samples long, sample_rate int, duration_seconds double, seek_offsets array<long>"


def store_audio(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, media: each whole text as an MPEG stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([encode(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _STORED)


def audio_features(media: DataFrame) -> DataFrame:
    """media(doc_id, n_bytes, media) -> digests of the payload read back, and the stream's features."""

    def row(doc_id: int | None, n_bytes: int | None, data: bytes | None) -> dict:
        s = scan(data or b"")
        p = s["payload"]
        t = s["table"] or {}
        offsets = zlib.crc32(b"".join(struct.pack(">Q", o) for o in s["offsets"]))
        feature = f"frames={len(s['offsets'])};samples={s['samples']};rate={s['rate']};table={t.get('kind', '-')}:{t.get('frames', 0)}:{t.get('bytes', 0)}:{t.get('seek', 0):08x};tags={len(s['tags'])};checked={s['checked']};bad={s['bad']};resyncs={s['resyncs']};skipped={s['skipped']};seek={offsets:08x}"
        return {
            "doc_id": doc_id, "n_bytes": n_bytes, "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:]), "media_bytes": len(data or b""), "media_sha256": hashlib.sha256(data or b"").hexdigest(),
            "feature": feature, "n_frames": len(s["offsets"]), "n_samples": s["samples"], "sample_rate": s["rate"], "duration_seconds": s["samples"] / s["rate"] if s["rate"] else 0.0, "seek_offsets": s["offsets"],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, sizes = b.column(0).to_pylist(), b.column(1).to_pylist()
            rows = [row(i, n, x) for i, n, x in zip(ids, sizes, b.column(2).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return pick(media, "doc_id", "n_bytes", "media").mapInArrow(run, _FEATURES)


_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ("feature", pa.string()), ("n_frames", pa.int64()), ("n_samples", pa.int64()), ("sample_rate", pa.int32()), ("duration_seconds", pa.float64()), ("seek_offsets", pa.list_(pa.int64())),
])


def op1_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents stored as MPEG audio, and what is read back from it."""
    return audio_features(store_audio(read(spark, sf_dir, "documents")))
