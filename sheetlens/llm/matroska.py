"""Media columns in Matroska: write bytes as 8-bit samples and parse the file again.

The writer makes one audio track of unsigned 8-bit PCM in clusters of laced simple blocks
with cues. The parser reads any such file by its EBML elements: variable-length ids and
sizes (unknown sizes too), clusters, simple blocks and block groups, Xiph, EBML and
fixed-size lacing, and cues; it yields a packet table with track, timestamp and byte range.
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
from pyspark.sql import functions as F

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMECODE_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, FLAG_LACING, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x9C, 0x23E383
TIMECODE, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE = 0x4282
_MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES}

RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 16  # samples a second, samples a frame, frames a block, blocks a cluster


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << 7 * k) - 1:  # all ones mean an unknown size
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def _element(ident: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_size(n: int) -> bytes:
    k = 1
    while not -(1 << 7 * k - 1) < n < 1 << 7 * k - 1:
        k += 1
    return (n + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")


def _block(track: int, rel: int, frames: list[bytes]) -> bytes:
    head = _size(track) + struct.pack(">h", rel)
    if len(frames) == 1:
        return head + b"\x80" + frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:  # fixed-size lacing
        return head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames)
    lace = _size(sizes[0]) + b"".join(_signed_size(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return head + b"\x86" + bytes([len(frames) - 1]) + lace + b"".join(frames)


_HEADER = _element(EBML, _uint(0x4286, 1), _uint(0x42F7, 1), _uint(0x42F2, 4), _uint(0x42F3, 8), _element(DOC_TYPE, b"matroska"), _uint(0x4287, 4), _uint(0x4285, 2))
_TRACK = _element(TRACKS, _element(
    TRACK_ENTRY, _uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, 1), _uint(DEFAULT_DURATION, FRAME * 10**9 // RATE), _element(CODEC_ID, b"A_PCM/INT/LIT"),
    _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)), _uint(CHANNELS, 1), _uint(BIT_DEPTH, 8))))


def mux(samples: bytes) -> bytes:
    """A Matroska file of the samples; timestamps are in milliseconds."""
    info = _element(INFO, _uint(TIMECODE_SCALE, 1_000_000), _element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)))
    at, clusters, cues = len(info) + len(_TRACK), [], []
    per_cluster = FRAME * LACED * BLOCKS
    for c in range(0, len(samples), per_cluster):
        base = c * 1000 // RATE
        parts = [_uint(TIMECODE, base)]
        for b in range(c, min(c + per_cluster, len(samples)), FRAME * LACED):
            frames = [samples[f : f + FRAME] for f in range(b, min(b + FRAME * LACED, len(samples)), FRAME)]
            parts.append(_element(SIMPLE_BLOCK, _block(1, b * 1000 // RATE - base, frames)))
        clusters.append(_element(CLUSTER, *parts))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, base), _element(CUE_POSITIONS, _uint(CUE_TRACK, 1), _uint(CUE_CLUSTER, at))))
        at += len(clusters[-1])
    return _HEADER + _element(SEGMENT, info, _TRACK, *clusters, _element(CUES, *cues))


@dataclass
class Media:
    """What the parser found. packets: (track, timestamp in ns, offset, size, cluster number)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict[int, int | float | bytes]] = field(default_factory=dict)
    packets: list[tuple[int, int, int, int, int]] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)  # offset in the segment, time
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, offset in the segment


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """(value, next place, whether all its bits are ones)."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    k = 9 - data[at].bit_length()
    if at + k > len(data):
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at : at + k], "big")
    mask = (1 << 7 * k) - 1
    return n if keep else n & mask, at + k, n & mask == mask


def elements(data: bytes, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, place of the body, end) of each element; an unknown size runs to the next element of its level."""
    while at < end:
        start = at
        ident, at, _ = _vint(data, at, True)
        size, at, unknown = _vint(data, at)
        if unknown and ident == CLUSTER:
            stop = next((s for i, s, _, _ in elements(data, at, end, CLUSTER) if i in _TOP), end)
        else:
            stop = end if unknown else at + size
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {start} runs over its end")
        yield ident, start, at, stop
        if inside == CLUSTER and ident in _TOP:
            return
        at = stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(track, relative time, byte ranges) of a block."""
    track, at, _ = _vint(data, at)
    rel, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing = flags >> 1 & 3
    if not lacing:
        return track, rel, [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 2:
        if (end - at) % n:
            raise ValueError("fixed-size lacing that does not divide its block")
        sizes = [(end - at) // n] * (n - 1)
    elif lacing == 1:
        for _ in range(n - 1):
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
    else:
        for k in range(n - 1):
            first = at
            value, at, _ = _vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * (at - first) - 1) - 1))
    out = []
    for s in [*sizes, end - at - sum(sizes)]:
        if s < 0 or at + s > end:
            raise ValueError("lacing runs over its block")
        out.append((at, s))
        at += s
    return track, rel, out


def parse(data: bytes) -> Media:
    """The packet table of a file; ValueError where it is damaged."""
    media = Media()
    frame_ns: dict[int, int] = {}
    for ident, _, body, end in elements(data, 0, len(data)):
        if ident == EBML:
            media.doc_type = next((data[b:e].decode() for i, _, b, e in elements(data, body, end) if i == DOC_TYPE), "")
        elif ident == SEGMENT:
            for kind, start, inner, stop in elements(data, body, end):
                if kind == INFO:
                    for i, _, b, e in elements(data, inner, stop):
                        if i == TIMECODE_SCALE:
                            media.scale = int.from_bytes(data[b:e], "big")
                        elif i == DURATION:
                            media.duration = struct.unpack(">d" if e - b == 8 else ">f", data[b:e])[0]
                elif kind == TRACKS:
                    for i, _, b, e in elements(data, inner, stop):
                        if i == TRACK_ENTRY:
                            got = {j: data[c:f] for j, _, c, f in elements(data, b, e)}
                            number = int.from_bytes(got.get(TRACK_NUMBER, b""), "big")
                            media.tracks[number] = got
                            frame_ns[number] = int.from_bytes(got.get(DEFAULT_DURATION, b""), "big")
                elif kind == CLUSTER:
                    time = 0
                    media.clusters.append((start - body, 0))
                    for i, _, b, e in elements(data, inner, stop):
                        blocks = ()
                        if i == TIMECODE:
                            time = int.from_bytes(data[b:e], "big")
                            media.clusters[-1] = (start - body, time)
                        elif i == SIMPLE_BLOCK:
                            blocks = ((b, e),)
                        elif i == BLOCK_GROUP:
                            blocks = tuple((c, f) for j, _, c, f in elements(data, b, e) if j == BLOCK)
                        for c, f in blocks:
                            track, rel, ranges = _frames(data, c, f)
                            for k, (offset, size) in enumerate(ranges):
                                media.packets.append((track, (time + rel) * media.scale + k * frame_ns.get(track, 0), offset, size, len(media.clusters) - 1))
                elif kind == CUES:
                    for i, _, b, e in elements(data, inner, stop):
                        if i == CUE_POINT:
                            time, where = 0, []
                            for j, _, c, f in elements(data, b, e):
                                if j == CUE_TIME:
                                    time = int.from_bytes(data[c:f], "big")
                                elif j == CUE_POSITIONS:
                                    got = {g: int.from_bytes(data[h:m], "big") for g, _, h, m in elements(data, c, f)}
                                    where.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
                            media.cues += [(time, t, p) for t, p in where]
    return media


def samples_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[o : o + n] for t, _, o, n, _ in media.packets if t == track)


def padded(text: str | None, unit: int = 64) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + bytes(-len(raw) % unit or (0 if raw else unit))


PACKET_SCHEMA = "packet long, track long, timestamp_ns long, byte_offset long, byte_length long, cluster long, cued boolean"


def packet_table(media: DataFrame, key: str, column: str) -> DataFrame:
    """A row per packet of each file: ``key`` and ``PACKET_SCHEMA``. Null files have no packets; damaged ones raise."""
    rows = media.select(F.col(key), F.col(column).cast("binary").alias("_media"))
    schema = f"{rows.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, {PACKET_SCHEMA}"

    def run(batches):
        for batch in batches:
            for i, data in enumerate(batch.column(1).to_pylist()):
                if data is None:
                    continue
                m = parse(data)
                cued = {p for _, _, p in m.cues}
                cols = list(zip(*((k, *p, m.clusters[p[4]][0] in cued) for k, p in enumerate(m.packets)), strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(m.packets), pa.int64())), *(pa.array(c, pa.int64()) for c in cols[:6]), pa.array(cols[6], pa.bool_())],
                                                 names=[key, "packet", "track", "timestamp_ns", "byte_offset", "byte_length", "cluster", "cued"])

    return rows.mapInArrow(run, schema)


def stored(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """``docs`` with the file that holds each padded text; equal texts give equal files."""
    base = docs.drop(into)
    place, schema = base.columns.index(text), base.select("*", F.lit(b"").alias(into)).schema

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([mux(padded(t)[1]) for t in batch.column(place).to_pylist()], pa.binary())], names=schema.names)

    return base.mapInArrow(run, schema)


DIGEST_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(text: str | None) -> tuple:
    """Store a text, read the stored bytes back through the packet table, and describe both."""
    n, payload = padded(text)
    data = mux(payload)
    media = parse(data)
    back = samples_of(data, media)
    ends = [m[2] + m[3] for m in media.packets]
    if sorted(media.cues) != [(t, 1, p) for p, t in media.clusters]:
        raise ValueError("cues do not point at the clusters")
    s = np.frombuffer(back, np.uint8)
    crossings = int(np.count_nonzero(np.diff(s >= 128)))
    feature = f"packets={len(media.packets)};clusters={len(media.clusters)};ms={media.duration:.3f};mean={s.mean():.6f};peak={int(s.max())};crossings={crossings};end={ends[-1]}"
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key`` and ``DIGEST_SCHEMA`` per row; a null text is an empty one, repeated rows repeat."""
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    schema = f"{rows.select(key).schema.simpleString()[7:-1].replace(':', ' ', 1)}, {DIGEST_SCHEMA}"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(digest, batch.column(1).to_pylist()), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return rows.mapInArrow(run, schema)
