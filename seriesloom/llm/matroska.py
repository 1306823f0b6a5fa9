"""Media columns: byte payloads in Matroska files, and the packet table that parsing them gives.

A file is a tree of EBML elements: a variable-length id, a variable-length size, and a body. The writer stores a
payload losslessly as 8-bit samples of one PCM track: EBML header, segment with info, track, clusters of laced
simple blocks, and cues. The parser reads any such tree, also elements of unknown size and all four kinds of
lacing, and returns every frame with its timestamp, track and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION = 0x4282, 0x2AD7B1, 0x4489
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO, RATE, CHANNELS, BIT_DEPTH, LACING = 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that hold others and are walked into.
MASTERS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Payload bytes of a frame, frames of a laced block, blocks of a cluster; samples a second.
FRAME, LACE, CLUSTER_BLOCKS, SAMPLE_RATE = 192, 8, 16, 8000


def size_field(n: int, width: int = 0) -> bytes:
    """An element's size: leading zeros of the first byte tell how many bytes follow."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_field(len(body)) + body


def _number(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def padded(text: str | None) -> bytes:
    """A text's UTF-8 bytes with spaces up to a positive multiple of the frame size."""
    raw = (text or "").encode()
    return raw + b" " * (-len(raw) % FRAME if raw else FRAME)


def write(payload: bytes) -> bytes:
    """The payload as a Matroska file; whole blocks are laced with frames of fixed size, the last with EBML sizes."""
    header = element(EBML, element(DOC_TYPE, b"matroska"))
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    step = FRAME * 1000 // SAMPLE_RATE  # milliseconds a frame
    info = element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(step * len(frames)))))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    track = element(TRACKS, element(TRACK, _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues, at = [info, track], [], len(info) + len(track)
    for c in range(0, len(frames), LACE * CLUSTER_BLOCKS):
        time = c * step
        blocks = [_number(TIMESTAMP, time)]
        for b in range(c, min(c + LACE * CLUSTER_BLOCKS, len(frames)), LACE):
            own = frames[b : b + LACE]
            head = size_field(1) + struct.pack(">h", (b - c) * step)
            if len(own) == 1:
                blocks.append(element(SIMPLE_BLOCK, head + b"\x80" + own[0]))
            elif len(own) == LACE:
                blocks.append(element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(own) - 1]) + b"".join(own)))
            else:  # EBML lacing: the first size, then differences, biased to stay positive
                sizes = size_field(len(own[0])) + b"".join(size_field(0x1FFF, 2) for _ in own[1:-1])
                blocks.append(element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(own) - 1]) + sizes + b"".join(own)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _number(CUE_TIME, time) + element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """A size and the place after it; -1 stands for unknown."""
    first = data[at]
    width = 9 - first.bit_length()
    if not first or at + width > len(data):
        raise ValueError("bad size")
    n = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    if not data[at] or width > 4 or at + width > len(data):
        raise ValueError("bad id")
    return int.from_bytes(data[at : at + width], "big"), at + width


def elements(data: bytes, begin: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, place, begin and end of the body) of the elements in order, masters before what they hold.

    An element of unknown size reaches to its parent's end; a cluster of unknown size to the next cluster or cues.
    """
    stack = [(begin, end, 0)]
    while stack:
        at, end, inside = stack.pop()
        while at < end:
            kind, after = read_id(data, at)
            size, after = read_size(data, after)
            if inside == CLUSTER and kind in (CLUSTER, CUES, TRACKS, INFO):  # ends a cluster of unknown size
                end, at = at, at
                parent = stack.pop()
                stack.append((at, parent[1], parent[2]))
                break
            stop = end if size < 0 else after + size
            if stop > end:
                raise ValueError("element reaches beyond its parent")
            yield kind, at, after, stop
            if kind in MASTERS:
                stack.append((stop, end, inside))
                at, end, inside = after, stop, kind
            else:
                at = stop


@dataclass
class Packet:
    track: int
    timestamp: int
    begin: int
    end: int
    keyframe: bool
    lacing: int


def laced(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames. kind: 0 none, 1 Xiph, 2 fixed size, 3 EBML."""
    if not kind:
        return [(at, end)]
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif kind == 3 and count > 1:
        n, at = read_size(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            begin = at
            n, at = read_size(data, at)
            if n < 0:  # all ones: the greatest difference
                n = (1 << 7 * (at - begin)) - 1
            sizes.append(sizes[-1] + n - ((1 << 7 * (at - begin) - 1) - 1))
    elif kind == 2:
        if (end - at) % count:
            raise ValueError("frames of unequal size")
        sizes = [(end - at) // count] * (count - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("bad lacing")
    out = []
    for n in sizes:
        out.append((at, at + n))
        at += n
    return out


@dataclass
class Parsed:
    packets: list[Packet]
    cues: list[tuple[int, int, int]]
    clusters: list[int]
    codec: str
    duration: float
    segment: int


def parse(data: bytes) -> Parsed:
    """All packets, cue points (time, track, place in the segment's body), cluster places, codec and duration."""
    out = Parsed([], [], [], "", 0.0, 0)
    cluster_time = cue_time = cue_track = 0
    for kind, at, begin, end in elements(data, 0, len(data)):
        body = data[begin:end] if end - begin <= 16 else b""
        if kind == SEGMENT:
            out.segment = begin
        elif kind == CLUSTER:
            out.clusters.append(at)
        elif kind == TIMESTAMP:
            cluster_time = int.from_bytes(body, "big")
        elif kind in (SIMPLE_BLOCK, BLOCK):
            track, p = read_size(data, begin)
            offset, flags = struct.unpack_from(">hB", data, p)
            for a, b in laced(data, p + 3, end, flags >> 1 & 3):
                out.packets.append(Packet(track, cluster_time + offset, a, b, bool(flags & 0x80), flags >> 1 & 3))
        elif kind == CODEC_ID:
            out.codec = data[begin:end].decode("latin-1")
        elif kind == DURATION:
            out.duration = struct.unpack(">d" if end - begin == 8 else ">f", body)[0]
        elif kind == CUE_TIME:
            cue_time = int.from_bytes(body, "big")
        elif kind == CUE_TRACK:
            cue_track = int.from_bytes(body, "big")
        elif kind == CUE_CLUSTER:
            out.cues.append((cue_time, cue_track, int.from_bytes(body, "big")))
    return out


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_bytes (of the text), media (the file). A null text is empty and gives one frame of spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([write(padded(t)) for t in texts], pa.binary())], ["k", "n_bytes", "media"])

    rows = docs.select(docs[key].alias("k"), docs[text].cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_bytes long, media binary").withColumnRenamed("k", key)


def packets(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """The packet table of a media column: key, packet, track, timestamp, begin, end, keyframe, lacing, error.

    A null or empty file has no packets; a broken one gives a single row with the error and nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows += [(k, i, p.track, p.timestamp, p.begin, p.end, p.keyframe, p.lacing, None) for i, p in enumerate(parse(m or b"").packets)]
                except (ValueError, IndexError, struct.error) as e:
                    rows.append((k, *[None] * 7, str(e)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [batch.schema[0].type, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["k", "packet", "track", "timestamp", "begin", "end", "keyframe", "lacing", "error"])

    rows = media.select(media[key].alias("k"), "media")
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, packet int, track int, timestamp long, begin long, `end` long, keyframe boolean, lacing int, error string").withColumnRenamed("k", key)


def digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per file of a media table (key, n_bytes, media): sizes and checksums of the payload read back from its
    packets and of the stored bytes, and a feature string of what the parser found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows = []
            for k, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = parse(m)
                payload = b"".join([m[x.begin : x.end] for x in p.packets])
                clusters = set(p.clusters)
                seekable = all(p.segment + place in clusters for _, _, place in p.cues)
                feature = f"{p.codec};packets={len(p.packets)};clusters={len(p.clusters)};cues={len(p.cues)};seekable={int(seekable)};ms={p.duration:.0f};last={p.packets[-1].timestamp if p.packets else 0};mean={sum(payload) / max(len(payload), 1):.4f}"
                rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t or batch.schema[0].type) for c, t in zip(columns, kinds, strict=True)], names)

    rows = media.select(media[key].alias("k"), "n_bytes", "media")
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").withColumnRenamed("k", key)
