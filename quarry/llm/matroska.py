"""Matroska files as packet tables, and texts stored losslessly as audio samples."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
TIME_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC, AUDIO, RATE, CHANNELS, BITS, LACING_FLAG = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements whose content is more elements.
PARENTS = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_PLACE}
#: Elements at the top of a segment; they end a cluster of unknown size.
TOP = {INFO, TRACKS, CLUSTER, CUES}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Samples a second, bytes of a packet, packets of a laced block, blocks of a cluster.
SAMPLE_RATE, PACKET, LACED, BLOCKS = 8000, 512, 8, 8


class MatroskaError(ValueError):
    """The bytes aren't a well-formed file."""


@dataclass
class Packet:
    track: int
    timestamp: int
    offset: int
    size: int
    cluster: int
    keyframe: bool
    lacing: int


def read_id(data: bytes, at: int, end: int) -> tuple[int, int]:
    """An element's id, with its length marker, and where it ends."""
    if at >= end:
        raise MatroskaError(f"no id at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > end:
        raise MatroskaError(f"bad id at {at}")
    return int.from_bytes(data[at : at + n], "big"), at + n


def read_size(data: bytes, at: int, end: int) -> tuple[int | None, int]:
    """A variable-length number without its length marker (None: unknown) and where it ends."""
    if at >= end or not data[at] or at + (n := 9 - data[at].bit_length()) > end:
        raise MatroskaError(f"bad size at {at}")
    value = int.from_bytes(data[at : at + n], "big") ^ (1 << 7 * n)
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def write_size(value: int) -> bytes:
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def elements(data: bytes, at: int, end: int, inside: int | None = None) -> Iterator[tuple[int, int, int]]:
    """(id, start of content, end of content) of the elements in a range."""
    while at < end:
        kind, body = read_id(data, at, end)
        size, body = read_size(data, body, end)
        if size is None:
            if kind not in (SEGMENT, CLUSTER):
                raise MatroskaError(f"unknown size at {at}")
            stop = end
            if kind == CLUSTER:
                stop = body
                while stop < end and read_id(data, stop, end)[0] not in TOP:
                    _, x = read_id(data, stop, end)
                    n, x = read_size(data, x, end)
                    if n is None:
                        raise MatroskaError(f"unknown size at {stop}")
                    stop = x + n
        else:
            stop = body + size
        if stop > end:
            raise MatroskaError(f"element at {at} ends beyond its parent")
        yield kind, body, stop
        at = stop


def uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def laced_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """The sizes of a block's frames, and where the first begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise MatroskaError("a laced block without a count")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise MatroskaError("a block that its frames don't fill")
        return [(end - at) // n] * n, at
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise MatroskaError("a lace without an end")
                size += (b := data[at])
                at += 1
                if b != 255:
                    break
        else:
            first = at
            value, at = read_size(data, at, end)
            bits = 7 * (at - first)
            if value is None:
                value = (1 << bits) - 1
            size = value if k == 0 else sizes[-1] + value - ((1 << bits - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise MatroskaError("frames larger than their block")
    return sizes, at


def write_lacing(sizes: list[int], lacing: int) -> bytes:
    """What stands before the frames of a laced block."""
    head = bytes([len(sizes) - 1])
    if lacing == FIXED:
        return head
    if lacing == XIPH:
        return head + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    out = head + write_size(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        n, step = 1, b - a
        while not -((1 << 7 * n - 1) - 1) <= step < (1 << 7 * n - 1):
            n += 1
        out += (step + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big")
    return out


def parse(data: bytes) -> tuple[dict, list[Packet], list[tuple[int, int, int]]]:
    """What the file says of itself and its tracks; its packets with times in ns and byte ranges; its cues (ns, track, cluster's offset)."""
    info: dict = {"scale": 1_000_000, "tracks": {}, "duration": None, "doc_type": None}
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []

    def track(a: int, b: int) -> None:
        own = {"codec": "", "rate": 0.0, "bits": 0, "type": 0, "channels": 1}
        number = 0
        for kind, x, y in elements(data, a, b):
            if kind == TRACK_NUMBER:
                number = uint(data, x, y)
            elif kind == TRACK_TYPE:
                own["type"] = uint(data, x, y)
            elif kind == CODEC:
                own["codec"] = data[x:y].decode()
            elif kind == AUDIO:
                for k, p, q in elements(data, x, y):
                    if k == RATE:
                        own["rate"] = struct.unpack(">d" if q - p == 8 else ">f", data[p:q])[0]
                    elif k == BITS:
                        own["bits"] = uint(data, p, q)
                    elif k == CHANNELS:
                        own["channels"] = uint(data, p, q)
        info["tracks"][number] = own

    def block(a: int, b: int, base: int, cluster: int, key: bool | None) -> None:
        number, at = read_size(data, a, b)
        if number is None or at + 3 > b:
            raise MatroskaError(f"bad block at {a}")
        (shift,) = struct.unpack(">h", data[at : at + 2])
        flags = data[at + 2]
        lacing = flags >> 1 & 3
        sizes, start = laced_sizes(data, at + 3, b, lacing)
        time = (base + shift) * info["scale"]
        for size in sizes:
            packets.append(Packet(number, time, start, size, cluster, bool(flags & 128) if key is None else key, lacing))
            start += size
            own = info["tracks"].get(number)
            if own and own["codec"].startswith("A_PCM") and own["rate"] and own["bits"]:
                time += round(size * 8 / own["bits"] / own["channels"] / own["rate"] * 1e9)

    for kind, a, b in elements(data, 0, len(data)):
        if kind == EBML:
            info["doc_type"] = next((data[x:y].decode() for k, x, y in elements(data, a, b) if k == DOC_TYPE), None)
        if kind != SEGMENT:
            continue
        if info["doc_type"] not in ("matroska", "webm"):
            raise MatroskaError("no header of the format")
        at = a
        for k, x, y in elements(data, a, b):
            if k == INFO:
                for i, p, q in elements(data, x, y):
                    if i == TIME_SCALE:
                        info["scale"] = uint(data, p, q)
                    elif i == DURATION:
                        info["duration"] = struct.unpack(">d" if q - p == 8 else ">f", data[p:q])[0]
            elif k == TRACKS:
                for i, p, q in elements(data, x, y):
                    if i == TRACK:
                        track(p, q)
            elif k == CLUSTER:
                base = 0
                for i, p, q in elements(data, x, y):
                    if i == TIMESTAMP:
                        base = uint(data, p, q)
                    elif i == SIMPLE_BLOCK:
                        block(p, q, base, at - a, None)
                    elif i == BLOCK_GROUP:
                        inner = list(elements(data, p, q))
                        for j, s, t in inner:
                            if j == BLOCK:
                                block(s, t, base, at - a, all(z[0] != REFERENCE for z in inner))
            elif k == CUES:
                for i, p, q in elements(data, x, y):
                    time = 0
                    for j, s, t in elements(data, p, q) if i == CUE_POINT else ():
                        if j == CUE_TIME:
                            time = uint(data, s, t)
                        elif j == CUE_PLACE:
                            place = {c: uint(data, u, v) for c, u, v in elements(data, s, t)}
                            cues.append((time * info["scale"], place.get(CUE_TRACK, 0), place.get(CUE_CLUSTER, 0)))
            at = y
    return info, packets, cues


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + write_size(len(body)) + body


def number(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def mux(payload: bytes) -> bytes:
    """A file with one track of 8-bit PCM samples, the payload's bytes. Laces of all kinds take turns."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
    scale = 125_000  # a sample's ns: at 8000 Hz a tick is a sample
    info = element(INFO, number(TIME_SCALE, scale) + element(DURATION, struct.pack(">d", float(len(payload)))) + element(MUXER, b"q") + element(WRITER, b"q"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + number(CHANNELS, 1) + number(BITS, 8))
    tracks = element(TRACKS, element(TRACK, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(LACING_FLAG, 1) + element(CODEC, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    step = PACKET * LACED * BLOCKS
    for start in range(0, len(payload), step):
        parts = [number(TIMESTAMP, start)]
        for k, first in enumerate(range(start, min(start + step, len(payload)), PACKET * LACED)):
            chunk = payload[first : min(first + PACKET * LACED, start + step)]
            sizes = [min(PACKET, len(chunk) - i) for i in range(0, len(chunk), PACKET)]
            lacing = NO_LACING if len(sizes) == 1 else FIXED if sizes[0] == sizes[-1] and k % 3 == 0 else XIPH if k % 3 == 1 else EBML_LACING
            lace = b"" if lacing == NO_LACING else write_lacing(sizes, lacing)
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", first - start) + bytes([128 | lacing << 1]) + lace + chunk))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, number(CUE_TIME, start) + element(CUE_PLACE, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def packet_tables(files: DataFrame, key: str = "file_id", content: str = "content") -> DataFrame:
    """A row for each packet of each file: key, seq, track, codec, timestamp_ns, byte_start, byte_end, cluster, keyframe, lacing, cued; error.

    A file that isn't well formed, is empty or null gives one row with only its key and `error`.
    Repeated rows and null keys are passed on; other columns are left out.
    """
    names = ["seq", "track", "codec", "timestamp_ns", "byte_start", "byte_end", "cluster", "keyframe", "lacing", "cued", "error"]
    kinds = ["int", "int", "string", "long", "long", "long", "long", "boolean", "int", "boolean", "string"]

    def rows(data: bytes | None) -> list[tuple]:
        try:
            info, packets, cues = parse(data or b"")
            if info["doc_type"] is None:
                raise MatroskaError("no header of the format")
        except (MatroskaError, UnicodeDecodeError, struct.error) as e:
            return [(None,) * 10 + (str(e),)]
        cued = {(t, c) for _, t, c in cues}
        return [(i, p.track, info["tracks"].get(p.track, {}).get("codec"), p.timestamp, p.offset, p.offset + p.size, p.cluster, p.keyframe, p.lacing, (p.track, p.cluster) in cued, None) for i, p in enumerate(packets)]

    def run(batches):
        for batch in batches:
            keys, cols = [], [[] for _ in names]
            for k, data in zip(batch.column(0), batch.column(1), strict=True):
                for row in rows(data.as_py()):
                    keys.append(k)
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
            types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], batch.column(0).type), *(pa.array(c, types[t]) for c, t in zip(cols, kinds, strict=True))], ["key", *names])

    kind = files.schema[key].dataType.simpleString()
    out = files.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).mapInArrow(run, f"key {kind}, " + ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True)))
    return out.withColumnRenamed("key", key)


def store(text: str | None) -> tuple[int, bytes]:
    """The text's bytes without padding, and its file."""
    raw = (text or "").encode()
    return len(raw), mux(raw + bytes(64 - len(raw) % 64 if len(raw) % 64 or not raw else 0))


def digest(text: str | None) -> tuple:
    """Stores a text, reads the file back by its packet table, and describes both."""
    n, media = store(text)
    info, packets, cues = parse(media)
    payload = b"".join([media[p.offset : p.offset + p.size] for p in packets])
    samples = np.frombuffer(payload, np.uint8)
    level = int(samples.sum(dtype=np.int64))
    steps = int(np.abs(np.diff(samples.astype(np.int16))).sum(dtype=np.int64))
    clusters = len({p.cluster for p in packets})
    feature = f"tracks={len(info['tracks'])};packets={len(packets)};clusters={clusters};cues={len(cues)};ns={len(samples) * 125_000};last={packets[-1].timestamp};sum={level};steps={steps}"
    return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def media_columns(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    The whole text's UTF-8 (null: empty), padded with zeros to a positive multiple of 64 bytes, is stored
    as the 8-bit samples of a PCM track and read back through the file's packet table; the digests are of
    what was read. Equal texts give equal values. Null doc_id and repeated rows are passed on; an empty
    table gives an empty result.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int64() if x.split()[1] == "long" else pa.string() for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            cols = list(zip(*[digest(t.as_py()) for t in batch.column(1)], strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types[1:], strict=True))], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
