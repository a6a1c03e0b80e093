"""Media columns: Matroska files in a binary column, written and parsed element by element.

The parser walks variable-length EBML elements (known and unknown sizes), clusters, simple and grouped blocks with no,
Xiph, fixed-size or EBML lacing, and cues, and gives a packet table: track, timestamp and byte range of every frame.
A document's text is stored as 8-bit PCM, FRAME samples a packet.

Defined cases: null text is the empty text, whose payload is one packet of spaces; equal texts give equal files; broken
or foreign bytes, and null media, give no packets; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.common import spread

FRAME, RATE, LACED, BLOCKS = 192, 8000, 8, 16
#: Element identifiers of EBML and Matroska.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIME, BLOCK, SIMPLE, GROUP = 0xE7, 0xA1, 0xA3, 0xA0
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, CLUSTER, GROUP, CUES, CUE_POINT, CUE_PLACES}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}


def vint(n: int) -> bytes:
    """An element size in as few bytes as hold it (all ones stand for an unknown size)."""
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k, "big")


def uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def element(name: int, body: bytes) -> bytes:
    return uint(name) + vint(len(body)) + body


HEAD = element(EBML, b"".join(element(k, v) for k, v in ((0x4286, b"\1"), (0x42F7, b"\1"), (0x42F2, b"\4"), (0x42F3, b"\x08"), (0x4282, b"matroska"), (0x4287, b"\4"), (0x4285, b"\2"))))
INFO_PART = element(INFO, element(0x2AD7B1, uint(1_000_000)) + element(0x4D80, b"quillon") + element(0x5741, b"quillon"))
_AUDIO = element(0xE1, element(0xB5, struct.pack(">d", RATE)) + element(0x9F, b"\1") + element(0x6264, b"\x08"))
TRACK_PART = element(TRACKS, element(0xAE, element(0xD7, b"\1") + element(0x73C5, b"\1") + element(0x83, b"\2") + element(0x86, b"A_PCM/INT/LIT") + _AUDIO))


def _lace(kind: int, frames: list[bytes]) -> bytes:
    """Lacing head: number of frames less one, and the sizes that the kind (1 Xiph, 2 fixed, 3 EBML) states."""
    out = bytes([len(frames) - 1])
    if kind == 1:
        out += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    if kind == 3:
        out += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            k, d = 1, len(b) - len(a)
            while abs(d) > (1 << 7 * k - 1) - 1:
                k += 1
            out += (d + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k, "big")
    return out


def write(payload: bytes) -> bytes:
    """A Matroska file of one PCM track; lacing kinds take turns, every cluster has a cue."""
    ms = FRAME * 1000 // RATE
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    blocks = [frames[i : i + LACED] for i in range(0, len(frames), LACED)]
    parts, cues, place = [INFO_PART, TRACK_PART], [], len(INFO_PART) + len(TRACK_PART)
    for c in range(0, len(blocks), BLOCKS):
        start = c * LACED * ms
        body = [element(TIME, uint(start))]
        for b, laced in enumerate(blocks[c : c + BLOCKS]):
            kind = 0 if len(laced) == 1 else (c + b) % 3 + 1
            head = b"\x81" + struct.pack(">h", b * LACED * ms) + bytes([0x80 | kind << 1]) + (_lace(kind, laced) if kind else b"")
            body.append(element(SIMPLE, head + b"".join(laced)))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, element(CUE_TIME, uint(start)) + element(CUE_PLACES, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, uint(place)))))
        parts.append(cluster)
        place += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return HEAD + element(SEGMENT, b"".join(parts))


def _vint(data: bytes, at: int, marked: bool) -> tuple[int, int, bool]:
    """(value, next offset, all value bits are ones); marked: the length marker stays part of the value."""
    first = data[at]
    k = 9 - first.bit_length()
    if k > 8 or at + k > len(data):
        raise ValueError("not a variable-length integer")
    raw = int.from_bytes(data[at : at + k], "big")
    value = raw & (1 << 7 * k) - 1
    return (raw if marked else value), at + k, value == (1 << 7 * k) - 1


def _sizes(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Where the frames of a block start, and the size of each."""
    if kind == 0:
        return at, [end - at]
    n, at, sizes = data[at] + 1, at + 1, []
    if kind == 2:
        if (end - at) % n:
            raise ValueError("fixed-size lacing doesn't divide the block")
        return at, [(end - at) // n] * n
    for i in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, after, _ = _vint(data, at, False)
            size = value if i == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames exceed their block")
    return at, sizes


def parse(data: bytes) -> tuple[list[tuple], list[tuple]]:
    """Packets (track, timestamp, start, size, key, cluster, lacing, index in the lace) and cues (time, track, cluster start)."""
    packets: list[tuple] = []
    cues: list[tuple] = []
    state = {"time": 0, "cluster": -1, "segment": 0, "cue": [0, 0]}

    def number(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def block(at: int, end: int, simple: bool) -> None:
        track, at, _ = _vint(data, at, False)
        (rel,) = struct.unpack_from(">h", data, at)
        flags = data[at + 2]
        kind = flags >> 1 & 3
        start, sizes = _sizes(data, at + 3, end, kind)
        for i, size in enumerate(sizes):
            packets.append((track, state["time"] + rel, start, size, bool(simple and flags & 0x80), state["cluster"], kind, i))
            start += size

    def walk(at: int, end: int, parent: int) -> int:
        while at < end:
            name, body, _ = _vint(data, at, True)
            if parent == CLUSTER and name in TOP:  # an unknown-size cluster ends where the next top element begins
                return at
            size, body, unknown = _vint(data, body, False)
            stop = end if unknown else body + size
            if stop > end:
                raise ValueError("an element exceeds its parent")
            if name == SEGMENT:
                state["segment"] = body
            elif name == CLUSTER:
                state["cluster"] = at - state["segment"]
            elif name == TIME:
                state["time"] = number(body, stop)
            elif name in (SIMPLE, BLOCK):
                block(body, stop, name == SIMPLE)
            elif name == CUE_TIME:
                state["cue"][0] = number(body, stop)
            elif name == CUE_TRACK:
                state["cue"][1] = number(body, stop)
            elif name == CUE_CLUSTER:
                cues.append((*state["cue"], number(body, stop)))
            at = walk(body, stop, name) if name in MASTERS else stop
        return at

    walk(0, len(data), 0)
    return packets, cues


def read(data: bytes, track: int = 1) -> tuple[bytes, list[tuple], list[tuple]]:
    """The stored bytes of a track, found by its packets in the order of time, with packets and cues."""
    packets, cues = parse(data)
    # frames of one lace carry the time of their block, so the order within it is that of the lace
    own = sorted((p for p in packets if p[0] == track), key=lambda p: (p[1], p[7]))
    return b"".join(data[p[2] : p[2] + p[3]] for p in own), own, cues


def parts(data: bytes):
    """(name, start, end, start of the segment's body) of the file's elements and the segment's, without entering them."""
    at = segment = 0
    while at < len(data):
        name, body, _ = _vint(data, at, True)
        size, body, unknown = _vint(data, body, False)
        if name == SEGMENT:
            at = segment = body
            continue
        stop = len(data) if unknown else body + size
        yield name, at, stop, segment
        at = stop


def seek(data: bytes, time: int, track: int = 1) -> list[tuple]:
    """Packets of a track from a time on. The last cue at or before it names the cluster from which the file is read;
    clusters before it aren't. Without such a cue all of the file is."""
    start, found = 0, -1
    for name, at, stop, segment in parts(data):
        if name == CUES:
            for when, of, cluster in parse(data[at:stop])[1]:
                if of == track and found < when <= time:
                    start, found, before = segment + cluster, when, segment
    shift = start - before if start else 0
    packets = parse(data[start:])[0]
    return [(t, when, a + start, n, key, cluster + shift, lace, i) for t, when, a, n, key, cluster, lace, i in packets if t == track and when >= time]


PACKETS = "track int, timestamp long, start long, size long, keyframe boolean, cluster long, lacing int, in_lace int, cue boolean"


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """media(key, column: bytes) -> a row for each packet, with its byte range; cue: a cue points to its cluster."""
    kind = media.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{key} {kind}, {PACKETS}")

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found, cues = parse(data.as_py() or b"")
                except (ValueError, IndexError, struct.error):
                    continue
                pointed = {c[2] for c in cues}
                rows += [dict(zip(arrow.names, (k, *p, p[5] in pointed), strict=True)) for p in found]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return media.select(key, column).mapInArrow(run, schema)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The length of the text in UTF-8, and the same padded with spaces to a positive multiple of FRAME."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, b" ")


def features(payload: bytes, own: list[tuple], cues: list[tuple]) -> str:
    """Integer features of the samples read back and of the packet table."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"packets={len(own)};clusters={len({p[5] for p in own})};cues={len(cues)};last_ms={own[-1][1]};sum={x.sum()};squares={(x * x).sum()};low={x.min()};high={x.max()};crossings={crossings}"


def describe(text: str | None) -> tuple:
    n, payload = payload_of(text)
    media = write(payload)
    back, own, cues = read(media)
    return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back, own, cues), media


def store(docs: DataFrame, media: bool = False) -> DataFrame:
    """docs(doc_id, text) -> what was stored and read back for each row; with media, the files too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"][: 8 if media else 7]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]

    def run(batches):
        for batch in batches:
            rows = list(zip(*(describe(t.as_py()) for t in batch.column(1)), strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, k) for _, r, k in zip(names, rows, kinds, strict=False))], ["doc_id", *names])

    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", media binary" * media
    return spread(docs.select("doc_id", "text")).mapInArrow(run, schema)


def query(spark, docs: DataFrame) -> DataFrame:
    return store(docs)
