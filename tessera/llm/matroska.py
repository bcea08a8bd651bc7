"""Matroska: EBML elements, clusters, lacing and cues to packet tables, and a writer of audio tracks.

The reader takes elements with sizes of one to eight bytes and of unknown size,
SimpleBlocks and BlockGroups, the three kinds of lacing and none, and returns a
row for each packet: track, timestamp, byte range, key frame, cluster.
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

from .common import table, utf8

# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
ENTRY, NUMBER, UID, KIND, CODEC, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, DEPTH, LACES = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264, 0x9C
TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: The writer's tracks: samples a second, bytes of a packet, packets of a block and blocks of a cluster.
SAMPLES, PACKET, LACED, CLUSTERED = 8000, 192, 16, 8
PACKET_MS = PACKET * 1000 // SAMPLES


def vint(n: int) -> bytes:
    """A size in as few bytes as can be; all ones would mean unknown."""
    for width in range(1, 9):
        if n < (1 << 7 * width) - 1:
            return (n | 1 << 7 * width).to_bytes(width, "big")
    raise ValueError("too large for an element")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(key: int, x: float) -> bytes:
    return element(key, struct.pack(">d", x))


def laced(frames: list[bytes], kind: int) -> bytes:
    """Frame sizes as the kind of lacing has them, then the frames."""
    sizes = [len(f) for f in frames]
    if kind == NO_LACING:
        if len(frames) != 1:
            raise ValueError("several frames need lacing")
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += (b - a + (1 << 7 * width - 1) - 1 | 1 << 7 * width).to_bytes(width, "big")
    elif len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return head + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], kind: int, key_frame: bool = True) -> bytes:
    """Body of a SimpleBlock."""
    return vint(track) + struct.pack(">hB", relative, (0x80 if key_frame else 0) | kind << 1) + laced(frames, kind)


def write_audio(payload: bytes) -> bytes:
    """One track of unsigned 8-bit samples; the payload is cut into packets of PACKET bytes."""
    head = element(EBML, number(VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ, 2))
    frames = [payload[k : k + PACKET] for k in range(0, len(payload), PACKET)]
    info = element(INFO, number(SCALE, 1_000_000) + real(DURATION, len(payload) * 1000 / SAMPLES) + element(MUXER, b"tessera") + element(WRITER, b"tessera"))
    audio = element(AUDIO, real(RATE, float(SAMPLES)) + number(CHANNELS, 1) + number(DEPTH, 8))
    entry = number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACES, 1) + element(CODEC, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, PACKET_MS * 1_000_000) + audio
    parts = [info, element(TRACKS, element(ENTRY, entry))]
    at = sum(map(len, parts))
    cues = []
    each = LACED * CLUSTERED
    for k in range(0, len(frames), each):
        body = [number(TIME, k * PACKET_MS)]
        for j in range(k, min(k + each, len(frames)), LACED):
            group = frames[j : min(j + LACED, k + each)]
            kind = NO_LACING if len(group) == 1 else FIXED if len(group[-1]) == PACKET else EBML_LACING
            body.append(element(SIMPLE, block(1, (j - k) * PACKET_MS, group, kind)))
        cues.append(element(POINT, number(CUE_TIME, k * PACKET_MS) + element(CUE_PLACES, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Packets:
    """A file's packet table as columns, and what else the features need."""

    track: list[int] = field(default_factory=list)
    timestamp_ns: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    key_frame: list[bool] = field(default_factory=list)
    cluster: list[int] = field(default_factory=list)
    clusters: int = 0
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, byte place of the cluster
    tracks: dict[int, dict] = field(default_factory=dict)
    duration_ms: float = 0.0

    def payload(self, media: bytes, track: int = 1) -> bytes:
        """The track's packets in order, from their byte ranges."""
        return b"".join([media[a : a + n] for t, a, n in zip(self.track, self.offset, self.size) if t == track])


class Reader:
    def __init__(self, media: bytes):
        self.media, self.out, self.scale = media, Packets(), 1_000_000

    def _vint(self, at: int, keep: bool = False) -> tuple[int, int]:
        """(value, next place); with ``keep`` the length marker stays, as in ids.  Unknown sizes are -1."""
        first = self.media[at]
        if not first:
            raise ValueError(f"no variable-length number at byte {at}")
        width = 9 - first.bit_length()
        n = int.from_bytes(self.media[at : at + width], "big")
        if at + width > len(self.media):
            raise ValueError("the file ends inside an element")
        if not keep:
            n -= 1 << 7 * width
            if n == (1 << 7 * width) - 1:
                n = -1
        return n, at + width

    def _children(self, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
        """(id, begin of the element, begin and end of its body); an unknown size reaches up to the parent's next child of the same rank."""
        while at < end:
            begin = at
            key, at = self._vint(at, keep=True)
            size, at = self._vint(at)
            stop = end if size < 0 and key == SEGMENT else self._unknown_end(at, end) if size < 0 else at + size
            if stop > end:
                raise ValueError("an element reaches beyond its parent")
            yield key, begin, at, stop
            at = stop

    def _unknown_end(self, at: int, end: int) -> int:
        """A cluster of unknown size ends where the next element of the segment begins."""
        while at < end:
            key, body = self._vint(at, keep=True)
            if key in (CLUSTER, CUES, INFO, TRACKS):
                return at
            size, body = self._vint(body)
            at = body + size
        return end

    def _int(self, a: int, b: int) -> int:
        return int.from_bytes(self.media[a:b], "big")

    def _float(self, a: int, b: int) -> float:
        return struct.unpack(">d" if b - a == 8 else ">f", self.media[a:b])[0] if b > a else 0.0

    def read(self) -> Packets:
        for key, _, a, b in self._children(0, len(self.media)):
            if key == SEGMENT:
                self._segment(a, b)
        return self.out

    def _segment(self, start: int, end: int) -> None:
        for key, begin, a, b in self._children(start, end):
            if key == INFO:
                for k, _, x, y in self._children(a, b):
                    if k == SCALE:
                        self.scale = self._int(x, y)
                    elif k == DURATION:
                        self.out.duration_ms = self._float(x, y) * self.scale / 1e6
            elif key == TRACKS:
                for k, _, x, y in self._children(a, b):
                    if k == ENTRY:
                        self._track(x, y)
            elif key == CLUSTER:
                self._cluster(a, b)
            elif key == CUES:
                for k, _, x, y in self._children(a, b):
                    if k == POINT:
                        self._cue(x, y, start)

    def _track(self, a: int, b: int) -> None:
        entry: dict = {"rate": 8000.0, "channels": 1, "depth": None, "codec": "", "kind": 0, "frame_ns": 0}
        n = 0
        for k, _, x, y in self._children(a, b):
            if k == NUMBER:
                n = self._int(x, y)
            elif k == CODEC:
                entry["codec"] = self.media[x:y].rstrip(b"\0").decode("ascii", "replace")
            elif k == KIND:
                entry["kind"] = self._int(x, y)
            elif k == DEFAULT_DURATION:
                entry["frame_ns"] = self._int(x, y)
            elif k == AUDIO:
                for j, _, p, q in self._children(x, y):
                    if j == RATE:
                        entry["rate"] = self._float(p, q)
                    elif j == CHANNELS:
                        entry["channels"] = self._int(p, q)
                    elif j == DEPTH:
                        entry["depth"] = self._int(p, q)
        self.out.tracks[n] = entry

    def _cue(self, a: int, b: int, base: int) -> None:
        time, places = 0, []
        for k, _, x, y in self._children(a, b):
            if k == CUE_TIME:
                time = self._int(x, y)
            elif k == CUE_PLACES:
                found = {j: self._int(p, q) for j, _, p, q in self._children(x, y)}
                places.append((found.get(CUE_TRACK, 0), base + found.get(CUE_CLUSTER, 0)))
        self.out.cues += [(time * self.scale, track, place) for track, place in places]

    def _cluster(self, a: int, b: int) -> None:
        time = 0
        for k, _, x, y in self._children(a, b):
            if k == TIME:
                time = self._int(x, y)
            elif k == SIMPLE:
                self._block(x, y, time, None)
            elif k == GROUP:
                inner = {j: (p, q) for j, _, p, q in self._children(x, y)}
                if BLOCK in inner:
                    self._block(*inner[BLOCK], time, REFERENCE not in inner)
        self.out.clusters += 1

    def _block(self, a: int, b: int, time: int, key_frame: bool | None) -> None:
        track, at = self._vint(a)
        relative, flags = struct.unpack_from(">hB", self.media, at)
        at += 3
        kind, sizes = flags >> 1 & 3, []
        if kind != NO_LACING:
            n, at = self.media[at] + 1, at + 1
            if kind == XIPH:
                for _ in range(n - 1):
                    size = 0
                    while self.media[at] == 255:
                        size, at = size + 255, at + 1
                    sizes.append(size + self.media[at])
                    at += 1
            elif kind == EBML_LACING and n > 1:
                size, at = self._vint(at)
                sizes.append(size)
                for _ in range(n - 2):
                    begin = at
                    step, at = self._vint(at)
                    width = at - begin
                    if step < 0:  # all ones is an ordinary value here
                        step = (1 << 7 * width) - 1
                    size += step - ((1 << 7 * width - 1) - 1)
                    sizes.append(size)
            elif kind == FIXED:
                sizes = [(b - at) // n] * (n - 1)
        sizes.append(b - at - sum(sizes))
        if min(sizes) < 0:
            raise ValueError("laced frames reach beyond their block")
        out, frame_ns = self.out, self.out.tracks.get(track, {}).get("frame_ns", 0)
        begin = (time + relative) * self.scale
        n = len(sizes)
        out.track += [track] * n
        out.timestamp_ns += [begin + k * frame_ns for k in range(n)]
        out.offset += [at, *(at + np.cumsum(sizes[:-1])).tolist()] if n > 1 else [at]
        out.size += sizes
        out.key_frame += [bool(flags & 0x80) if key_frame is None else key_frame] * n
        out.cluster += [out.clusters] * n


def padded(body: bytes) -> bytes:
    """The text with spaces after it, up to a positive multiple of PACKET bytes."""
    return body + b" " * (-len(body) % PACKET if body else PACKET)


_PACKETS = pa.schema([("id", pa.int64()), ("packet", pa.int64()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("offset", pa.int64()), ("size", pa.int64()), ("key_frame", pa.bool_()), ("cluster", pa.int64())])


def packet_table(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """id, packet, track, timestamp_ns, offset, size, key_frame, cluster: a row for each packet of each file.

    A null or empty file has no packets; a file cut off inside an element is an
    error that names its id.  Other columns are ignored, repeated rows repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column("id").to_pylist(), batch.column("media").to_pylist()):
                if not body:
                    continue
                try:
                    p = Reader(body).read()
                except (ValueError, IndexError, struct.error) as e:
                    raise ValueError(f"file {key}: {e}") from e
                columns = [[key] * len(p.track), range(len(p.track)), p.track, p.timestamp_ns, p.offset, p.size, p.key_frame, p.cluster]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKETS)], schema=_PACKETS)

    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).cast("binary").alias("media"))
    return rows.mapInArrow(run, "id long, packet long, track int, timestamp_ns long, offset long, size long, key_frame boolean, cluster long")


def feature(packets: Packets, payload: bytes) -> str:
    """Counts of packets, clusters and cues, milliseconds, mean and largest sample."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    last = (packets.timestamp_ns[-1] if packets.timestamp_ns else 0) // 1_000_000
    return f"packets={len(packets.size)};clusters={packets.clusters};cues={len(packets.cues)};ms={packets.duration_ms:.0f};last={last};mean={samples.mean():.3f};peak={samples.max()}"


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def store_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Each text as a Matroska file, and what reading the file gives: a row for each row.

    A null text is empty; its payload is one packet of spaces.  ``keep_media``
    adds the file itself as ``media``.
    """
    schema = _OUT.append(pa.field("media", pa.binary())) if keep_media else _OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body in batch.column("body"):
                body = body.as_py()
                media = write_audio(padded(body))
                packets = Reader(media).read()
                payload = packets.payload(media)
                row = (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(packets, payload))
                rows.append((*row, media) if keep_media else row)
            columns = list(zip(*rows)) or [[]] * (len(schema) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("body"))
    spec = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return rows.mapInArrow(run, spec + ", media binary" * keep_media)


def op6_matroska(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for all of ``documents``."""
    return store_and_read(table(spark, sf_dir, "documents"))
