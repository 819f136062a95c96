"""Operator 4: media columns in Matroska containers.

``encode`` stores each text as an 8-bit mono PCM track: the UTF-8 bytes, padded with 255 to whole frames, go into laced
blocks of clusters with a cue index.  ``packets`` and ``cues`` parse any such column into relational tables (timestamps,
tracks, byte ranges), and ``read_back`` checks and summarises the stored form.  The parser handles unknown-size segments
and clusters, plain and grouped blocks, all four lacing modes and elements that it does not know.

Defined cases: null counts as empty; an empty text gives one frame of padding; a truncated or foreign blob gives the
packets that are complete (none if it has no EBML header); ids may repeat or be null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the Matroska and EBML specifications (element ids).
EBML, EBML_VERSION, EBML_READ_VERSION, MAX_ID_LENGTH, MAX_SIZE_LENGTH = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C
DEFAULT_DURATION, CODEC_ID, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACE, XIPH_LACE, FIXED_LACE, EBML_LACE = 0, 1, 2, 3
LACES = {"none": NO_LACE, "xiph": XIPH_LACE, "fixed": FIXED_LACE, "ebml": EBML_LACE}

FRAME, RATE = 576, 8000  #: bytes (samples) of a frame; samples a second
BLOCK_FRAMES, CLUSTER_BLOCKS = 64, 4  #: frames laced into a block; blocks of a cluster
SCALE_NS = 1_000_000  #: nanoseconds of a timestamp tick
FRAME_TICKS = FRAME * 1000 // RATE

FLUSH_BYTES = 16 << 20  #: media bytes after which a batch is handed back to Spark


def id_bytes(element: int) -> bytes:
    return element.to_bytes((element.bit_length() + 7) // 8, "big")


def size_bytes(n: int, width: int = 0) -> bytes:
    """Variable-length size; all ones are reserved for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return id_bytes(kind) + size_bytes(len(body)) + body


def uint(kind: int, n: int) -> bytes:
    return element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(kind: int, x: float) -> bytes:
    return element(kind, struct.pack(">d", x))


def text(kind: int, s: str) -> bytes:
    return element(kind, s.encode())


def lace_header(frames: list[bytes], lace: int) -> bytes:
    """Frame count and sizes that precede laced frames; the last size follows from the block's."""
    sizes = [len(f) for f in frames]
    if lace == NO_LACE:
        return b""
    head = bytes([len(frames) - 1])
    if lace == XIPH_LACE:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lace == EBML_LACE and len(sizes) > 1:
        head += size_bytes(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
            head += size_bytes(n - before + (1 << 7 * width - 1) - 1, width)
    return head


def pad(data: bytes, frame: int = FRAME) -> bytes:
    """``data`` followed by bytes 255 up to a positive multiple of ``frame``."""
    return data + b"\xff" * (-len(data) % frame if data else frame)


def mux(payload: bytes, lace: str = "fixed", frame: int = FRAME, block_frames: int = BLOCK_FRAMES) -> bytes:
    """A Matroska file with ``payload`` as an unsigned 8-bit PCM track; equal payloads give equal files."""
    mode, ticks = LACES[lace], frame * 1000 // RATE
    step = 1 if mode == NO_LACE else block_frames
    n = -(-len(payload) // frame)
    header = element(
        EBML, uint(EBML_VERSION, 1), uint(EBML_READ_VERSION, 1), uint(MAX_ID_LENGTH, 4), uint(MAX_SIZE_LENGTH, 8),
        text(DOC_TYPE, "matroska"), uint(DOC_TYPE_VERSION, 4), uint(DOC_TYPE_READ_VERSION, 2),
    )
    info = element(
        INFO, uint(TIMESTAMP_SCALE, SCALE_NS), real(DURATION, float(n * ticks)), text(MUXING_APP, "spindle"), text(WRITING_APP, "spindle")
    )
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, float(RATE)), uint(CHANNELS, 1), uint(BIT_DEPTH, 8))
    track = element(
        TRACK_ENTRY, uint(TRACK_NUMBER, 1), uint(TRACK_UID, 1), uint(TRACK_TYPE, 2), uint(FLAG_LACING, int(mode != NO_LACE)),
        uint(DEFAULT_DURATION, ticks * SCALE_NS), text(CODEC_ID, "A_PCM/INT/LIT"), audio,
    )
    parts, points, at = [info, element(TRACKS, track)], [], 0
    at = sum(map(len, parts))
    per_cluster = min(step * CLUSTER_BLOCKS if mode != NO_LACE else block_frames * CLUSTER_BLOCKS, 32767 // ticks)
    for first in range(0, n, per_cluster):
        blocks = [uint(TIMESTAMP, first * ticks)]
        for k in range(first, min(first + per_cluster, n), step):
            last = min(k + step, first + per_cluster, n)
            data = payload[k * frame : last * frame]
            sizes_known = mode in (NO_LACE, FIXED_LACE)
            frames = [] if sizes_known else [data[i : i + frame] for i in range(0, len(data), frame)]
            lead = (b"" if mode == NO_LACE else bytes([last - k - 1])) if sizes_known else lace_header(frames, mode)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", (k - first) * ticks, 0x80 | mode << 1) + lead, data))
        points.append(element(CUE_POINT, uint(CUE_TIME, first * ticks), element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1), uint(CUE_CLUSTER_POSITION, at))))
        parts.append(element(CLUSTER, *blocks))
        at += len(parts[-1])
    return header + element(SEGMENT, *parts, element(CUES, *points))


def read_id(data: bytes, at: int) -> tuple[int, int]:
    width = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + width], "big"), at + width


def read_size(data: bytes, at: int) -> tuple[int, int]:
    """The value and the place after it; -1 stands for an unknown size."""
    width = 9 - data[at].bit_length()
    n = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (-1 if n == (1 << 7 * width) - 1 else n), at + width


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """``(id, start, end)`` of the bodies of the elements in a range; what is cut short or malformed ends the walk."""
    while at < end and data[at]:
        kind, at = read_id(data, at)
        if at >= end or not data[at]:
            return
        n, at = read_size(data, at)
        stop = min(end, at + n) if n >= 0 else end
        if n >= 0 and at + n > end and kind not in (SEGMENT, CLUSTER):
            return
        if n < 0 and kind == CLUSTER:  # ends where the next top-level element starts
            stop = at
            for sub, _, sub_end in children(data, at, end):
                if sub in (CLUSTER, CUES, TRACKS, INFO):
                    break
                stop = sub_end
        yield kind, at, stop
        at = stop


def number(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def frame_sizes(data: bytes, at: int, end: int, lace: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and where the first one starts."""
    if lace == NO_LACE:
        return [end - at], at
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lace == FIXED_LACE:
        return [(end - at) // count] * count, at
    if lace == XIPH_LACE:
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    elif count > 1:
        n, at = read_size(data, at)
        sizes.append(n)
        for _ in range(count - 2):
            width = 9 - data[at].bit_length()
            raw = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
            at += width
    return [*sizes, end - at - sum(sizes)], at


class Container:
    """What one Matroska blob holds: tracks, packets, cues, clusters and the declared duration."""

    def __init__(self, data: bytes):
        self.tracks: dict[int, tuple[str, int]] = {}  # number: codec, nanoseconds of a frame
        self.packets: list[tuple[int, int, int, int, bool, int, int]] = []  # track, ns, offset, size, key frame, lacing, cluster
        self.cues: list[tuple[int, int, int]] = []  # track, ns, offset of the cluster in the file
        self.clusters, self.scale, self.duration_ns = 0, SCALE_NS, 0
        self.data = data
        try:
            top = list(children(data, 0, len(data)))
            if top and top[0][0] == EBML:
                for kind, start, end in top:
                    if kind == SEGMENT:
                        self._segment(start, end)
        except IndexError:  # the blob ends inside a header: what came before it stands
            pass

    def _segment(self, start: int, end: int) -> None:
        data = self.data
        for kind, a, b in children(data, start, end):
            if kind == INFO:
                found = {k: (x, y) for k, x, y in children(data, a, b)}
                self.scale = number(data, *found[TIMESTAMP_SCALE]) if TIMESTAMP_SCALE in found else SCALE_NS
                if DURATION in found:
                    x, y = found[DURATION]
                    self.duration_ns = int(struct.unpack(">d" if y - x == 8 else ">f", data[x:y])[0] * self.scale)
            elif kind == TRACKS:
                for sub, x, y in children(data, a, b):
                    if sub == TRACK_ENTRY:
                        found = {k: (s, e) for k, s, e in children(data, x, y)}
                        codec = data[slice(*found[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in found else ""
                        self.tracks[number(data, *found[TRACK_NUMBER])] = codec, number(data, *found.get(DEFAULT_DURATION, (0, 0)))
            elif kind == CLUSTER:
                self._cluster(a, b)
            elif kind == CUES:
                for _, x, y in children(data, a, b):
                    point = {k: (s, e) for k, s, e in children(data, x, y)}
                    place = {k: (s, e) for k, s, e in children(data, *point[CUE_TRACK_POSITIONS])}
                    when = number(data, *point[CUE_TIME]) * self.scale
                    self.cues.append((number(data, *place[CUE_TRACK]), when, start + number(data, *place[CUE_CLUSTER_POSITION])))

    def _cluster(self, start: int, end: int) -> None:
        data, base = self.data, 0
        for kind, a, b in children(data, start, end):
            if kind == TIMESTAMP:
                base = number(data, a, b)
            elif kind == SIMPLE_BLOCK:
                self._block(a, b, base)
            elif kind == BLOCK_GROUP:
                for sub, x, y in children(data, a, b):
                    if sub == BLOCK:
                        self._block(x, y, base)
        self.clusters += 1

    def _block(self, start: int, end: int, base: int) -> None:
        track, at = read_size(self.data, start)
        offset, flags = struct.unpack(">hB", self.data[at : at + 3])
        lace = flags >> 1 & 3
        sizes, at = frame_sizes(self.data, at + 3, end, lace)
        step, ns = self.tracks.get(track, ("", 0))[1], (base + offset) * self.scale
        for n in sizes:
            self.packets.append((track, ns, at, n, bool(flags & 0x80), lace, self.clusters))
            at, ns = at + n, ns + step

    def payload(self, track: int = 1) -> bytes:
        return b"".join(self.data[p[2] : p[2] + p[3]] for p in self.packets if p[0] == track)


def feature(box: Container, payload: bytes) -> str:
    """Packet and sample statistics as text; integers only, so that equal payloads give equal strings on any machine."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    n = max(1, samples.size)
    total, square = int(samples.sum(dtype=np.int64)), int((samples.astype(np.int64) ** 2).sum())
    bins = np.bincount(samples >> 4, minlength=16)
    return (
        f"tracks={len(box.tracks)};packets={len(box.packets)};clusters={box.clusters};cues={len(box.cues)};duration_ns={box.duration_ns};"
        f"mean_milli={total * 1000 // n};power={square // n};histogram={','.join(map(str, bins))}"
    )


def in_batches(rows: Iterable[tuple[tuple, int]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows with their sizes as record batches of about ``FLUSH_BYTES``."""
    held: list[tuple] = []
    size = 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= FLUSH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text in its container."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    raw = (value.as_py() or "").encode()
                    media = mux(pad(raw))
                    yield (key, len(raw), media), len(media)

        yield from in_batches(rows(), schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )


def packets(media: DataFrame) -> DataFrame:
    """One row per packet of ``media``'s containers: timestamp, track and byte range in the blob."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("packet", pa.int32()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("byte_start", pa.int64()),
         ("byte_length", pa.int64()), ("keyframe", pa.bool_()), ("lacing", pa.int32()), ("cluster", pa.int32())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            ((key, i, *p), 256)
            for batch in batches
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            for i, p in enumerate(Container(blob.as_py() or b"").packets)
        )
        yield from in_batches(rows, schema)

    return media.select("doc_id", "media").mapInArrow(
        run, "doc_id long, packet int, track int, timestamp_ns long, byte_start long, byte_length long, keyframe boolean, lacing int, cluster int"
    )


def cues(media: DataFrame) -> DataFrame:
    """One row per cue point: track, time and where its cluster starts in the blob."""
    schema = pa.schema([("doc_id", pa.int64()), ("track", pa.int32()), ("timestamp_ns", pa.int64()), ("byte_start", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            ((key, *c), 64)
            for batch in batches
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
            for c in Container(blob.as_py() or b"").cues
        )
        yield from in_batches(rows, schema)

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, track int, timestamp_ns long, byte_start long")


def read_back(media: DataFrame) -> DataFrame:
    """Parse each container and describe what it holds: digests of the payload and of the file, and its features."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
         ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_packets", pa.int64())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[tuple, int]]:
            for batch in batches:
                for key, n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    blob = value.as_py() or b""
                    box = Container(blob)
                    payload = box.payload()
                    digest, whole = hashlib.sha256(payload).hexdigest(), hashlib.sha256(blob).hexdigest()
                    yield (key, n, len(payload), digest, zlib.crc32(payload[-32:]), len(blob), whole, feature(box, payload), len(box.packets)), 512

        yield from in_batches(rows(), schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "feature string, n_packets long",
    )
