"""Media columns: ISO media containers, walked box by box without decoding payloads.

A writer stores bytes losslessly as the samples of one audio track of unsigned 8-bit PCM; a reader walks nested boxes, decodes
the sample tables (sizes, chunks, offsets, times, sync samples), of the movie and of its fragments, and gives codec, duration and the byte
ranges of keyframes. A container can be anybody's: a table that is cut short gives the rows that it has, a sample that lies outside the
bytes, or is one too many for them, ends its table, and boxes nest as deep as they like without recursion. So time and memory are bounded by the container's size.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm import flat

SAMPLE_BYTES = 64
CHUNK_SAMPLES = 1024
SYNC_EVERY = 16
TIMESCALE = 8000
DEEPEST = 16
# Boxes of the container format that hold other boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def store(payload: bytes) -> bytes:
    """A container whose samples are the payload's bytes, SAMPLE_BYTES to a sample; the payload is a multiple of that."""
    samples, ticks = len(payload) // SAMPLE_BYTES, len(payload)
    chunks = -(-samples // CHUNK_SAMPLES)
    sync = range(1, samples + 1, SYNC_EVERY)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    last = samples - (chunks - 1) * CHUNK_SAMPLES
    layout = [(1, CHUNK_SAMPLES, 1), (chunks, last, 1)] if chunks > 1 and last != CHUNK_SAMPLES else [(1, min(samples, CHUNK_SAMPLES), 1)]
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16))

    def moov(first: int) -> bytes:
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, samples, SAMPLE_BYTES)),
            full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
            full(b"stsc", struct.pack(">I", len(layout)), *(struct.pack(">III", *x) for x in layout)),
            full(b"stsz", struct.pack(">II", SAMPLE_BYTES, samples)),
            full(b"co64", struct.pack(f">I{chunks}Q", chunks, *(first + k * CHUNK_SAMPLES * SAMPLE_BYTES for k in range(chunks)))),
        )
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1),
            full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"sound\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table),
        )
        track = full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3)
        movie = full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", movie, box(b"trak", track, media))

    first = len(head) + len(moov(0)) + 16
    return b"".join([head, moov(first), struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)), payload])


def boxes(data: memoryview | bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, body's start, body's end) of each box, nested ones after their container. A box whose size runs past its container ends the walk there. Of a path of more than DEEPEST kinds the last ones are given."""
    open_ = [(0, len(data), ())]
    while open_:
        start, end, path = open_.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            continue
        here = (*path, kind)[-DEEPEST:]
        yield here, body, start + size
        open_.append((start + size, end, path))
        if kind in CONTAINERS:
            open_.append((body, start + size, here))


@dataclass
class Track:
    """What the sample tables say; byte ranges are (offset, length) in the file."""

    codec: str = ""
    timescale: int = 0
    duration: int = 0
    ranges: list[tuple[int, int]] = field(default_factory=list)
    keyframes: list[tuple[int, int]] = field(default_factory=list)
    held: int = 0  # bytes of the ranges

    def adds(self, data, offset: int, size: int) -> bool:
        """Whether the sample can be there, and then adds it. An empty sample is no range; those of a track can't have more bytes than there are."""
        if size == 0 or offset < 0 or offset + size > len(data) or self.held + size > len(data):
            return False
        self.ranges.append((offset, size))
        self.held += size
        return True


def tracks(data: memoryview | bytes) -> list[Track]:
    """The tracks of a container, with their fragments' samples after the movie's own; bytes that aren't one give none."""
    found: list[dict] = []
    defaults: dict[int, tuple[int, ...]] = {}  # of each track's fragments: duration, size and flags of a sample
    fragments: list[tuple[int, tuple[int, int] | None, list[tuple[int, int]]]] = []  # where it begins, its header, its runs
    moof = 0
    for path, start, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif kind == b"trex":
            track, _, *rest = _fields(data, start + 4, end, ">5I")
            defaults[track] = tuple(rest)
        elif kind == b"moof":
            moof = start - 8
        elif kind == b"traf":
            fragments.append((moof, None, []))
        elif b"traf" in path and fragments:
            if kind == b"tfhd":
                fragments[-1] = (moof, (start, end), fragments[-1][2])
            elif kind == b"trun":
                fragments[-1][2].append((start, end))
        elif found and b"trak" in path:
            found[-1][kind] = (start, end)
    made = {}
    for n, at in enumerate(found, 1):
        if b"stsd" in at:
            start, end = at.get(b"tkhd", (0, 0))
            number = _fields(data, start + (20 if _version(data, start, end) == 1 else 12), end, ">I")[0]
            made[number or -n] = _track(data, at)
    for begin, header, runs in fragments:
        if header:
            _fragment(data, made, defaults, begin, header, runs)
    return list(made.values())


def _fields(data, at: int, end: int, layout: str) -> tuple[int, ...]:
    """The fields at a place; zeros where the box has not so many bytes."""
    size = struct.calcsize(layout)
    return struct.unpack_from(layout, data, at) if at + size <= end else struct.unpack(layout, bytes(size))


def _version(data, start: int, end: int) -> int:
    return data[start] if start < end else 0


def _numbers(data, place: tuple[int, int] | None, width: int, skip: int = 0, code: str = "I") -> Iterator[tuple[int, ...]]:
    """The rows of a table: a count after version and flags, then rows of so many numbers, as many as there are."""
    if place is None:
        return
    at = place[0] + 4 + skip
    (count,) = _fields(data, at, place[1], ">I")
    row = struct.Struct(f">{width}{code}")
    for k in range(min(count, max(0, place[1] - at - 4) // row.size)):
        yield row.unpack_from(data, at + 4 + k * row.size)


def _sizes(data, place: tuple[int, int] | None) -> Iterator[int]:
    """Sizes of the samples: one for all, or each; or in 4, 8 or 16 bits each."""
    if place is None:
        return
    same, count = _fields(data, place[0] + 4, place[1], ">II")
    yield from itertools.repeat(same, count) if same else (x for (x,) in _numbers(data, place, 1, 4))


def _chunks(data, at: dict) -> Iterator[tuple[int, int]]:
    """Offset and number of samples of each chunk."""
    offsets = itertools.chain(_numbers(data, at.get(b"co64"), 1, code="Q"), _numbers(data, at.get(b"stco"), 1) if b"co64" not in at else ())
    layout = _numbers(data, at.get(b"stsc"), 3)
    now, ahead = next(layout, None), next(layout, None)
    for chunk, (offset,) in enumerate(offsets, 1):
        while ahead and ahead[0] <= chunk:
            now, ahead = ahead, next(layout, None)
        yield offset, now[1] if now else 0


def _track(data, at: dict) -> Track:
    start, end = at[b"stsd"]
    out = Track(codec=bytes(data[start + 12 : min(end, start + 16)]).decode("latin-1"))
    start, end = at.get(b"mdhd", (0, 0))
    out.timescale, out.duration = _fields(data, start + 20, end, ">IQ") if _version(data, start, end) == 1 else _fields(data, start + 12, end, ">II")
    sizes = _sizes(data, at.get(b"stsz"))
    for offset, samples in _chunks(data, at):
        for size in itertools.islice(sizes, samples):
            if not out.adds(data, offset, size):
                return _with_keyframes(data, at, out)
            offset += size
    return _with_keyframes(data, at, out)


def _with_keyframes(data, at: dict, out: Track) -> Track:
    if b"stss" in at:
        out.keyframes = [out.ranges[k - 1] for (k,) in _numbers(data, at[b"stss"], 1) if 0 < k <= len(out.ranges)]
    else:
        out.keyframes = list(out.ranges)
    return out


def _fragment(data, made: dict[int, Track], defaults: dict, begin: int, header: tuple[int, int], runs: list[tuple[int, int]]) -> None:
    """Adds the samples of a track's fragment. What a run leaves out its header says, and else the movie's defaults."""
    flags, number = _fields(data, header[0], header[1], ">II")
    track = made.get(number)
    if track is None:
        return
    at, base = header[0] + 8, begin
    if flags & 1:
        (base,) = _fields(data, at, header[1], ">Q")
        at += 8
    at += 4 * bool(flags & 2)
    usual = list(defaults.get(number, (0, 0, 0)))
    for k, bit in enumerate((8, 16, 32)):
        if flags & bit:
            (usual[k],) = _fields(data, at, header[1], ">I")
            at += 4
    offset = base
    for start, end in runs:
        flags, count = _fields(data, start, end, ">II")
        at = start + 8
        if flags & 1:
            offset = base + _fields(data, at, end, ">i")[0]
            at += 4
        first = None
        if flags & 4:
            (first,) = _fields(data, at, end, ">I")
            at += 4
        fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        if fields:
            count = min(count, max(0, end - at) // (4 * len(fields)))
        for k in range(count):
            own = dict(zip(fields, _fields(data, at, end, f">{len(fields)}I"), strict=True))
            at += 4 * len(fields)
            size = own.get(0x200, usual[1])
            if not track.adds(data, offset, size):
                return
            track.duration += own.get(0x100, usual[0])
            if not own.get(0x400, first if k == 0 and first is not None else usual[2]) & 0x10000:  # a sample that others don't need as sync has this bit
                track.keyframes.append((offset, size))
            offset += size


def payload_of(data: bytes, track: Track) -> bytes:
    """The stored bytes, read back by the sample tables."""
    view, joined = memoryview(data), []
    for offset, size in track.ranges:
        if joined and joined[-1][1] == offset:
            joined[-1][1] += size
        else:
            joined.append([offset, offset + size])
    return b"".join(view[a:b] for a, b in joined)


def feature(track: Track) -> str:
    """What the tables say, in a line; all keyframe ranges by their digest."""
    keys = hashlib.sha256(",".join(f"{a}+{n}" for a, n in track.keyframes).encode()).hexdigest()[:32]
    return f"codec={track.codec.strip()};timescale={track.timescale};duration={track.duration};samples={len(track.ranges)};keyframes={len(track.keyframes)};ranges={keys}"


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % SAMPLE_BYTES if text else SAMPLE_BYTES)


def store_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", with_media: bool = True) -> DataFrame:
    """Stores each row's whole text as a media column and reads it back.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256 (read back), tail_crc32 (of the last 64 payload bytes), media_bytes,
    media_sha256, feature, codec, duration (ticks), keyframes (byte ranges as offset and length), and media unless with_media is
    False. A null text counts as empty, whose payload is 64 zero bytes. Repeated and null identifiers stay; other columns are
    dropped, so their names can't clash. Map only: no shuffle.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration", "keyframes", "media"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), ranges, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.flat(batch.column(1))
            held = data.tobytes()
            for low, high in flat.chunks(offsets):
                out: list[list] = [[] for _ in names]
                for a, b in zip(offsets[low:high], offsets[low + 1 : high + 1], strict=True):
                    media = store(padded(held[a:b]))
                    (track,) = tracks(media)
                    back = payload_of(media, track)
                    row = (b - a, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE_BYTES:]), len(media), hashlib.sha256(media).hexdigest(), feature(track), track.codec, track.duration, [{"offset": x, "length": n} for x, n in track.keyframes], media)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                columns = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)][: len(names) - (not with_media)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *columns], ["doc_id", *names[: len(columns)]])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration long, keyframes array<struct<offset: long, length: long>>"
    return rows.mapInArrow(run, schema + ", media binary" * with_media)
