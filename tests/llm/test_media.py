import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import media, queries


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 64, b"y" * 65, bytes(range(256)) * 900])
def test_round_trip(text):
    payload = media.padded(text)
    stored = media.store(payload)
    (track,) = media.tracks(stored)
    assert media.payload_of(stored, track) == payload and payload.startswith(text) and len(payload) % 64 == 0
    assert (track.codec, track.duration, len(track.ranges)) == ("raw ", len(payload), len(payload) // 64)
    for k, (at, size) in enumerate(track.keyframes):
        assert stored[at : at + size] == payload[k * 16 * 64 :][:64]


def test_boxes_nest_and_cover():
    stored = media.store(media.padded(b"abc"))
    found = list(media.boxes(stored))
    assert [p for p, _, _ in found if len(p) == 1] == [(b"ftyp",), (b"moov",), (b"mdat",)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in [p for p, _, _ in found] and found[-1][2] == len(stored)


def test_tables_of_other_writers():
    """32-bit offsets, sizes of each sample, chunks of different lengths, no sync table: every sample is one."""
    box, full = media.box, media.full
    data = b"0123456789"
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"mp4a", bytes(28))), full(b"stsz", struct.pack(">II4I", 0, 4, 1, 2, 3, 4)), full(b"stsc", struct.pack(">I6I", 2, 1, 3, 1, 2, 1, 1)), full(b"stco", struct.pack(">I2I", 2, 8, 14)))
    stored = box(b"mdat", data) + box(b"moov", box(b"trak", box(b"mdia", full(b"mdhd", struct.pack(">4I", 0, 0, 1000, 77)), box(b"minf", stbl))))
    (track,) = media.tracks(stored)
    assert (track.codec, track.timescale, track.duration) == ("mp4a", 1000, 77)
    assert track.ranges == track.keyframes == [(8, 1), (9, 2), (11, 3), (14, 4)] and media.payload_of(stored, track) == data


@pytest.mark.parametrize("data", [b"", b"\0\0\0\4free", b"\0\0\1\0moov", bytes(40)])
def test_bytes_that_are_no_container(data):
    assert media.tracks(data) == []


def fragmented():
    """A movie without samples of its own and two fragments: sizes in the run, then defaults with one sync sample at the head."""
    box, full = media.box, media.full
    trex = box(b"mvex", full(b"trex", struct.pack(">5I", 1, 1, 10, 4, 0x10000)))
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(70))), full(b"stsz", bytes(8)))
    trak = box(b"trak", full(b"tkhd", struct.pack(">3I", 0, 0, 1)), box(b"mdia", full(b"mdhd", struct.pack(">4I", 0, 0, 90, 0)), box(b"minf", stbl)))
    head = box(b"moov", trex, trak)

    def moof(run):
        return box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 1), flags=0x20000), run))

    one = lambda at: full(b"trun", struct.pack(">Ii4I", 2, at, 5, 3, 7, 2), flags=0x301)
    two = lambda at: full(b"trun", struct.pack(">IiI", 3, at, 0), flags=0x5)
    parts, ranges, at = [head], [], len(head)
    for run, data in ((one, b"abcde"), (two, b"0123456789AB")):
        size = len(moof(run(0)))
        parts += [moof(run(size + 8)), box(b"mdat", data)]
        sizes = [3, 2] if run is one else [4, 4, 4]
        ranges += [(at + size + 8 + sum(sizes[:k]), n) for k, n in enumerate(sizes)]
        at += size + 8 + len(data)
    return b"".join(parts), ranges


def test_fragments():
    stored, ranges = fragmented()
    (track,) = media.tracks(stored)
    assert track.ranges == ranges and media.payload_of(stored, track) == b"abcde0123456789AB"
    assert track.keyframes == [ranges[2]] and (track.codec, track.timescale, track.duration) == ("avc1", 90, 5 + 7 + 30)


def test_malformed_containers():
    box, full = media.box, media.full
    bare = lambda *tables: box(b"moov", box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", box(b"stsd"), *tables)))))
    deep = b""
    for _ in range(5000):
        deep = box(b"moov", deep)
    assert media.tracks(deep) == [] and sum(1 for _ in media.boxes(deep)) == 5000
    for stored in (bare(box(b"mdhd")), bare(full(b"mdhd", version=1)), bare(box(b"stsz"), box(b"stco"), box(b"stsc"), box(b"stss"))):
        (track,) = media.tracks(stored)
        assert (track.codec, track.ranges, track.keyframes, track.duration) == ("", [], [], 0)
    # Counts that claim more than there is, and samples outside the bytes.
    claims = bare(full(b"stsz", struct.pack(">II", 1, 0xFFFFFFFF)), full(b"stsc", struct.pack(">4I", 0xFFFFFFFF, 1, 0xFFFFFFFF, 1)), full(b"stco", struct.pack(">2I", 0xFFFFFFFF, 0)))
    (track,) = media.tracks(claims)
    assert len(track.ranges) == len(claims)
    (track,) = media.tracks(bare(full(b"stsz", struct.pack(">II", 64, 9)), full(b"stsc", struct.pack(">4I", 1, 1, 9, 1)), full(b"co64", struct.pack(">IQ", 1, 1 << 60)), full(b"stss", struct.pack(">2I", 5, 3))))
    assert track.ranges == track.keyframes == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 255)), max_size=20), st.integers(0, 5000), st.booleans())
def test_damaged_containers_end(changes, cut, plain):
    stored = bytearray(media.store(media.padded(b"x" * 3000)) if plain else fragmented()[0])
    for at, value in changes:
        stored[at % len(stored)] = value
    for track in media.tracks(bytes(stored[: max(cut, len(stored) // 2)])):
        assert all(0 <= a and a + n <= len(stored) for a, n in track.ranges + track.keyframes)


def test_query(spark):
    texts = ["", "a", "é" * 100, "é" * 100]
    found = {r.doc_id: r for r in media.store_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        payload = media.padded(text.encode())
        r = found[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert found[2].media == found[3].media


def test_query_gives_every_keyframe_range(spark, tmp_path):
    text = "a line of text, again and again. " * 200
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    (row,) = queries.op7_media(spark, str(tmp_path)).collect()
    (track,) = media.tracks(media.store(media.padded(text.encode())))
    assert [tuple(x) for x in row.keyframes] == track.keyframes and len(track.keyframes) == 7
