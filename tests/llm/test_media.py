import hashlib
import random
import zlib

import pytest

from lumenfold.llm import media
from lumenfold.llm.queries import op9_media


@pytest.mark.parametrize("n", [0, 1, 63, 157, 158, 159, 160, 161, 162, 163, 170, 184, 185, 300, 16_319, 16_320, 16_321, 100_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    stream = media.demux(media.mux(data))
    assert stream.payload() == data and len(media.mux(data)) % 188 == 0
    assert stream.continuity_errors == stream.left_out == stream.table_errors == stream.skipped_bytes == 0
    if n:
        assert stream.programs == {1: media.PMT_PID} and stream.streams == {media.DATA_PID: media.PRIVATE_DATA}
        assert [u.pts for u in stream.units] == [i * media.UNIT_TICKS for i in range(len(stream.units))]
        assert [u.random_access for u in stream.units] == [i % 4 == 0 for i in range(len(stream.units))]
        assert stream.clock == [u.pts * 300 for u in stream.units if u.random_access]


def test_crc():
    assert media.crc32_mpeg(b"123456789") == 0x0376E6E7


def packets(data):
    return [data[i : i + 188] for i in range(0, len(data), 188)]


def test_faults():
    ts = packets(media.mux(bytes(range(256)) * 200))
    assert media.demux(b"junk!" + b"".join(ts)).skipped_bytes == 5 and media.demux(b"junk!" + b"".join(ts)).payload() == bytes(range(256)) * 200
    lost = media.demux(b"".join(ts[:10] + ts[11:]))
    assert lost.continuity_errors == 1 and len(lost.units) == len(media.demux(b"".join(ts)).units) - 1
    twice = media.demux(b"".join(ts[:10] + ts[9:]))
    assert twice.continuity_errors == 0 and twice.payload() == bytes(range(256)) * 200
    bad = bytearray(ts[0])
    bad[10] ^= 1
    assert media.demux(bytes(bad) + b"".join(ts[1:])).table_errors == 1
    other = bytearray(ts[5])
    other[1], other[2] = 0x1F, 0xFF
    assert media.demux(b"".join(ts[:5]) + bytes(other) + b"".join(ts[5:])).payload() == bytes(range(256)) * 200
    assert media.demux(b"".join(ts)[:-50]).units == media.demux(b"".join(ts)).units[:-1]
    for source in (None, b"", b"x", b"\x47" * 400, random.Random(1).randbytes(5000)):
        media.demux(source)


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_media(spark, sf).collect():
        raw = texts[r.doc_id].encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.mux(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-64:]) and r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        assert "continuity_errors=0" in r.feature and f"crc32={zlib.crc32(padded):08x}" in r.feature


def test_features_tell_texts_of_one_length_apart():
    a, b, c = (media.feature(media.demux(media.mux(media.padded(t)))) for t in ("abcd" * 9000, "abdc" * 9000, "abcd" * 9000))
    assert a == c != b and media.feature(media.demux(None)).startswith("programs=0")


def test_frames(spark):
    rows = spark.createDataFrame([(1, None, 3), (None, "", 3), (2, "x" * 60_000, 3), (2, "x" * 60_000, 3)], "doc_id long, text string, s int")
    out = media.store_texts(rows).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in out) == [(0, 64), (0, 64), (60_000, 60_032), (60_000, 60_032)]
    assert media.store_texts(rows.limit(0)).count() == 0
    files = spark.createDataFrame([(1, bytearray(media.mux(b"a" * 40_000))), (2, None)], "media_id long, content binary")
    index = media.index_streams(files).orderBy("unit_no").collect()
    assert [(r.media_id, r.pts, r.random_access, r.n_bytes) for r in index] == [(1, 0, True, 16_320), (1, 3600, False, 16_320), (1, 7200, False, 7360)]
