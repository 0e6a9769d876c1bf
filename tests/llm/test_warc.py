import io
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from docparity.llm import warc

REC = warc.record_of(1, "http://a.b/c", "<p>x")


def read(data):
    return list(warc.read_records("f", io.BytesIO(data)))


def frame(data, **kw):
    return zstandard.ZstdCompressor(**kw).compress(data)


def test_archive_with_dictionary():
    recs = [warc.record_of(i, f"http://a.b/{i}", f"<p>text number {i} and more of it" * 20) for i in range(400)]
    data = b"".join(warc.archive(iter(recs)))
    assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_MAGIC
    got = read(data)
    assert len(got) == 400 and all(r["error"] is None for r in got) and got[7]["payload"] == (b"<p>text number 7 and more of it" * 20) and got[7]["http_status"] == 200
    ends = [r["frame_offset"] + r["frame_bytes"] for r in got]
    assert ends[-1] == len(data) and ends[:-1] == [r["frame_offset"] for r in got[1:]]
    small = list(warc.frames(io.BytesIO(data), step=7))
    assert [(o, len(f)) for o, n, f, s in small if not s and n == len(f)] == [(r["frame_offset"], r["frame_bytes"]) for r in got]


@pytest.mark.parametrize("head", [b"", (0x184D2A50).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"])
def test_archive_without_dictionary(head):
    assert [r["error"] for r in read(head + frame(REC) + frame(REC))] == [None, None]


def test_plain_dictionary():
    d = zstandard.ZstdCompressionDict(REC * 3, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    raw = d.as_bytes()
    data = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw + frame(REC, dict_data=d)
    assert read(data)[0]["payload"] == b"<p>x"


@pytest.mark.parametrize(
    ("data", "error"),
    [
        (REC.replace(b"WARC/1.1", b"WARK/1.1"), "no WARC version"), (REC.replace(b"Content-Length: ", b"Content-Length: 9"), "bytes of content"), (REC.replace(b"WARC-Date", b"WARC-Data"), "missing WARC-Date"),
        (REC + REC, "more than one record"), (REC.replace(b"<p>x", b"<p>y"), "digest"), (REC.replace(b"Content-Length: ", b"Content-Length: x"), "no number"), (REC[:-4], "bytes of content"),
        (REC.replace(b"HTTP/1.1 200", b"HTTP/1.1 abc").replace(b"WARC-Block-Digest", b"X"), "no HTTP"), (b"", "no WARC version"), (b"WARC/1.0\r\n", "header without end"), (REC.replace(b"WARC-Type:", b":"), "without a name"),
    ],
)
def test_broken_records(data, error):
    got = read(frame(REC) + frame(data) + frame(REC))
    assert got[0]["error"] is None and error in got[1]["error"] and got[1].get("payload") is None and got[2]["error"] is None


def test_broken_frames():
    whole = frame(REC, write_checksum=True)
    spoilt = bytearray(whole)
    spoilt[-6] ^= 255
    got = read(bytes(spoilt) + whole)
    assert "decode" in got[0]["error"] and got[1]["error"] is None
    cut = read(whole + whole[:-3])
    assert cut[0]["error"] is None and "ends within" in cut[1]["error"]
    assert "no Zstandard frame" in read(whole + b"junk that is no frame")[1]["error"]
    assert read(b"") == []


@pytest.mark.parametrize("declared", [True, False])
def test_records_over_the_limit(declared):
    noise = random.Random(0).randbytes(400_000)
    large = [warc.record_of(2, "http://a.b/2", "x" * 200_000), REC.replace(b"<p>x", noise)]
    data = b"".join(frame(r, write_content_size=declared) for r in (REC, *large, REC))
    skipped = (0x184D2A51).to_bytes(4, "little") + len(noise).to_bytes(4, "little") + noise
    for step in (1 << 10, 1 << 20):
        assert [n for _, n, f, _ in warc.frames(io.BytesIO(skipped + data), step, 1000) if f is None] == [len(noise) + 8, len(frame(large[1], write_content_size=declared))]
    got = list(warc.read_records("f", io.BytesIO(data), 100_000))
    assert [r["error"] for r in got] == [None, "record of more than 100000 bytes", "record of more than 100000 bytes", None] and got[3]["payload"] == b"<p>x"
    assert [r["frame_offset"] + r["frame_bytes"] for r in got][:-1] == [r["frame_offset"] for r in got][1:]
    assert "ends within" in list(warc.read_records("f", io.BytesIO(data[:-90_000]), 1000))[-1]["error"]


def test_folded_and_repeated_headers():
    r = warc.parse_record(b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nWARC-Date: d\r\nX: 1\r\n  2\r\nx: 3\r\nContent-Length: 2\r\n\r\nab\r\n\r\n")
    assert r["error"] is None and r["payload"] == b"ab" and dict(r["headers"])["X"] == "1 2"


def test_round_trip(spark):
    rows = [(1, "http://a", "<p>é"), (2, None, "x"), (3, "u", None), (None, "u", ""), (3, "u", None), (4, "", "\r\n\r\n"), (6, " http://a b\r\nX: y\t", "z"), (7, "\n", ""), (5, "v", "long " * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = [tuple(r) for r in warc.round_trip(spark, pages).collect()]
    assert sorted(got, key=str) == sorted(rows, key=str)
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def test_null_paths(spark, tmp_path):
    path = tmp_path / "a.warc.zst"
    path.write_bytes(b"".join(warc.archive(iter([REC]))))
    paths = spark.createDataFrame([(str(path),), (None,), (str(path),)], "path string")
    assert warc.read_warc_zst(paths).where(F.col("error").isNull()).count() == 2
