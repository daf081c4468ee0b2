"""Archives of other writers, and what happens beyond the bounds of a broadcast."""

import gzip
import zlib

import pytest

from jobstrata.llm import decontam, warc

from . import brute
from .helpers import differences, documents


def record(kind, rid, block, *more):
    head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <" + rid + b">", *more, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


PAGE = b"<p>caf\xc3\xa9</p>" * 9
HTTP = b"Content-Type: application/http; msgtype=response"
FOREIGN = [
    record(b"warcinfo", b"urn:uuid:a", b"software: x\r\n", b"Content-Type: application/warc-fields"),
    record(b"response", b"urn:uuid:b", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + PAGE, HTTP, b"WARC-Target-URI: http://h/1", b"WARC-Payload-Digest: sha1:ABC"),
    record(b"response", b"urn:uuid:7", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-encoding:gzip\r\n\r\n" + b"%x;q\r\n" % len(z := gzip.compress(PAGE)) + z + b"\r\n0\r\n\r\n", HTTP, b"X-Long: a", b"  folded"),
    record(b"response", b"urn:uuid:d", b"HTTP/1.1 200 OK\r\nContent-Encoding: deflate\r\n\r\n" + zlib.compress(PAGE), HTTP),
    record(b"revisit", b"urn:uuid:e", b"", HTTP, b"WARC-Refers-To: <urn:uuid:b>"),
    record(b"resource", b"urn:uuid:f", b"a\r\n\r\nb", b"Content-Type: text/plain"),
]
WANT = [("warcinfo", b"software: x\r\n"), ("response", PAGE), ("response", PAGE), ("response", PAGE), ("revisit", None), ("resource", b"a\r\n\r\nb")]


@pytest.mark.parametrize(("name", "data"), [("a.warc", b"".join(FOREIGN)), ("b.warc.gz", b"".join(map(gzip.compress, FOREIGN))), ("c.warc.gz", gzip.compress(b"".join(FOREIGN)))])
def test_archives_of_other_writers(spark, tmp_path, name, data):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / name).write_bytes(data)
    (tmp_path / "note.txt").write_bytes(b"no archive")
    for path in (tmp_path, tmp_path / "deep" / name):
        got = warc.read(spark, str(path)).collect()
        assert [(r["record_type"], r["payload"] and bytes(r["payload"])) for r in got] == WANT
        assert [r["record_id"] for r in got] == [f"urn:uuid:{x}" for x in "ab7def"]
        assert {r["page_id"] for r in got} == {None} and got[4]["refers_to_id"] == "urn:uuid:b" and got[1]["payload_digest"] == "sha1:ABC"
    some = warc.read(spark, str(tmp_path), payload=False).where("record_type = 'response' AND record_id = 'urn:uuid:d'").collect()
    assert [(r["record_id"], r["payload"]) for r in some] == [("urn:uuid:d", None)]


@pytest.mark.parametrize("kept", [5, 60, -1, -3, -9])
@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("payload", [False, True])
def test_cut_archives_are_errors(tmp_path, kept, packed, payload):
    import io

    data = b"".join(FOREIGN[:2])[:kept]
    stream = gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data))) if packed else io.BytesIO(data)
    with pytest.raises((EOFError, ValueError)):
        list(warc.records(stream, None if packed else len(data), lambda r: True, payload))


def test_bytes_that_are_no_record_are_an_error():
    import io

    data = FOREIGN[0] + b"junk\r\n" + FOREIGN[1]
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data), len(data), lambda r: True, True))


def test_frequent_pages_beyond_the_bound(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", 0)
    rows = [(i, "x" * 120 if i % 3 else f"page {i} " + "y" * (i % 200)) for i in range(300)] + [(-1, None), (-2, "")]
    df = spark.createDataFrame([(i, "u", t, 1) for i, t in rows], "page_id long, url string, html string, first int").repartition(4)
    assert not differences(warc.digest(warc.read(spark, warc.archived(df))), brute.archived(rows))


@pytest.mark.parametrize("limit", [decontam.BROADCAST_WINDOWS, 0])
def test_windows_by_hash_alone(spark, sf, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_KEYS", 0)
    rows, df = documents(spark, sf)
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()] + [(1000, "the of"), (1001, None), (1002, "The, OF"), (None, "!!")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert not differences(decontam.judged(df, bench, limit=limit), brute.leaked(rows, items))
