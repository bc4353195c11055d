import base64
import gzip
import hashlib
import uuid

import pytest
from fixtures import edge_pages

from trigrove.llm import warc


def test_records_and_payloads_come_back(spark, tmp_path):
    rows = [(i, f"http://h/{i}", t) for i, t in enumerate(["a", "a", "x" * 100, "ñ" * 50, "x" * 100, None, "", "\r\n\r\nWARC/1.1\r\n\r\n" * 9, "x" * 100])]
    made = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    got = {r.page_id: r for r in warc.records(made).collect()}
    for i, url, t in rows:
        raw = (t or "").encode()
        first = min(j for j, _, u in rows if (u or "") == (t or ""))
        again = len(raw) >= 100 and first != i
        r = got[i]
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.url) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None, url)
    seen = {}
    for name in warc.export(made, str(tmp_path)):
        with open(name, "rb") as f:
            data = f.read()
        assert gzip.decompress(data).count(b"WARC-Record-ID") >= 1
        for size in (1, 7, 65536):
            seen |= {r.page(): r.http()[1] for r in warc.read(data[k : k + size] for k in range(0, len(data), size)) if r.headers["warc-type"] == "response"}
    assert seen == {i: (t or "").encode() for i, _, t in rows if i not in (4, 8)}


@pytest.mark.parametrize("harm", [lambda b: b[:-3], lambda b: warc.member(b"x"), lambda b: warc.member(gzip.decompress(b).replace(b"hello", b"hallo")), lambda b: warc.member(gzip.decompress(b).replace(b"Content-Length", b"Content-Lenght")), lambda b: warc.member(gzip.decompress(b) + b"more"), lambda b: b + b"junk"])
def test_damage_is_an_error(harm):
    good = warc.member(warc.record(1, "http://h/", b"hello", hashlib.sha256(b"hello").hexdigest(), None))
    assert [r.page() for r in warc.read([good, good])] == [1, 1]
    with pytest.raises(warc.Damaged):
        list(warc.read([harm(good)]))


def test_a_wrong_payload_digest_is_an_error():
    with pytest.raises(warc.Damaged):
        list(warc.read([warc.member(warc.record(1, "u", b"hello", hashlib.sha256(b"other").hexdigest(), None))]))


def b32(data, algorithm="sha1"):
    return f"{algorithm}:" + base64.b32encode(hashlib.new(algorithm, data).digest()).decode()


def foreign(kind, block, **headers):
    """A record as other writers make it."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + str(len(block)))}>", "WARC-Date: 2020-02-02T02:02:02Z", *(f"{k.replace('_', '-')}: {v}" for k, v in headers.items())]
    return gzip.compress(("WARC/1.0\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"3\r\nabc\r\n2\r\nde\r\n0\r\n\r\n"
    kind = {"Content_Type": "application/http; msgtype=response"}
    made = [
        foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        foreign("request", b"GET / HTTP/1.1\r\n\r\n", Content_Type="application/http; msgtype=request"),
        foreign("response", http + b"<p>hello", WARC_Target_URI="http://x/\r\n  y", WARC_Payload_Digest=b32(b"<p>hello"), WARC_Block_Digest=b32(http + b"<p>hello"), **kind),
        foreign("response", chunked, WARC_Payload_Digest=b32(b"abcde"), **kind),
        foreign("revisit", http, WARC_Refers_To="<urn:uuid:1>", WARC_Payload_Digest=b32(b"<p>hello"), **kind),
        foreign("resource", b"data", WARC_Payload_Digest="md5:" + hashlib.md5(b"data").hexdigest()),
        foreign("metadata", b"", WARC_Payload_Digest="other:1"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(made))
    (tmp_path / "b.warc.gz").write_bytes(b"")
    got = warc.entries(spark, str(tmp_path), payloads=True).orderBy("place").collect()
    assert [r.record_type for r in got] == ["warcinfo", "request", "response", "response", "revisit", "resource", "metadata"]
    assert [bytes(r.payload) if r.payload is not None else None for r in got] == [b"software: x\r\n", b"", b"<p>hello", chunked.partition(b"\r\n\r\n")[2], None, b"data", b""]
    assert got[2].target_uri == "http://x/ y" and got[2].payload_digest == hashlib.sha256(b"<p>hello").hexdigest() and got[2].payload_bytes == 8
    assert got[4].refers_to == "<urn:uuid:1>" and got[4].payload_bytes is None and got[0].record_id.startswith("<urn:uuid:")
    assert [r.payload for r in warc.entries(spark, str(tmp_path)).collect()] == [None] * 7
    # As segments of pages: what isn't one is left out, ids are null.
    segment = spark.createDataFrame([(0, 0, bytearray(b"".join(made[:4])))], "archive long, seq int, data binary")
    assert [(r.page_id, r.payload_bytes, r.record_type) for r in warc.records(segment).collect()] == [(None, 8, "response"), (None, 20, "response")]


def test_files_of_our_own_are_entries_too(spark, tmp_path):
    made = warc.write(spark.createDataFrame([(i, "http://h/", "x" * 100) for i in range(5)], "page_id long, url string, html string"))
    warc.export(made, str(tmp_path))
    got = warc.entries(spark, str(tmp_path / "*.warc.gz")).collect()
    assert sorted((r.record_id, r.record_type, r.refers_to) for r in got) == [("<urn:page:0>", "response", None)] + [(f"<urn:page:{i}>", "revisit", "<urn:page:0>") for i in range(1, 5)]


@pytest.mark.parametrize("refers", [(7, b"x" * 100), (1, b"y" * 100)])
def test_revisits_of_nothing_or_of_another_payload_are_errors(spark, refers):
    digest = lambda x: hashlib.sha256(x).hexdigest()
    page, body = refers
    data = warc.member(warc.record(1, "u", b"x" * 100, digest(b"x" * 100), None)) + warc.member(warc.record(2, "u", body, digest(body), page))
    with pytest.raises(warc.Damaged, match="page 2 revisits"):
        warc.records(spark.createDataFrame([(0, 0, bytearray(data))], "archive long, seq int, data binary"))


def test_edges(spark):
    got = warc.records(warc.write(edge_pages(spark))).collect()
    assert len(got) == 7
    by = {r.page_id: r for r in got}
    assert by[None].payload_bytes > 200 and by[4].record_type == "response" and by[1].payload_bytes == by[2].payload_bytes == 0
    assert warc.records(warc.write(edge_pages(spark, empty=True))).count() == 0


def test_null_and_repeated_ids(spark):
    body = "z" * 100
    rows = [(None, body), (2, body), (2, body), (3, body), (None, "q" * 100), (None, "q" * 100)]
    got = warc.records(warc.write(spark.createDataFrame([(i, None, t) for i, t in rows], "page_id long, url string, html string"))).collect()
    assert sorted((r.page_id or -1, r.record_type, r.refers_to or -1) for r in got) == [(-1, "response", -1), (-1, "response", -1), (-1, "revisit", 2), (2, "response", -1), (2, "response", -1), (3, "revisit", 2)]
