import hashlib
import time

from pyspark.sql import functions as F

from tallyroll.llm import warc

PAGE = ("<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body><!-- no --><p>One <b>two</b></p>"
        "<script>var t='</p>';</script><ul><li>a</li><li>b&nbsp;c</li></ul>5 < 6</body></html>")


def test_round_trip(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/x", PAGE), (2, None, "é\r\n\r\nz"), (3, "http://b\r\nX: y", None), (4, "http://a/x", ""), (1, "http://a/x", PAGE)],
        "page_id long, url string, html string").withColumn("record", F.lit("clash"))
    rows = {(r.source_id, r.record_type): r for r in warc.derive(warc.responses(pages)).collect()}
    sources = {str(r.page_id): r.record for r in warc.responses(pages).collect()}
    assert len(rows) == 8 and len(warc.derive(warc.responses(pages)).collect()) == 10
    for (sid, kind), r in rows.items():
        head, block = warc.parse_record(bytes(r.record))
        source, response = warc.parse_record(bytes(sources[sid]))
        payload = response.partition(b"\r\n\r\n")[2]
        assert source["warc-payload-digest"] == "sha256:" + hashlib.sha256(payload).hexdigest()
        assert head["warc-refers-to"] == source["warc-record-id"] == r.refers_to and head["warc-type"] == kind
        assert head.get("warc-target-uri") == source.get("warc-target-uri") and head["warc-date"] == source["warc-date"]
        assert head["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and len(block) == r.content_length
        if kind == "conversion":
            assert head["warc-source-payload-digest"] == source["warc-payload-digest"]
            assert head["warc-concurrent-to"] == rows[sid, "metadata"].record_id
        else:
            fields = block.decode().split("\r\n")
            assert f"conversion-id: {rows[sid, 'conversion'].record_id}" in fields
            assert f"source-block-digest: {source['warc-block-digest']}" in fields
            assert "http-header: Content-Type: text/html; charset=utf-8" in fields and "http-status: HTTP/1.1 200 OK" in fields
    text = warc.parse_record(bytes(rows["1", "conversion"].record))[1].decode()
    assert text == "T & t\nOne two\na\nb c\n5 < 6"
    assert warc.parse_record(bytes(rows["2", "conversion"].record))[1].decode() == "é\nz"
    assert "warc-target-uri" not in warc.parse_record(bytes(rows["2", "metadata"].record))[0]


def test_broken_records(spark):
    good = bytes(warc.responses(spark.createDataFrame([(1, "u://x", "hello")], "page_id long, url string, html string")).first().record)
    broken = [None, b"", b"WARC/1.1\r\n\r\n", good[:-1], good.replace(b"hello", b"hullo"), good.replace(b": response", b": request ")]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(broken)], "page_id long, record binary")
    got = {r.source_id: r for r in warc.derive(df).collect()}
    assert len(got) == len(broken) and all(r.record is None and r.problem for r in got.values())
    assert got["4"].problem == "digest mismatch" and got["5"].problem == "not a response"
    assert warc.derive(df.limit(0)).collect() == []


def test_text_of_odd_markup():
    assert warc.plain_text("<script>never closed") == "" and warc.plain_text("a <b") == "a <b"
    assert warc.plain_text("x" * 200_000 + "<p>y") == "x" * 200_000 + "\ny" and warc.plain_text("&lt;p&gt;") == "<p>"


def test_broken_markup_takes_linear_time():
    for piece in ("<a ", "<p ", "<!x", "<script x", "</script ", "<!--", "<a href='x' <p>", "<"):
        page = piece * (2_000_000 // len(piece))
        began = time.monotonic()
        warc.plain_text(page)
        warc.plain_text(page + ">end")
        assert time.monotonic() - began < 10, piece
    assert warc.plain_text("a<b>c</b><p>d<a href") == "ac\nd<a href"
