from __future__ import annotations

import hashlib

import pytest

from tenurelens.llm import archives


def test_headers_of_both_versions():
    one = archives.parse_arc(b"http://a/b c 1.2.3.4 20010203040506 text/html 5\nhello\n", 1)
    assert one.fields["URL"] == "http://a/b c" and one.block == b"hello"
    two = archives.parse_arc(b"\nhttp://a 1.2.3.4 20010203040506 text/html 200 abc - 77 f.arc 2\nhi\n", 2)
    assert two.fields["Result-code"] == "200" and two.fields["Offset"] == "77" and two.block == b"hi"
    with pytest.raises(ValueError, match="declared 9 bytes"):
        archives.parse_arc(b"u 1.2.3.4 2001 text/html 9\nhello\n", 1)
    with pytest.raises(ValueError, match="not an ARC"):
        archives.parse_arc(b"junk\n", 1)
    assert archives.arc_version(b"2 0 x\nURL ...") == 2
    assert archives.warc_date("20010203040506") == "2001-02-03T04:05:06Z" and archives.warc_date("2001") == "2001-01-01T00:00:00Z"


def test_records_that_are_not_http(tmp_path):
    out = archives.Committed(str(tmp_path), "x.arc.gz", 0)
    block = b"1 0 me\n"
    out.write(archives.gzip_member(b"filedesc://x 0.0.0.0 2000 text/plain 7\n" + block + b"\n"))
    out.write(archives.gzip_member(b"dns:a 1.2.3.4 20000101000000 text/dns 4\nabcd\n"))
    out.commit()
    (_, _, first), (_, _, second) = archives.arc_records(str(tmp_path), "x.arc.gz")
    assert first.block == block and second.fields["Content-type"] == "text/dns"
    assert archives.split_http(second.block) == (b"", b"abcd")


def test_round_trip_and_revisits(spark):
    big = "é" * 600
    rows = [(1, "http://a b", big), (2, None, big), (None, "u", big), (3, "u", "x"), (4, "u", "x"), (5, "u", None), (6, "u", "a\n\nb\r\n\r\nc"), (6, "v", big), (7, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as key", "2 as file").repartition(3)
    found = archives.round_trip(spark, pages).collect()
    assert len(found) == len(rows)
    for r in found:
        texts = [t or "" for i, _, t in rows if i == r.key]
        assert r.payload_digest in {hashlib.sha1(t.encode()).hexdigest() for t in texts}
        assert r.payload_bytes in {len(t.encode()) for t in texts}
        revisit = r.payload_bytes == 1200 and r.key != 6
        assert (r.record_type, r.refers_to) == (("revisit", 6) if revisit else ("response", None))
    assert archives.round_trip(spark, pages.limit(0)).count() == 0
