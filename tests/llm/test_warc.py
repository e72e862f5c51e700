"""WARC archives: round trips, assembly and revisits."""

import gzip
import hashlib
import random
import zlib

from quire.llm import warc

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS capture", "'clash' AS digest", "'clash' AS type")


def brute(rows):
    first, out, used = {}, [], set()
    for page_id, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100:
            rank = (page_id is None, page_id or 0)
            first[body] = min(first.get(body, rank), rank)
    for page_id, _, html in rows:
        body = (html or "").encode()
        revisit, to = False, None
        if len(body) >= 100:
            head = first[body]
            revisit = (page_id is None, page_id or 0) != head or body in used
            used |= {body} if not revisit else set()
            to = (None if head[0] else head[1]) if revisit else None
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", to))
    return sorted(out, key=str)


def test_pages(spark):
    tricky = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\n" * 9
    rows = [
        (1, "http://a/", "x" * 100), (2, "http://b/ b", "x" * 100), (3, None, None), (4, "http://c/", ""), (5, "u", "x" * 99),
        (6, "u", "x" * 99), (7, "u\r\nv", tricky), (9, "u", tricky), (8, "u", tricky), (None, "u", tricky), (10, "é", "ß漢\n\r\n" * 40),
        (11, "u", "y" * 400_000), (12, "r", "z" * 120), (12, "r", "z" * 120), (13, "r", "z" * 120),
    ] + [(100 + i, "h", "hot" * 50) for i in range(200)]
    got = warc.page_captures(pages(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(spark):
    assert warc.page_captures(pages(spark, []).limit(0)).count() == 0


def test_payload_bytes_survive(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}\r\n\r\n é</p>" * i) for i in range(20)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "a"))
    captures = warc.assemble(warc.read_records(spark, str(tmp_path / "a"))).collect()
    assert sorted(bytes(c.response.payload).decode() for c in captures) == sorted(r[2] for r in rows)
    assert all(c.request.target_uri == c.response.target_uri and "page-id" in c.metadata.fields for c in captures)


def members_of(data):
    """The contents of each gzip member."""
    out = []
    while data:
        one = zlib.decompressobj(31)
        out.append(one.decompress(data))
        assert one.eof
        data = one.unused_data
    return out


def test_members():
    records = warc.capture_records(1, 1, "u", b"a" * 10, "d", None, None, False)
    data = b"".join(map(warc._member, records))
    assert members_of(data) == records
    assert [p[0] for p in warc.parse(data + data)] == ["request", "response", "metadata"] * 2
    # From 16 MiB on the length's last byte is not zero.
    long = b"x" * (17 << 20)
    assert members_of(warc._member(long)) == [long, b""] and warc._member(long)[-1] == 0 == warc._member(b"y")[-1]


def test_archives(spark, tmp_path):
    """Each record is a member, archives begin with a warcinfo record and end by their bytes."""
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", "".join(rng.choices("abcdefgh", k=3000))) for i in range(100)] + [(200, "http://copy/", "same" * 100), (201, None, "same" * 100)]
    warc.write_archives(pages(spark, rows), str(tmp_path / "a"), archive_bytes=20_000)
    files = sorted((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) > 5 and not list((tmp_path / "a").glob("*.txt"))
    kinds = []
    for file in files:
        data = file.read_bytes()
        records = members_of(data)
        assert len(data) < 26_000 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
        found = [x[0] for r in records for x in warc.parse(r)]
        assert len(found) == len(records) and found[0] == "warcinfo" and found.count("warcinfo") == 1
        assert gzip.decompress(data) == b"".join(records)
        kinds += found
        for _, _, headers, _ in warc.parse(data):
            if headers["warc-type"] == ["revisit"]:
                assert headers["warc-refers-to-target-uri"] == ["http://copy/"] and headers["warc-refers-to-date"] == [warc.DATE]
    assert (kinds.count("request"), kinds.count("response"), kinds.count("revisit")) == (102, 101, 1)


def test_very_long_page(spark):
    rows = [(1, "u", "long page " * 2_000_000), (2, "u", "long page " * 2_000_000), (3, "u", "short")]
    got = warc.page_captures(pages(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_concurrent_to_either_way(spark):
    rows = [
        ("request", "q1", [], None, "u1", None, None, None, None),
        ("response", "r1", ["q1"], None, "u1", "d", 1, None, b"x"),
        ("metadata", "m1", ["q1"], None, None, None, None, "f1", None),
        ("response", "r2", [], None, "u2", "d", 1, None, b"x"),
        ("metadata", "m9", ["gone"], None, None, None, None, "f9", None),
    ]
    got = {r.capture: r for r in warc.assemble(spark.createDataFrame(rows, warc._RECORD)).collect()}
    assert set(got) == {"r1", "r2"} and got["r1"].request.record_id == "q1" and got["r1"].metadata.fields == "f1"
    assert got["r2"].request is None and got["r2"].metadata is None
