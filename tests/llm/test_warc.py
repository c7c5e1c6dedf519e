import gzip
import hashlib
import base64
import random

from clipgrove.llm import warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as payload", "1L as top")


def test_magic_in_payloads_ties_and_nulls(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", f"<p>{FAKE}</p>{FAKE}"), (2, None, None), (3, "u", ""), (4, "u", "same é"), (9, "v", "same é"), (5, "v", "same é"), (None, "w", "alone"),
            (6, "u", FAKE), (7, "u", "x" * 300_000), (8, "u", "WARC/1.1\r\n")]
    warc.write_archives(pages(spark, rows), f"{tmp_path}/w", records=3)
    got = {r.page_id: r for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert set(got) == {r[0] for r in rows}
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {4: 9, 5: 9, 2: 3}
    for i, _, html in rows:
        body = (html or "").encode()
        assert got[i].payload_bytes == len(body) and got[i].payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode() and got[i].intact
        assert bytes(got[i].payload) == (body if got[i].record_type == "response" else b"")
    assert got[1].url == "http://a/%0AX: y"


def test_least_size_and_empty(spark, tmp_path):
    rows = [(1, "u", ""), (2, "u", ""), (3, "u", "long enough"), (4, "u", "long enough")]
    warc.write_archives(pages(spark, rows), f"{tmp_path}/w", least=5)
    assert {r.page_id: r.refers_to for r in warc.read_archives(spark, f"{tmp_path}/w").collect()} == {1: None, 2: None, 3: 4, 4: None}
    warc.write_archives(pages(spark, rows[:0]), f"{tmp_path}/e")
    assert warc.read_archives(spark, f"{tmp_path}/e").count() == 0


def test_broken_file_keeps_what_the_start_reaches(spark, tmp_path):
    record = lambda i, body: (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n").encode()
    whole = b"".join(record(i, "b" * i) for i in range(40))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(whole[:-3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(i, "c")) for i in range(100, 105)))
    (tmp_path / "c.warc").write_bytes(b"junk" + record(200, "x"))
    (tmp_path / "d.warc").write_bytes(record(300, FAKE) + b"garbage" + record(301, "x"))
    got = sorted(r.page_id for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == [*range(39), *range(100, 105), 300]


def test_header_of_any_length(spark, tmp_path):
    long = "data:text/html," + "x" * 70_000
    rows = [(1, "u", "a"), (2, long, "b"), (3, "http://a/?WARC/1.1\r\n", "c"), (4, long + "é" * 200_000, "d"), (5, "u", "e")]
    warc.write_archives(pages(spark, rows).coalesce(1), f"{tmp_path}/w")
    got = {r.page_id: (r.url, bytes(r.payload), r.intact) for r in warc.read_archives(spark, f"{tmp_path}/w").collect()}
    assert got == {i: (url.replace("\r\n", "%0A"), html.encode(), True) for i, url, html in rows}


def test_places_are_those_of_single_headers():
    """Magic words in rows, values and payloads, twice in a header, and lengths that are no numbers."""
    pieces = [b"WARC/1.1\r\n", b"X: WARC/1.1\r\n", b"Content-Length: 5\r\n", b"content-length: 0\r\n", b"Content-Length: \xc2\xb2\r\n", b"row\r\n", b"\r\n", b"hello\r\n\r\n", b"\r\n\r\n"]
    rng = random.Random(2)
    some = 0
    for _ in range(10_000):
        data = b"".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        want = []
        for at in range(len(data)):
            if data.startswith(warc.MAGIC, at):
                end = data.find(b"\r\n\r\n", at)
                rows = [r.partition(b":") for r in data[at + 10:max(end, at + 10)].split(b"\r\n")]
                value = {r[0].lower(): r[2].strip() for r in rows}.get(b"content-length", b"")
                if end >= 0 and all(r[1] for r in rows) and value.isdigit():
                    after = end + 8 + int(value)
                    if data[after - 4:after] == b"\r\n\r\n" and after <= len(data):
                        want.append((at, after))
        assert list(warc._starts(data)) == want
        some += len(want)
    assert some > 50
