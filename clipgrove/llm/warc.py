"""WARC archives: written with revisits for equal payloads, read back along verified record boundaries.

Archives are plain WARC files under gzip, written by Spark's text writer (a record ends in a line feed), so they lie in any
store that Spark reaches, and lost tasks are run again. Reading does not trust the magic words: tasks list
every place where a record could start together with the place where its successor would, and only records
that a chain of successors reaches from the start of the file are records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clipgrove.session import cut

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS_PER_FILE = 4000
VERSION = "WARC/1.1"
MAGIC = b"WARC/1.1\r\n"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32, from five hexadecimal digits to four letters at a time."""
    digest = F.sha1(payload.cast("binary"))
    out = []
    for g in range(8):
        n = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(ALPHABET), F.shiftright(n, 5 * k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in (3, 2, 1, 0)]
    return F.concat(*out)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null: a response): of the pages with an equal payload of at
    least ``least`` bytes the one with the largest page_id is the response that the others revisit. The largest ids are partial
    aggregates; the join on the digest splits a digest that many pages share."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", base32_sha1(F.col("payload")))
    top = p.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("top"))
    return p.join(top, "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when((F.col("payload_bytes") >= least) & (F.col("top") != F.coalesce("page_id", F.lit(-1))), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 0, records: int = RECORDS_PER_FILE) -> None:
    """A WARC record per row of ``pages`` (page_id, url, html) in gzip files of at most ``records`` records under ``path``. Null html is an
    empty payload; a null page_id is written as such; a null url has no target; line ends in a url become %0A."""
    r = with_revisits(pages, least)
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        line("WARC-Date", F.lit(date)), F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]+", "%0A"))).otherwise(F.lit("")),
        F.when(again, F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
                               line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))), line("X-Payload-Bytes", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    # the writer's line separator is the last byte of each record
    r.select(F.concat(head, block, F.lit("\r\n\r")).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _plain(content: bytes) -> bytes:
    """Content of a file of any number of gzip members, or the file itself."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        out += [d.decompress(content), d.flush()]
        content = d.unused_data
    return b"".join(out)


def _header(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """(length of the header, fields) of the record at ``at``."""
    end = data.find(b"\r\n\r\n", at)
    fields = {}
    for row in data[at + len(MAGIC):end].split(b"\r\n"):
        name, _, value = row.partition(b":")
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return end + 4 - at, fields


def _starts(data: bytes) -> Iterator[tuple[int, int]]:
    """(at, after): places where a record could start, and where its successor would. A header has any length. Places before
    the same empty line share its rows, which are read once, so magic words within a long header or payload cost no more."""
    end, last, length = -1, -1, (-1, 0)
    for m in re.finditer(re.escape(MAGIC), data):
        if m.start() > end:
            end, row = data.find(b"\r\n\r\n", m.start()), m.end()
            if end < 0:
                return
            last, length = -1, (-1, 0)  # the last row that is no field, the last length and its row
            for x in data[row:end].split(b"\r\n"):
                name, colon, value = x.partition(b":")
                if not colon:
                    last = row
                if name.lower() == b"content-length":
                    length = row, int(value) if re.fullmatch(rb"\s*[0-9]{1,18}\s*", value) else -1
                row += len(x) + 2
        if last < m.end() <= length[0] and length[1] >= 0:
            after = end + 4 + length[1] + 4
            if after <= len(data) and data[after - 4:after] == b"\r\n\r\n":
                yield m.start(), after


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            found = list(_starts(_plain(content.as_py())))
            yield pa.record_batch([pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())],
                                  names=["path", "at", "after"])


def reachable(candidates: DataFrame) -> DataFrame:
    """``candidates`` (path, at, after) to the (path, at) that successors reach from at = 0: pointer jumping, with the
    distance doubled each round, so a chain of n records takes log2(n) rounds of joins on (path, at). Candidates inside payloads
    lead nowhere or into a record; nothing leads from a record to them."""
    jump = cut(candidates.select("path", "at", "after").distinct())
    seen = cut(jump.filter("at = 0").select("path", "at"))
    while not jump.isEmpty():
        to = jump.select("path", "at", F.col("after").alias("next"))
        starts = candidates.select("path", "at")
        seen = cut(seen.unionByName(seen.join(to, ["path", "at"]).select("path", F.col("next").alias("at")).join(starts, ["path", "at"], "left_semi")).distinct())
        jump = cut(jump.join(to.select("path", F.col("at").alias("after"), "next"), ["path", "after"]).select("path", "at", F.col("next").alias("after")))
    return seen


RECORD = "path string, at long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, intact boolean, payload binary"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def ident(value: str | None) -> int | None:
        m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
        return int(m[1]) if m else None

    def pack(rows):
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for path, content, places in zip(batch.column("path").to_pylist(), batch.column("content"), batch.column("places").to_pylist()):
            data, rows, held = _plain(content.as_py()), [], 0
            for at in sorted(places):
                length, f = _header(data, at)
                body = data[at + length:at + length + int(f["content-length"])]
                digest = f.get("warc-payload-digest", "").removeprefix("sha1:")
                response = f.get("warc-type") == "response"
                intact = not response or base64.b32encode(hashlib.sha1(body).digest()).decode() == digest
                rows.append((path, at, ident(f.get("warc-record-id")), f.get("warc-target-uri"), f.get("warc-type"), ident(f.get("warc-refers-to")),
                             int(f.get("x-payload-bytes", len(body))), digest, intact, body))
                held += len(body)
                if held > 1 << 22:
                    yield pack(rows)
                    rows, held = [], 0
            if rows:
                yield pack(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all files under ``path``: path, at, page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact
    (a response's payload has its digest), payload (empty for a revisit). A file that breaks off keeps the records
    before the break; files without a record at their start, and an empty folder, give none. Headers (urls) have any length. A task holds one file."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    found = reachable(cut(files.mapInArrow(_candidates, "path string, at long, after long")))
    places = found.groupBy("path").agg(F.collect_list("at").alias("places"))  # as many as the file has records
    return files.join(places, "path").select("path", "content", "places").mapInArrow(_records, RECORD)
