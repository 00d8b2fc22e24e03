"""WARC archives with a two-level capture index.

Pages are written as WARC 1.1 records, one gzip member a record, by Spark's file writer, so that any file system serves
and lost tasks are written again. Pages with equal payloads are stored once; the others become revisit records. The
index sorts captures by reversed-host URL keys into compressed blocks and keeps a sparse directory with the first key of
each block; a lookup searches the directory by bisection, opens the blocks and reads the records by their ranges.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.llm.common import ascii_lower, batch, map_batches, read_table, settle, shared_dir

CRLF = "\r\n"
#: Bytes of payload aimed at in one archive file; a file is read as a whole into one task.
FILE_BYTES = 32 << 20
#: Captures in one block of the index.
BLOCK_LINES = 3000
#: Blocks whose first keys are searched by bisection in every task; a larger directory is joined as a table.
MOST_BLOCKS = 200_000
DATE = "2024-01-01T00:00:00Z"


def surt(url: Column) -> Column:
    """The URL with its host reversed: ``http://a.b.com/x?y`` gives ``com,b,a)/x?y``; without a host the URL itself."""
    host = ascii_lower(F.regexp_extract(url, "^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, "^[^:/?#]*://[^/?#]*", "")
    return F.coalesce(F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "[.]")), ","), F.lit(")"), rest)), F.lit(""))


def stored(url: Column) -> Column:
    """The URL as its record holds it: control characters and blanks percent-encoded."""
    url = url.cast("string")
    for c in range(33):
        url = F.replace(url, F.lit(chr(c)), F.lit(f"%{c:02X}"))
    return url


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: each 5 hex digits of it are 4 of 32 signs."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to`` for each row of ``pages``.

    Of pages with equal payloads of ``least_bytes`` or more the largest page_id is the response that others revisit.
    A null html is an empty payload. Rows whose page_id is null, and repeated rows of the largest page_id, are
    responses. Only digests that occur more than once are joined back.
    """
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("payload_digest", base32_sha1(F.col("payload"))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    twice = own.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("newest"), F.count("*").alias("n")).where("n > 1 AND newest IS NOT NULL")
    revisits = F.col("newest").isNotNull() & (F.col("page_id") < F.col("newest"))
    return own.join(settle(twice.select("payload_digest", "newest")), "payload_digest", "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.when(revisits, F.col("newest")).alias("refers_to")
    )


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; control characters of a URL are percent-encoded, since they would end its header line."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF}{CRLF}".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {''.join(c if c > ' ' else f'%{ord(c):02X}' for c in url)}"] if url is not None else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    return (CRLF.join(head) + CRLF + CRLF).encode() + body + b"\r\n\r\n"


def write_archives(recs: DataFrame, path: str) -> None:
    """Write the records as gzip members into archive files in the folder ``path``.

    Spark's text writer puts a separator behind each row; the zero byte chosen is the last byte of a gzip member of less
    than 16 MB, which is left off the row, and padding behind a larger one.
    """
    total = recs.agg(F.count("*"), F.sum(F.when(F.col("record_type") == "response", F.col("payload_bytes")))).first()
    per_file = max(1, min(5000, FILE_BYTES * max(1, total[0]) // max(1, total[1] or 1)))
    schema = pa.schema([("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in zip(*(b.column(n).to_pylist() for n in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"))):
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = c.compress(record_bytes(*row)) + c.flush()
                out.append(member[:-1] if member[-1] == 0 else member)
            yield batch(schema, member=out)

    slim = recs.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b"")))
    members = map_batches(slim, run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).text(path)


def gzip_members(data: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; zero padding between members is skipped."""
    at = 0
    while at < len(data):
        if data[at] == 0:
            at += 1
            continue
        d, fed, parts = zlib.decompressobj(31), at, []
        while not d.eof:
            if fed >= len(data):
                raise ValueError("the archive ends within a record")
            parts.append(d.decompress(data[fed : fed + 65536]))
            fed = min(len(data), fed + 65536)
        end = fed - len(d.unused_data)
        yield at, end - at, b"".join(parts)
        at = end


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    headers = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[: int(headers["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda text: None if text in (None, "<urn:page:none>") else int(text[len("<urn:page:") : -1])
    return {
        "page_id": number(headers["WARC-Record-ID"]),
        "url": headers.get("WARC-Target-URI"),
        "record_type": headers["WARC-Type"],
        "refers_to": number(headers.get("WARC-Refers-To")),
        "payload_digest": headers["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": size,
        "payload": payload,
    }


CAPTURE = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def captures(spark: SparkSession, path: str) -> DataFrame:
    """``key, page_id, file, offset, length`` of every record of the archives in ``path``."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column("path"), b.column("content")):
                found = [(parse_record(r), at, n) for at, n, r in gzip_members(memoryview(content.as_buffer()))]
                yield batch(CAPTURE, url=[r["url"] for r, _, _ in found], page_id=[r["page_id"] for r, _, _ in found], file=[file.as_py()] * len(found), offset=[x[1] for x in found], length=[x[2] for x in found])

    found = map_batches(files, run, "url string, page_id long, file string, offset long, length long")
    return found.select(surt(F.col("url")).alias("key"), "page_id", "file", "offset", "length")


BLOCK = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("lines", pa.int64()), ("data", pa.binary())])


@dataclass
class Index:
    """``blocks`` holds ``block, first_key, last_key, lines, data``; ``directory`` the same without the data."""

    blocks: DataFrame
    directory: DataFrame


def build_index(found: DataFrame, block_lines: int = BLOCK_LINES) -> Index:
    """Sort captures by key (equal keys by page_id, so that a frequent key is cut too) into compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def block(rows: list[dict]) -> pa.RecordBatch:
            data = zlib.compress("\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode())
            return batch(BLOCK, first_key=[rows[0]["key"]], last_key=[rows[-1]["key"]], lines=[len(rows)], data=[data])

        for b in batches:
            held += b.to_pylist()
            while len(held) >= block_lines:
                yield block(held[:block_lines])
                held = held[block_lines:]
        if held:
            yield block(held)

    columns = ["key", "page_id", "file", "offset", "length"]
    dealt = settle(found).repartitionByRange(F.col("key"), F.col("page_id")).sortWithinPartitions("key", "page_id").select(columns)
    blocks = settle(map_batches(dealt, run, "first_key string, last_key string, lines long, data binary").withColumn("block", F.monotonically_increasing_id()))
    return Index(blocks, blocks.drop("data"))


def open_blocks(blocks: DataFrame) -> DataFrame:
    """The captures in blocks."""
    schema = pa.schema([("key", pa.string()), *[CAPTURE.field(n) for n in ("page_id", "file", "offset", "length")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data").to_pylist():
                rows = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
                yield batch(schema, **{n: [r[n] for r in rows] for n in schema.names})

    return map_batches(blocks.select("data"), run, "key string, page_id long, file string, offset long, length long")


def lookup(index: Index, urls: DataFrame) -> DataFrame:
    """The captures (``key, page_id, file, offset, length``) of ``urls(url)``; each distinct URL is looked up once.
    A null URL finds nothing, an empty one the captures without a URL.

    Every task finds the blocks of its keys by bisection in the directory while that has at most MOST_BLOCKS entries;
    a larger directory is not shipped, and all blocks are joined by key instead.
    """
    keys = urls.where("url IS NOT NULL").select(surt(stored(F.col("url"))).alias("key")).distinct()
    entries = index.directory.select("first_key", "last_key", "block").limit(MOST_BLOCKS + 1).collect()
    if len(entries) > MOST_BLOCKS:
        return open_blocks(index.blocks).join(keys, "key", "left_semi")
    entries = sorted(entries, key=lambda r: (r.first_key, r.block))
    shared = urls.sparkSession.sparkContext.broadcast(([r.first_key for r in entries], [r.last_key for r in entries], [r.block for r in entries]))
    schema = pa.schema([("key", pa.string()), ("block", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, block = shared.value
        for b in batches:
            got = []
            for key in b.column("key").to_pylist():
                for i in range(max(0, bisect_left(last, key)), bisect_right(first, key)):
                    got.append((key, block[i]))
            yield batch(schema, key=[g[0] for g in got], block=[g[1] for g in got])

    wanted = settle(map_batches(keys, run, "key string, block long"))
    opened = index.blocks.join(wanted.select("block").distinct(), "block", "left_semi")
    return open_blocks(opened).join(wanted.select("key").distinct(), "key", "left_semi")


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_records(spark: SparkSession, path: str, found: DataFrame, payload: bool = True) -> DataFrame:
    """The records at the ranges of ``found(file, offset, length)``; a response whose payload does not have the digest
    and size of its headers is an error. ``payload`` false leaves the payloads out of the result."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")
    ranges = settle(found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("ranges")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, own in zip(b.column("content"), b.column("ranges").to_pylist()):
                data, rows = memoryview(content.as_buffer()), []
                for r in own:
                    row = parse_record(zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31))
                    if row["record_type"] == "response" and (len(row["payload"]), base64.b32encode(hashlib.sha1(row["payload"]).digest()).decode()) != (row["payload_bytes"], row["payload_digest"]):
                        raise ValueError(f"damaged record at {r['offset']}")
                    if not payload:
                        row["payload"] = None
                    rows.append(row)
                yield batch(READ, **{n: [r[n] for r in rows] for n in READ.names})

    return map_batches(files.join(ranges, "file").select("content", "ranges"), run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, path: str, least_bytes: int = 0) -> Index:
    """Write ``pages`` as archives into ``path`` and index them."""
    write_archives(records(pages, least_bytes), path)
    return build_index(captures(pages.sparkSession, path))


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """Records of the whole table ``pages`` written as archives and read back through the index; ``records`` tells of odd rows."""
    import uuid

    path = f"{shared_dir(spark)}/lakeline/warc-{uuid.uuid4().hex}"
    pages = read_table(spark, sf_dir, "pages")
    index = archive(pages, path)
    found = lookup(index, pages.select(F.coalesce("url", F.lit("")).alias("url")))
    return read_records(spark, path, found, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: SHA-1 as hex becomes base32 five hex digits (20 bits, four signs) at a time.
ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(encode(coalesce(html, ''))) AS hexed FROM pages),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, list_reduce(list_transform(range(8), lambda i: list_reduce(list_transform(range(4), lambda j:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hexed, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT) >> (15 - 5 * j)) & 31) + 1, 1)), lambda a, b: a || b)), lambda a, b: a || b) AS payload_digest FROM p),
n AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to FROM n
"""
