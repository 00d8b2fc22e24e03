import base64
import gzip
import hashlib
import pathlib

from oracle import same_as_sql

from lakeline.llm import warc


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def test_op6_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: tuple(r)[1:] for r in warc.op6_warc(spark, d).collect()}
    newest = {}
    for p, h in sorted(pages.items()):
        newest[h] = p
    assert got == {p: (len(h), digest(h), "response" if newest[h] == p else "revisit", None if newest[h] == p else newest[h]) for p, h in pages.items()}


ROWS = [(1, "http://a.com/x", "é<b>"), (2, "http://a.com/y", None), (3, "http://a.com/x", "é<b>"), (4, None, ""), (5, "http://b.com/\r\nWARC-Type: x", "WARC/1.1\r\n\r\nq"), (None, "u", "é<b>"), (3, "http://a.com/x", "é<b>"), (7, "x", "z" * 20_000_000)]


def test_round_trip_through_the_index(spark, tmp_path):
    df = spark.createDataFrame([(*r, 0) for r in ROWS], "page_id long, url string, html string, payload int")
    path = f"file://{tmp_path}/warc"
    index = warc.archive(df, path)
    rows = warc.read_records(spark, path, warc.open_blocks(index.blocks)).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes, bytes(r.payload)) for r in rows) == sorted(
        (p or 0, *((("revisit", 3, 5) if p == 1 else ("revisit", 4, 0) if p == 2 else ("response", 0, len((h or "").encode())))), b"" if p in (1, 2) else (h or "").encode()) for p, _, h in ROWS
    )
    members = [gzip.decompress(f.read_bytes()) for f in pathlib.Path(tmp_path, "warc").glob("part-*") if f.stat().st_size]
    assert sum(m.count(b"WARC-Record-ID") for m in members) == len(ROWS)
    found = warc.lookup(index, spark.createDataFrame([("http://A.com/x",), ("http://none/",), (None,)], "url string")).collect()
    assert sorted(r.page_id for r in found) == [1, 3, 3]


def test_lookup_finds_every_capture_over_many_blocks(spark, tmp_path, monkeypatch):
    rows = [(i, f"http://h{i % 7}.org/{i % 50}", f"page {i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.records(df), path)
    index = warc.build_index(warc.captures(spark, path), block_lines=9)
    urls = df.where("page_id % 20 = 0").select("url")
    want = {r.url for r in urls.collect()}
    for most in (warc.MOST_BLOCKS, 3):
        monkeypatch.setattr(warc, "MOST_BLOCKS", most)
        assert {r.page_id for r in warc.lookup(index, urls).collect()} == {i for i, u, _ in rows if u in want}


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    index = warc.archive(df, path)
    assert warc.read_records(spark, path, warc.open_blocks(index.blocks)).count() == 0


def test_op6_equals_sql(spark):
    assert same_as_sql(spark, warc.op6_warc, warc.ORACLE, "/root/testdata/sf0.01", ["pages"]) == 250


def test_query_finds_every_page_through_the_index(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", "b"), (3, "http://h/x y\r\nz", "c"), (4, " http://h/ ", None), (5, "no host", "a"), (5, "no host", "a"), (6, "http://É.org/ä?q=1#f", "d")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op6_warc(spark, str(tmp_path)).collect())
    assert got == [(1, 1, "revisit", 5), (2, 1, "response", None), (3, 1, "response", None), (4, 0, "response", None), (5, 1, "response", None), (5, 1, "response", None), (6, 1, "response", None)]
