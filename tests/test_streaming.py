import pytest
from pyspark.sql import functions as F

from lakeline.streaming import jobs


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path_factory.mktemp("events"))
    for k in range(3):
        events.orderBy("ts").where((F.col("event_id") % 3) == k).coalesce(1).write.mode("append").parquet(path)
    return events, path


def test_windows_equal_batch(spark, parts, tmp_path):
    events, path = parts
    stream = jobs.read_stream(spark, path, events.schema, 1)
    got = jobs.run_once(jobs.activity_windows(stream, late="60 days"), f"{tmp_path}/c", "complete", "windows")
    rows = lambda df: sorted((r.w.start, r.event_type, r.n, round(r.total, 6)) for r in df.collect())
    assert rows(got) == rows(jobs.activity_windows(events))


def test_dedupe_and_restart(spark, parts, tmp_path):
    events, path = parts
    stream = jobs.read_stream(spark, path, events.schema, 1)
    twice = jobs.dedupe_events(stream.union(stream), ["event_id"], "60 days")
    out, check = f"{tmp_path}/out", f"{tmp_path}/c"
    for _ in range(2):  # the second run starts at the checkpoint and finds nothing new
        twice.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == events.count()


def test_document_status(spark, tmp_path):
    rows = [(1, 1, "upload"), (1, 2, "start"), (1, 3, "fail"), (2, 1, "upload"), (2, 2, "start"), (2, 3, "delete"), (2, 4, "finish"), (2, 5, "upload"), (2, 6, "start"), (2, 7, "fail"), (3, 1, "upload"), (3, 2, "delete")]
    spark.createDataFrame(rows, "doc_id long, event_id long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.read_stream(spark, f"{tmp_path}/in", "doc_id long, event_id long, kind string")
    got = jobs.run_once(jobs.document_status(stream), f"{tmp_path}/c", "update", "status")
    assert {r.doc_id: r.status for r in got.collect()} == {1: "Failed", 2: "Stale", 3: "Deleted"}


def test_unanswered_questions(spark, tmp_path):
    q = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:10:00"), (3, "2024-01-03 00:00:00")]
    a = [(1, "2024-01-01 00:05:00"), (9, "2024-01-03 00:00:00")]
    spark.createDataFrame(q, "message_id long, ts string").selectExpr("message_id", "to_timestamp(ts) ts").write.parquet(f"{tmp_path}/q")
    spark.createDataFrame(a, "response_to long, ats string").selectExpr("response_to", "to_timestamp(ats) ats").write.parquet(f"{tmp_path}/a")
    lost = jobs.unanswered(jobs.read_stream(spark, f"{tmp_path}/q", "message_id long, ts timestamp"), jobs.read_stream(spark, f"{tmp_path}/a", "response_to long, ats timestamp"))
    assert [r.message_id for r in jobs.run_once(lost, f"{tmp_path}/c", "append", "lost").collect()] == [2]


def test_ingest_keeps_going_past_a_bad_file(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_bytes("é\nb".encode())
    (tmp_path / "in/b.txt").write_bytes(b"\xff\xfe\x00")
    files = jobs.read_stream(spark, f"{tmp_path}/in", jobs.FILE_SCHEMA, fmt="binaryFile")
    for _ in range(2):
        jobs.ingest(files, f"{tmp_path}/c", f"{tmp_path}/rows", f"{tmp_path}/errors").awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(f"{tmp_path}/rows").collect()) == ["b", "é"]
    assert spark.read.parquet(f"{tmp_path}/errors").count() == 1
