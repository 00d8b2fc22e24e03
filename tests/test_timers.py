import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lakeline.operators import cache, ingest
from lakeline.sources import store as st
from lakeline.streaming import intake, jobs, timers

UTC = dt.timezone.utc


def write_in_order(spark, rows, schema, path, parts):
    """Files in the order of time, a trigger each."""
    rows = sorted(rows, key=lambda r: r[1])
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        stamped = [(r[0], dt.datetime.fromtimestamp(r[1], UTC), *r[2:]) for r in part]
        spark.createDataFrame(stamped, schema).coalesce(1).write.mode("append").parquet(path)


def run(df, out, check, mode):
    q = df.writeStream.outputMode(mode).foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(f"{out}/n={n}")).option("checkpointLocation", check).trigger(availableNow=True).start()
    q.awaitTermination()
    return [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]


def test_lookups_equal_batch_over_a_restart_and_state_shrinks(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(12)}", 1_700_000_000 + int(rng.random() * 20_000)) for _ in range(400)]
    src = f"{tmp_path}/in"
    write_in_order(spark, rows, "key string, ts timestamp", src, 3)
    stream = lambda: timers.lookup_hits(jobs.read_stream(spark, src, "key string, ts timestamp", 1), 900, 3600)
    held = run(stream(), f"{tmp_path}/out", f"{tmp_path}/c", "update")
    more = [(f"k{rng.randrange(12)}", 1_700_020_001 + int(rng.random() * 9_000)) for _ in range(150)]
    write_in_order(spark, more, "key string, ts timestamp", src, 2)
    run(stream(), f"{tmp_path}/out", f"{tmp_path}/c", "update")  # goes on from the checkpoint
    got = {r.key: (r.h, r.m) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("key").agg(F.sum("hits").alias("h"), F.sum("misses").alias("m")).collect()}
    want = cache.lookup_stats(spark.createDataFrame(rows + more, "key string, at long"), 900, 3600)
    assert got == {r.key: (r.hits, r.misses) for r in want.collect()} and sum(h for h, _ in got.values()) > 100
    write_in_order(spark, [("late", 1_700_900_000), ("later", 1_700_990_000)], "key string, ts timestamp", src, 2)
    left = run(stream(), f"{tmp_path}/out", f"{tmp_path}/c", "update")
    assert max(held) >= 12 and left[-1] < max(held)


def test_expired_entries_equal_batch(spark, tmp_path):
    rng, day, now = random.Random(2), timers.DAY, 1_700_000_000
    made = [(i, now - rng.randrange(1, 80) * day, "create") for i in range(60)]
    hits = [(i, t + rng.randrange(1, 25) * day + 60, "hit") for i, t, _ in made if rng.random() < 0.6]
    hits = [h for h in hits if h[1] < now]
    src, schema = f"{tmp_path}/in", "cache_id long, ts timestamp, kind string"
    write_in_order(spark, made + hits + [(999, now - 1000 * day, "hit"), (1000, now, "create")], schema, src, 4)
    stream = lambda: timers.expired_entries(jobs.read_stream(spark, src, schema, 1))
    run(stream(), f"{tmp_path}/out", f"{tmp_path}/c", "append")
    write_in_order(spark, [(1001, now, "create")], schema, src, 1)
    run(stream(), f"{tmp_path}/out", f"{tmp_path}/c", "append")
    gone = {r.cache_id for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    last = {}
    for i, t, _ in hits:
        last[i] = max(last.get(i, 0), t)
    table = spark.createDataFrame([(i, t, last.get(i)) for i, t, _ in made], "cache_id long, created long, last_hit long")
    kept = {r.cache_id for r in cache.cache_expire(table, now).collect()}
    assert gone == {i for i, _, _ in made} - kept and gone and kept


def states(spark, tmp):
    return {r.doc_id: r.status for r in intake.document_states(spark, f"{tmp}/in", f"file://{tmp}/store").collect()}


def test_documents_move_through_their_states(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    put = lambda name, data: (tmp_path / "in" / name).write_bytes(data)
    start = lambda n=2: intake.stream_ingest(spark, f"{tmp_path}/in", f"file://{tmp_path}/store", f"{tmp_path}/c", n)
    put("a.md", b"# A\n\nfirst words\fsecond page")
    put("b.md", b"\x00\x01\x02")
    assert states(spark, tmp_path) == {"a": "Pending", "b": "Pending"}
    start().awaitTermination()
    assert states(spark, tmp_path) == {"a": "Ready", "b": "Failed"}
    put("c.md", b"third text")
    put("a.v2.md", b"\x00")
    put("d.md", b"fourth text")
    real = st.stage

    def failing(session, store, table, run, make):
        if table == "chunks":
            raise RuntimeError("lost")
        return real(session, store, table, run, make)

    with monkeypatch.context() as m:
        m.setattr(st, "stage", failing)
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination()
    found = states(spark, tmp_path)
    assert list(found.values()).count("Processing") == 2, found
    start().awaitTermination()
    assert states(spark, tmp_path) == {"a": "Stale", "b": "Failed", "c": "Ready", "d": "Ready"}
    text = {r.doc_id: r.content for r in st.read_table(spark, f"file://{tmp_path}/store", "chunks").where("chunk_idx = 0").collect()}
    assert "first words" in text["a"] and set(text) == {"a", "c", "d"}
    start().awaitTermination()
    assert ingest.st.latest(spark, f"file://{tmp_path}/store").count() == 3
