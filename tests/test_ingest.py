import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakeline.operators import ingest, markdown, sections
from lakeline.sources import store as st

BLOCK = "doc_id long, block int, page int, kind string, header_path string, text string, headers array<string>, rows array<array<string>>"


def joined(spark, rows):
    return sorted((r.doc_id, r.block, r.headers, r.rows) for r in markdown.join_split_tables(spark.createDataFrame(rows, BLOCK).repartition(3)).collect())


def test_a_table_over_fifty_pages_becomes_one(spark):
    head = lambda p: ["A", "B"] if p % 3 == 0 else ["col1", "col2"] if p % 3 == 1 else ["v", "col2"]
    rows = [(1, p, p, "table", "h", "t", head(p), [[str(p), "x"]]) for p in range(50)]
    (got,) = joined(spark, rows)
    want = [r for p in range(50) for r in ([["v", ""]] if p % 3 == 2 else []) + [[str(p), "x"]]]
    assert got == (1, 0, ["A", "B"], want)


def test_what_ends_a_table(spark):
    rows = [
        (1, 0, 0, "table", "h", "t", ["A"], [["1"]]), (1, 1, 1, "table", "h", "t", ["a"], [["2"]]), (1, 2, 1, "text", "h", "t", None, None), (1, 3, 2, "table", "h", "t", ["A"], [["3"]]),
        (1, 4, 2, "table", "k", "t", ["A"], [["4"]]), (1, 5, 2, "table", "k", "t", ["A", "B"], [["5", "6"]]), (1, 6, 2, "table", "k", "t", ["A", "C"], [["7", "8"]]), (2, 0, 0, "table", None, "t", [], []), (2, 1, 0, "table", None, "t", [], []),
    ]
    got = joined(spark, rows)
    assert [(d, b, r) for d, b, _, r in got] == [(1, 0, [["1"], ["2"]]), (1, 2, None), (1, 3, [["3"]]), (1, 4, [["4"]]), (1, 5, [["5", "6"]]), (1, 6, [["7", "8"]]), (2, 0, []), (2, 1, [])]
    assert joined(spark, []) == []


def test_parse_table(spark):
    texts = ["| a | b \\| c |\n|---|:-:|\n| 1 | 2 | 3 |\n| 4 |", "| x | |\n| y | z |", "a | | c\n--- | --- | ---"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(*(c.alias(n) for c, n in zip(markdown.parse_table(F.col("t")), "hr")))
    assert [(r.h, r.r) for r in df.collect()] == [(["a", "b | c"], [["1", "2"], ["4", ""]]), (["col1", "col2"], [["x", ""], ["y", "z"]]), (["a", "col2", "c"], [])]


def cut(spark, blocks, **how):
    """Blocks as (kind, path, [tokens of units]); returns the chunk of every unit."""
    rows = [(1, b, u, k, p, n, 2 if k == "table" else 0) for b, (k, p, ns) in enumerate(blocks) for u, n in enumerate(ns)]
    df = spark.createDataFrame(rows, "doc_id long, block int, unit int, kind string, header_path string, tokens int, head_tokens int").repartition(4)
    return [r.chunk for r in sections.split_sections(df, **how).orderBy("block", "unit").collect()]


def test_sections_by_rule(spark):
    small = [("text", "a", [3]), ("table", "a", [3]), ("text", "b", [1])]
    assert cut(spark, small, most=20) == [0, 0, 1] and cut(spark, small, most=20, mode="semantic") == [0, 1, 2]
    large = [("text", "a", [6]), ("text", "a", [5]), ("list", "a", [1]), ("code", "a", [4, 4, 4]), ("text", "a", [9, 3]), ("text", "a", [1]), ("table", "a", [4, 4, 4])]
    assert cut(spark, large, most=10) == [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 8, 9]
    assert cut(spark, large, most=10, mode="semantic", most_atomic=12) == [0, 1, 2, 3, 3, 3, 4, 5, 6, 7, 7, 8]
    assert cut(spark, [("math", "a", [9, 9])], most=5, mode="semantic", most_atomic=4) == [0, 0]
    assert cut(spark, [("text", "a", [50]), ("text", "a", [50])], most=10) == [0, 1]


def test_a_long_section_streams(spark):
    units = spark.range(200_000).select(F.lit(1).alias("doc_id"), F.lit(0).alias("block"), F.col("id").alias("unit"), F.lit("text").alias("kind"), F.lit("h").alias("header_path"), F.lit(3).alias("tokens"), F.lit(0).alias("head_tokens"))
    got = sections.split_sections(units, 30).agg(F.max("chunk"), F.countDistinct("chunk")).first()
    assert tuple(got) == (19_999, 20_000)


PAGES = [
    (1, 0, "# One\n\nintro [IMG_PATH:a.png] text\n\n| A | B |\n| --- | --- |\n| 1 | 2 |"),
    (1, 1, "| col1 | col2 |\n| --- | --- |\n| 3 | 4 |\n\n## Two\n- x\n- y\n\n```\ncode here\n```"),
    (2, 0, "plain words [IMG_PATH:b.png] and [IMG_PATH:b.png]"), (3, 0, None), (4, 0, " \n "),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame(rows, "doc_id long, page_index int, markdown string")


def test_process_documents(spark):
    got = ingest.process_documents(pages(spark)).orderBy("doc_id", "chunk_idx").collect()
    one = [r for r in got if r.doc_id == 1]
    assert {r.doc_id for r in got} == {1, 2} and [r.chunk_idx for r in one] == list(range(len(one)))
    text = "\n".join(r.content for r in one)
    assert text.count("| 1 | 2 |\n| 3 | 4 |") == 1 and "col1" not in text and "**One > Two**" in text and "[IMG:1]" in text
    assert [r.next_id for r in one] == [r.chunk_id for r in one[1:]] + [None] and all(len(r.embedding) == 64 for r in got)
    assert [r.paths for r in got if r.doc_id == 2] == [["b.png"]] and ingest.process_documents(pages(spark, [])).count() == 0


def snapshot(spark, store, table="chunks"):
    return sorted(str(r) for r in st.read_table(spark, store, table).drop("embedding").collect())


@pytest.mark.parametrize("stage", ["pieces", "chunks", "documents", "manifest"])
def test_a_failed_run_is_invisible_and_goes_on(spark, tmp_path, monkeypatch, stage):
    store = f"file://{tmp_path}/store"
    ingest.ingest_documents(pages(spark), store, 1)
    before = snapshot(spark, store)
    again = pages(spark, [(1, 0, "# New\n\nnothing but this"), (5, 0, "a fifth text")])
    real, made = st.stage, []

    def failing(session, at, table, run, make):
        if table == stage:
            raise RuntimeError("lost")
        made.append(table)
        return real(session, at, table, run, make)

    with monkeypatch.context() as m:
        m.setattr(st, "stage", failing)
        with pytest.raises(RuntimeError):
            ingest.ingest_documents(again, store, 2)
    assert snapshot(spark, store) == before
    kept = {p: p.stat().st_mtime_ns for t in set(made) for p in (tmp_path / "store" / t / "run=2").glob("*.parquet")}
    ingest.ingest_documents(again, store, 2)
    assert kept and {p: p.stat().st_mtime_ns for p in kept} == kept  # finished stages were not made again
    after = snapshot(spark, store)
    assert [x for x in after if "doc_id=2" in x] == [x for x in before if "doc_id=2" in x] and sum("doc_id=1" in x for x in after) == 1 and any("fifth" in x for x in after)
    ingest.ingest_documents(pages(spark, [(2, 0, " "), (3, 0, "")]), store, 3)
    assert snapshot(spark, store) == after
    status = {r.doc_id: r.status for r in st.latest_rows(spark, store, "documents").collect()}
    assert status == {1: "Ready", 2: "Stale", 3: "Failed", 4: "Failed", 5: "Ready"}
    assert ingest.ingest_documents(pages(spark, []), store, 2).count() == 2 and snapshot(spark, store) == after


def test_write_chunks_with_a_failing_task(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    old = spark.createDataFrame([(d, c, "old") for d in range(4) for c in range(3)], "doc_id long, chunk_idx int, content string")
    with pytest.raises(ValueError):
        st.read_table(spark, store, "chunks")
    st.write_chunks(old, store, 1)
    new = old.where("doc_id < 2").withColumn("content", F.lit("new")).repartition(4, "chunk_idx")
    broken = new.withColumn("content", F.when(F.col("chunk_idx") == 2, F.raise_error(F.lit("task lost"))).otherwise(F.col("content")))
    with pytest.raises(PySparkException):
        st.write_chunks(broken, store, 2)
    seen = lambda: sorted((r.doc_id, r.chunk_idx, r.content) for r in st.read_table(spark, store, "chunks").collect())
    assert seen() == [(d, c, "old") for d in range(4) for c in range(3)]
    st.write_chunks(new, store, 2)
    st.write_chunks(broken, store, 2)  # the run is committed: nothing is written
    assert seen() == [(d, c, "new" if d < 2 else "old") for d in range(4) for c in range(3)]
    st.write_chunks(old.where("doc_id = 0").limit(1), store, 3, old.select("doc_id"))
    assert seen() == [(0, 0, "old")] and st.vacuum(spark, store, ["chunks"]) == [1, 2] and seen() == [(0, 0, "old")]


def test_texts_outside_tables_are_not_shuffled_to_join_tables(spark):
    from lakeline.operators import markdown as md

    rows = [(1, i, i // 2, "text", "h", f"t{i}", None, None) for i in range(6)] + [(1, 9, 5, "table", "h", "t", ["a", "b"], [["1", "2"]]), (1, 10, 6, "table", "h", "t", ["A", "b"], [["3", "4"]])]
    blocks = spark.createDataFrame(rows, "doc_id long, block long, page long, kind string, header_path string, text string, headers array<string>, rows array<array<string>>")
    joined = md.join_split_tables(blocks)
    assert sorted((r.block, r.text, r.rows) for r in joined.collect()) == [(i, f"t{i}", None) for i in range(6)] + [(9, None, [["1", "2"], ["3", "4"]])]
    assert "Window" not in md.join_split_tables(blocks)._jdf.queryExecution().executedPlan().toString()
