import random

from pyspark.sql import functions as F

from lakeline.functions import compose
from lakeline.functions.split import pieces, split_text
from lakeline.operators import graph, listing, pictures
from lakeline.sources import tables as t


def test_render_tables(spark):
    tables = [
        (1, ["A", "col2", "C"], [["x", "", " "], ["", "", "s"], ["y", "\t", "z"], ["w", "v", "u"], ["q", None, "r|s"]]),
        (2, ["A"], [["1"]]), (3, [], [["1"]]), (4, ["A", "B", "C"], [["1", "", ""], ["2", "", ""]]), (5, ["A"], None), (6, ["A", "B", "C"], [["1", "2", ""], ["3", "4", ""], ["5", "6", ""]]),
    ]
    images = [(1, 2, "two"), (1, 1, "one"), (1, 3, "three"), (2, 1, "p"), (4, 1, "q"), (5, 1, "r"), (6, 1, "only")]
    got = {r.table_id: r.markdown for r in pictures.render_tables(spark.createDataFrame(tables, "table_id long, headers array<string>, rows array<array<string>>"), spark.createDataFrame(images, "table_id long, pos int, path string")).collect()}
    assert got == {
        1: "| A |  | C |\n| --- | --- | --- |\n| x |  |  |\n|  |  | s |\n| y | [IMG_PATH:one] | z |\n| w | v | u |\n| q | [IMG_PATH:two] | r\\|s |\n[IMG_PATH:three]",
        2: "| A |\n| --- |\n| 1 |\n[IMG_PATH:p]", 4: "| A | B | C |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 |  |  |\n[IMG_PATH:q]", 5: "| A |\n| --- |\n[IMG_PATH:r]",
        6: "| A | B | C |\n| --- | --- | --- |\n| 1 | 2 | [IMG_PATH:only] |\n| 3 | 4 |  |\n| 5 | 6 |  |",
    }


def test_number_images(spark):
    long = "c" * 90
    rows = [
        (1, 1, "a [IMG:2 — the [cat] b [IMG:9] c", ["p", "q"]), (1, 2, "[IMG:1][IMG:1: dog]", ["r"]), (1, 3, "[IMG:1]", []), (1, 4, f"x [IMG:1 {long}]", ["s"]), (2, 1, None, ["p"]), (2, 2, "[IMG:0] [IMG:99999999999] none", ["p"]),
    ]
    texts, images = pictures.number_images(spark.createDataFrame(rows, "q_id long, rank int, content string, paths array<string>").repartition(3))
    assert {(r.q_id, r["rank"]): r.content for r in texts.collect()} == {
        (1, 1): "a [[IMG-1: the (cat]] b [IMG:9] c", (1, 2): "[[IMG-2]][[IMG-3: dog]]", (1, 3): "[IMG:1]", (1, 4): f"x [[IMG-4: {'c' * 80}…]]", (2, 1): "", (2, 2): "[IMG:0] [IMG:99999999999] none",
    }
    assert sorted(tuple(r) for r in images.collect()) == [(1, 1, "q", "the [cat"), (1, 2, "r", None), (1, 3, "r", "dog"), (1, 4, "s", long)]


def test_pieces_give_the_text_back(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word", "x", " ", " ", "\n", "\n\n", "  ", "\t"]) for _ in range(rng.randrange(200))) for _ in range(60)] + ["a" * 500, "a\tb\tc\td\te\tf", "", "one two\n\nthree"]
    for most in (1, 3, 10):
        for text in texts:
            got = list(pieces(text, most))
            assert "".join(got) == text and "" not in got
            assert all(len(p.split()) <= most or "\t" in p for p in got)
    assert list(pieces("a b\n\nc d e\nf", 3)) == ["a b\n\n", "c d e\n", "f"] and list(pieces("a b\n\nc\n\nd e", 3)) == ["a b\n\nc\n\n", "d e"] and list(pieces(None, 3)) == []
    assert list(pieces("\t".join("abcdefgh"), 2)) == ["a\tb\tc\td", "\te\tf\tg\t", "h"][:0] + [("\t".join("abcdefgh"))[i : i + 7] for i in range(0, 15, 7)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "id long, text string").repartition(3)
    back = df.lateralJoin(split_text(F.col("text").outer(), F.lit(3))).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "piece"))), lambda p: p.piece), "").alias("t")).collect()
    assert {r.id: r.t for r in back} == {i: x for i, x in enumerate(texts) if x}


def test_orphans_names_pages_and_groups(spark):
    got = pictures.orphan_images(spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "d")], "page_id long, uri string"), spark.createDataFrame([(1, "<img src=a>"), (2, None)], "page_id long, html string"))
    assert {tuple(r) for r in got.collect()} == {(1, "b"), (2, "c"), (3, "d")}
    docs = spark.createDataFrame([(1, "A_b.pdf"), (2, None)], "user_id long, file_name string")
    asks = spark.createDataFrame([(1, 1, "a_B.PDF"), (2, 1, "axb.pdf"), (3, 2, "a_b.pdf"), (4, None, None)], "request_id long, user_id long, file_name string")
    assert {r.request_id: r.taken for r in listing.name_taken(asks, docs).collect()} == {1: True, 2: False, 3: False, 4: False}
    pages = t.scan_pages(spark.createDataFrame([(1, 4, "b"), (1, 0, "a"), (2, 7, None)], "doc_id long, page_index int, markdown string"))
    assert {(r.doc_id, r.page_no, r.place) for r in pages.collect()} == {(1, 1, 1), (1, 5, 2), (2, 8, 1)}
    edges = [(1, 2), (2, 3), (10, 11), (7, 7), (3, 1), (None, 4)]
    found = {r.node: r.group for r in graph.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {frozenset(n for n in found if found[n] == g) for g in found.values()} == {frozenset({1, 2, 3}), frozenset({10, 11}), frozenset({7})}
    assert graph.connected(spark.createDataFrame([], "u long, v long")).count() == 0


def test_contexts_that_look_like_objects(spark):
    rows = ['["{x} holds", "b"]', '[{"context": "c"}, {"other": 1}, 5, [1], null, "\\n\\t "]', "no", None, '{"context": "c"}']
    got = spark.createDataFrame([(r,) for r in rows], "s string").select(compose.parse_contexts(F.col("s"), F.lit(6)).alias("c")).collect()
    assert [r.c for r in got] == [["{x} holds", "b", "", "", "", ""], ["c", "", "5", "", "", ""], [""] * 6, [""] * 6, [""] * 6]


def test_a_table_is_filled_within_its_row(spark):
    tables = spark.createDataFrame([(1, ["A", "B", "C"], [["x", "", "y"], ["x", "", "y"]])], "table_id long, headers array<string>, rows array<array<string>>")
    images = spark.createDataFrame([(1, 1, None), (1, 2, "p"), (1, 3, "q"), (9, 1, "r")], "table_id long, pos int, path string")
    got = pictures.render_tables(tables, images)
    assert [r.markdown for r in got.collect()] == ["| A | B | C |\n| --- | --- | --- |\n| x |  | y |\n| x | [IMG_PATH:p] | y |\n[IMG_PATH:q]"]
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
