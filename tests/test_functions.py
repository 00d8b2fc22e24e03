from pyspark.sql import functions as F

from lakeline.functions import text as x
from lakeline.functions.vector import cosine
from lakeline.operators import cache, folds, listing, retrieval


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_markers(spark):
    s = "[IMG_PATH:x] t [IMG_PATH: y ] [IMG_PATH:x]"
    assert one(spark, s, lambda c: x.renumber_img_paths(c)[0]) == "[IMG:1] t [IMG:2] [IMG:1]"
    assert one(spark, s, lambda c: x.renumber_img_paths(c)[1]) == ["x", "y"]
    assert one(spark, "plain", lambda c: x.renumber_img_paths(c)[0]) == "plain"
    assert one(spark, "a [IMG:1] b [IMG:3 — c]", lambda c: x.shift_img_numbers(c, F.lit(4))) == "a [IMG:5] b [IMG:7 — c]"
    assert one(spark, "[IMG:1] [IMG:2] [IMG:9]", lambda c: x.inline_captions(c, F.array(F.lit("cat"), F.lit(" ")))) == "[IMG:1 — cat] [IMG:2] [IMG:9]"
    assert one(spark, "a [IMG:1 — c] b", x.strip_img_markers) == "a  b"


def test_answers(spark):
    ctx = "**[Bağlam]:** c\n\nbody"
    assert one(spark, ctx, lambda c: x.split_context(c)[0]) == "**[Bağlam]:** c\n\n" and one(spark, ctx, lambda c: x.split_context(c)[1]) == "body"
    assert one(spark, "c\n\nbody", lambda c: x.split_context(c)[1]) == "c\n\nbody"
    assert one(spark, "**[no_answer]:** text", x.is_rejection) and one(spark, "**[no_answer]:** text", x.strip_no_answer) == "text"
    assert not one(spark, "see [NO_ANSWER]", x.is_rejection) and one(spark, " ", x.is_rejection)
    assert one(spark, "x (KAYNAK [3]) y", x.strip_source_refs) == "x y"


def test_small_functions(spark):
    assert one(spark, ["2.3 EXIT", "2- 3 Exit", "Intro"], x.header_path, "array<string>") == "2.3 EXIT > Intro"
    assert one(spark, "a|b\\c\nd", x.escape_cell) == "a\\|b\\\\c d"
    assert one(spark, '["a","b"]', x.json_string_array) == ["a", "b"] and one(spark, "no", x.json_string_array) == []
    assert one(spark, ["A", "b", "a"], lambda c: x.array_minus(c, F.array(F.lit("a"))), "array<string>") == ["b"]
    assert one(spark, 1536, x.format_size, "long") == "1.5 KB" and one(spark, 5, x.format_size, "long") == "5 B"
    assert [one(spark, b, x.doc_format, "binary") for b in (b"%PDF-1", b"PK\3\4", b"{\\rtf1", b" \n<html", b"q")] == ["Pdf", "Ooxml", "Rtf", "MarkupText", "Unknown"]
    assert [one(spark, b, x.image_format, "binary") for b in (b"\xff\xd8\xff0", b"RIFF0000WEBP", b"?")] == ["jpeg", "webp", "png"]
    assert [one(spark, n, retrieval.dynamic_k, "int") for n in (3, 5, 6, 10, 11, 20, 21)] == [3, 5, 6, 6, 10, 10, 12]
    assert one(spark, "12", x.is_page_number) and not one(spark, "12345", x.is_page_number)
    assert one(spark, "a  b c d", lambda c: x.clip_to_tokens(c, 2)) == "a  b"
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), (None, [1.0]), ([0.0], [1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(F.round(cosine(F.col("a"), F.col("b")), 6)).collect()
    assert [r[0] for r in rows] == [0.707107, 0.0, 0.0, 0.0]


def test_fusion_and_diversity(spark):
    lists = lambda s: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(s)], "q_id long, chunk_id string, rank int")
    assert [r.chunk_id for r in retrieval.rrf(lists("abc"), lists("cd")).orderBy("rank").collect()] == ["c", "a", "b", "d"]
    ranked = spark.createDataFrame([(1, i + 1, x[0], x) for i, x in enumerate(["A1", "A2", "A3", "B1", "C1"])], "q_id long, rank int, doc_id string, chunk_id string")
    assert [r.chunk_id for r in retrieval.round_robin(ranked).orderBy("diverse_rank").collect()] == ["A1", "B1", "C1", "A2", "A3"]
    scored = lambda *s: sorted(r.score for r in retrieval.rerank_filter(spark.createDataFrame([(1, i, v) for i, v in enumerate(s)], "q_id long, rank int, score double")).collect())
    assert scored(0.9, 0.2, 0.1) == [0.2, 0.9] and scored(0.1, 0.08, 0.06, 0.055, 0.01) == [0.06, 0.08, 0.1] and scored(None, None) == [0.0, 0.0]
    items = lambda *c: [r.tokens for r in retrieval.select_context(spark.createDataFrame([(1, i, v) for i, v in enumerate(c)], "q_id long, rank int, tokens int"), 10).orderBy("rank").collect()]
    assert items(5, 4, 9, 1) == [5, 4] and items(50, 1) == [50]


def test_cache_routes(spark):
    df = spark.createDataFrame([(0.98, 0), (0.93, 0), (0.93, -1), (0.99, 2), (None, 0)], "s double, n int")
    assert [r[0] for r in df.select(cache.cache_route(F.col("s"), F.col("n"))).collect()] == ["FAST", "VALIDATE", "FAST", "BYPASS", "MISS"]


def test_folds_against_loops(spark):
    import random

    rnd = random.Random(2)
    docs = {d: [rnd.randint(0, 60) for _ in range(rnd.randint(1, 30))] for d in range(40)}
    df = spark.createDataFrame([(d, i, c) for d, cs in docs.items() for i, c in enumerate(cs)], "doc_id long, i int, cost int")
    got = {(r.doc_id, r.i): r.group_no for r in folds.pack_budget(df, "doc_id", "i", "cost", 100).collect()}
    for d, cs in docs.items():
        no, used = 0, 0
        for i, c in enumerate(cs):
            if used > 0 and used + c > 100:
                no, used = no + 1, 0
            used += c
            assert got[d, i] == no
    got = {(r.doc_id, r.i): r.group_no for r in folds.coalesce_small(df, "doc_id", "i", "cost", 30, 70).collect()}
    for d, cs in docs.items():
        no, used = -1, None
        for i, c in enumerate(cs):
            if c < 30 and used is not None and used + c <= 70:
                used += c
            else:
                no, used = no + 1, c if c < 30 else None
            assert got[d, i] == no


def test_validation(spark):
    df = spark.createDataFrame([(None, 0, ["spam"], "x" * 501), (1, -1, ["wrong"], None)], "message_id long, rating int, categories array<string>, reason string")
    assert [r[0] for r in df.select(listing.violations(listing.feedback_rules(["wrong"]))).collect()] == [["message_id", "rating", "categories", "reason"], []]


def test_image_markdown_options_topics(spark):
    assert one(spark, "![a]( ![b](u r l) )", x.normalize_image_md) == "![b](url)"
    assert one(spark, '- "first option"|2) short|3. other choice|ends so:', lambda c: x.parse_options(c, 3)) == ["first option", "other choice"]
    assert one(spark, "annual-Report_ofÇelik.pdf", x.topic_name) == "annual report of çelik"
    s = "see [[IMG-1]] and [[IMG-2 x]] [[IMG-9]]."
    got = one(spark, s, lambda c: x.resolve_image_refs(c, F.array(F.lit("p"), F.lit("q")), F.array(F.lit("[cat]"), F.lit(" "))))
    assert got == "see ![(cat)](/uploads/p) and ![image](/uploads/q) ."
    assert one(spark, 1704067200, x.format_date, "long") == "1 Ocak 2024"


def test_recursive_split(spark):
    got = one(spark, "a b\nc d\n\ne f g h i j k\nl", lambda c: x.recursive_split(c, 4))
    assert got == ["a b\nc d", "e f g h", "i j k\nl"] and one(spark, " \n", lambda c: x.recursive_split(c, 4)) == []
