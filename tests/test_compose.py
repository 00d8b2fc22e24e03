import itertools
import re

from conftest_oracle import compare
from pyspark.sql import functions as F

from lakeline.functions import compose as c
from lakeline.operators import answers as an
from lakeline.operators import websearch as ws
from lakeline.plans import registry


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def strings(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


def test_flags_and_contexts(spark):
    flags = ['{"valid": true}', '```json\n{"valid": true}\n```', '{"valid": "true"}', '{"valid": 1}', "{}", "no", None]
    assert [one(spark, s, lambda v: c.parse_flag(v, "valid")) for s in flags] == [True, True, False, False, False, False, False]
    got = lambda s, n: one(spark, s, lambda v: c.parse_contexts(v, F.lit(n)))
    assert got('[{"context": "a"}, "b", {"x": 1}, " "]', 5) == ["a", "b", "", "", ""] and got('["a", "b"]', 1) == ["a"]
    assert got(f'["{"x" * 400}"]', 1) == ["x" * 300] and got("no", 2) == ["", ""] and got(None, 1) == [""] and got("[]", 0) == []


def test_search_texts(spark):
    rows = [("q", "rich", "x" * 700, False), ("q", None, "last", False), ("q", " ", "last", True), ("q", "rich", None, None), (None, None, " ", False)]
    df = spark.createDataFrame(rows, "q string, e string, a string, s boolean").select(*c.search_texts(*map(F.col, "qeas")))
    assert [tuple(r) for r in df.collect()] == [("rich", "rich " + "x" * 600), ("q", "last"), ("q", "q"), ("rich", "rich"), (None, None)]


def test_chunk_texts(spark):
    told = strings("cat", " ", None)
    assert one(spark, "t [IMG:1]", lambda v: c.final_content(F.lit("ctx"), v, told)) == "**[Bağlam]:** ctx\n\nt [IMG:1 — cat]"
    assert one(spark, "t", lambda v: c.final_content(F.lit(None).cast("string"), v, told)) == "t"
    assert one(spark, "", lambda v: c.embed_text(F.lit("ctx"), v, F.lit("md"), told)) == "ctx md cat" and one(spark, "t", lambda v: c.embed_text(F.lit(""), v, F.lit("md"), strings())) == "t"
    assert [one(spark, h, lambda v: c.chunk_text(v, F.lit("m"), F.lit("c"))[k]) for h in ("H", " ", None) for k in (0, 1)] == ["**H**\n\nm", "H c", "m", "c", "m", "c"]


def test_image_paths(spark):
    s, paths = "[IMG:1] [IMG:2 — c] [IMG:3] [IMG:9] [IMG:x]", strings("a", "b", "c")
    got = lambda k, *h: one(spark, s, lambda v: c.dedup_img_paths(v, paths, strings(*h))[k])
    assert got(0, "h", "h", None) == "[IMG:1] [IMG:1 — c] [IMG:2] [IMG:9] [IMG:x]" and got(1, "h", "h", None) == ["a", "c"]
    assert got(0, "", "", None) == s and got(1, "h", "i", "j") == ["a", "b", "c"] and got(1) == ["a", "b", "c"]
    assert one(spark, None, lambda v: c.dedup_img_paths(v, paths, strings("h", "h"))[0]) == ""
    md = "x [IMG_REF:1] [IMG_REF:7] [[EMBED_IMG_0]] [[EMBED_IMG_4]]y"
    assert one(spark, md, lambda v: c.resolve_page_images(v, strings("f", "g"), strings("e"))) == "x [IMG_PATH:g] [IMG_REF:7] [IMG_PATH:e] y\n[IMG_PATH:f]"
    assert one(spark, "plain", lambda v: c.resolve_page_images(v, strings(), strings())) == "plain"


def test_page_images_cut_the_text_once_for_each_marker(spark):
    told = spark.createDataFrame([("x",)], "s string").select(c.resolve_page_images(F.col("s"), strings("f", "g"), strings("e")).alias("m"))
    assert told._jdf.queryExecution().analyzed().toString().count("split(") == 2


def test_blocks(spark):
    block = lambda kind, raw=None, text="a\nb", images=(): one(spark, kind, lambda v: c.render_block(v, F.lit(raw).cast("string"), F.lit(text), strings("i", "j"), F.lit(True), F.lit(6), strings(*images)))
    assert block("list") == "7. i\n8. j" and block("quote") == "> a\n> b" and block("code") == "```\na\nb\n```" and block("rule") == "---"
    assert block("text", images=["p", "q"]) == "a\nb\n[IMG_PATH:p]\n[IMG_PATH:q]\n" and block("text", raw="raw \n", images=["p"]) == "raw \n[IMG_PATH:p]"
    clean = lambda kind: one(spark, kind, lambda v: c.clean_text(v, F.lit("t"), strings("i", "j"), strings("h", "col2"), F.array(strings("x", "y"), strings("z", ""))))
    assert [clean(k) for k in ("table", "list", "rule", "text")] == ["h x y z", "i j", "", "t"]


def test_complaints(spark):
    assert [one(spark, k, c.category_label) for k in ("nonsense", "other", None)] == ["Anlamsız cevap", "other", None]
    kind = "array<struct<question string, answer string, reason string, categories array<string>>>"
    got = one(spark, [("q" * 201, "a", " ", ["nonsense", "x"]), ("q", "a", "r", [])], c.feedback_prompt, kind)
    assert got == f'1. Önceki soru: "{"q" * 200}…"\n   Verilen yanlış cevap: "a"\n   Şikayet kategorileri: Anlamsız cevap, x\n\n2. Önceki soru: "q"\n   Verilen yanlış cevap: "a"\n   Kullanıcı açıklaması: "r"\n'
    assert one(spark, [], c.feedback_prompt, kind) == ""


def test_finalize_answers(spark):
    rows = [
        (1, "see [[IMG-2]] (KAYNAK [1]) [[IMG-9]]", ["p", "q"], ["c", None], True, 0.7, [], True),
        (2, "[NO_ANSWER]: none [[IMG-1]]", ["p"], None, True, 0.9, [], True),
        (3, "text", ["p", "p"], [], True, 0.5, ["i"], True),
        (4, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "q_id int, answer string, paths array<string>, captions array<string>, standalone boolean, score double, issues array<string>, validated boolean")
    got = {r.q_id: tuple(r)[1:] for r in an.finalize_answers(df).collect()}
    assert got[1] == ("see ![gorsel](/uploads/q) ", ["q"], False, "none", True)
    assert got[2] == ("none ", [], True, "none", False) and got[3] == ("text", ["p"], False, "medium", False) and got[4][:3] == ("", [], True) and got[4][4] is False


def slow_search(query, texts):
    """Every alternative against every text, with covers found by trying all stretches."""
    words = {k: [x for x in re.split(r"[^a-z]+", v.lower()) if x] for k, v in texts.items()}
    tokens = re.findall(r'-?"[^"]*"?|\S+', query)
    parts = [list(g) for either, g in itertools.groupby(tokens, lambda x: x.lower() == "or") if not either]
    found = {}
    for part in parts:
        asked = {(x.startswith("-"), tuple(w for w in re.split(r"[^a-z]+", x.lower()) if w)) for x in part}
        want, no = [x for n, x in asked if x and not n], [x for n, x in asked if x and n]
        for k, w in words.items():
            at = lambda x: [i for i in range(len(w) - len(x) + 1) if tuple(w[i : i + len(x)]) == x]
            if not want or any(at(x) for x in no):
                continue
            holds = {(i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1) if all(any(i <= p and p + len(x) <= j for p in at(x)) for x in want)}
            least = [(i, j) for i, j in holds if not {(i + 1, j), (i, j - 1)} & holds]
            if least:
                found[k] = found.get(k, 0) + sum(1 / (1 + max(j - i - sum(map(len, want)), 0)) for i, j in least)
    return {k: round(v, 6) for k, v in found.items()}


def test_web_search_equals_all_stretches(spark):
    import random

    rnd = random.Random(4)
    texts = {f"c{k}": " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 14))) for k in range(60)} | {"none": "", "caps": "A, b-C"}
    queries = ["a b", '"a b"', "a or b", "a -b", '"a b" c', 'a "b c" or d -e', "a-b", "or", "-a", " ", "a a", 'c -"a b"', 'a or "b c" or d e f', '"a b', "zz"]
    asked = spark.createDataFrame([*enumerate(queries), (99, None)], "q_id long, question string")
    placed = ws.positions(spark.createDataFrame([*texts.items(), ("null", None)], "chunk_id string, content string"))
    got = {}
    for r in ws.web_search(asked, placed, 1000).collect():
        got.setdefault(r.q_id, {})[r.chunk_id] = round(r.score, 6)
    for i, q in enumerate(queries):
        assert got.get(i, {}) == slow_search(q, texts), q
    assert 99 not in got and ws.web_search(asked.limit(0), placed).count() == 0 and ws.web_search(asked, placed.limit(0)).count() == 0


def test_the_first_word_of_a_text_may_be_an_operator(spark, tmp_path):
    rows = [(20, "Or gold\nor else\nnone", "src0"), (21, "plain text", "src0"), (40, "src1 word", "src1"), (60, "plain", "src1"), (80, "plain", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/d")
    next(tmp_path.glob("d/part-*.parquet")).rename(tmp_path / "documents.parquet")
    assert compare(spark, registry.QUERIES["web_search_fields"], registry.ORACLE_SQL["web_search_fields"], str(tmp_path)) == 3
