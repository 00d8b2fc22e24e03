from pyspark.sql import functions as F

from lakeline.operators import answers, cache, files, retrieval, websearch


def test_semantic_pieces(spark):
    far = " ".join(["sea"] * 200 + ["hill"] * 200)
    df = spark.createDataFrame([(1, "a  short\ntext"), (2, far), (3, " \n"), (4, None), (5, "w " * 1000)], "doc_id long, text string")
    got = {}
    for r in files.semantic_pieces(df, most=250, window=50).orderBy("doc_id", "piece").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    assert got[1] == ["a  short\ntext"] and got[2] == [" ".join(["sea"] * 200), " ".join(["hill"] * 200)] and set(got) == {1, 2, 5}
    assert [len(t.split()) for t in got[5]] == [250] * 4


def test_quality_of_blank_answers(spark):
    df = spark.createDataFrame([('{"score": 0.5}', "an answer"), ('{"score": 0.5}', " \n"), ("nothing", None)], "s string, a string")
    got = df.select(*answers.parse_quality(F.col("s"), F.col("a"))).collect()
    assert [tuple(r) for r in got] == [(0.5, [], True), (0.0, ["empty_answer"], True), (0.0, ["empty_answer"], True)]


def test_head_costs_by_row(spark):
    df = spark.createDataFrame([(k, i, 4) for k in (1, 2) for i in range(6)] + [(3, 0, None)], "k int, i int, c int")
    got = {(r.k, r.piece): (r.first, r.n, r.cost) for r in files.split_items(df, "k", "i", "c", 10, F.when(F.col("k") == 2, 5)).collect()}
    assert got == {(1, 0): (0, 2, 8), (1, 1): (2, 2, 8), (1, 2): (4, 2, 8), **{(2, i): (i, 1, 9) for i in range(6)}, (3, 0): (0, 1, 0)}


def test_rates_and_served_answers(spark):
    stats = spark.createDataFrame([("a", 3, 1), ("b", 0, 0)], "key string, hits long, misses long")
    assert {r.key: r.rate for r in cache.hit_rate(stats).collect()} == {"a": 0.75, "b": 0.0}
    q = spark.createDataFrame([(1, [1.0, 0.0], 7), (2, [0.0, 1.0], 7)], "q_id long, vec array<double>, user_id long")
    c = spark.createDataFrame([(10, [1.0, 0.0], "yes", 2, None), (11, [0.5, 0.5], "no", 0, None)], "cache_id long, question_vec array<double>, answer string, hit_count int, last_hit long")
    f = spark.createDataFrame([], "feedback_id long, question_vec array<double>, user_id long, rating int")
    told, after = cache.serve_from_cache(q, c, f, 99)
    assert {r.q_id: (r.route, r.answer) for r in told.collect()} == {1: ("FAST", "yes"), 2: ("MISS", None)}
    assert {r.cache_id: (r.hit_count, r.last_hit) for r in after.collect()} == {10: (3, 99), 11: (0, None)}


def test_rerank_reads_the_first_characters(spark):
    df = spark.createDataFrame([("far", "x " * 800 + "far"), ("far", "far"), ("far", " \t"), (" ", "far")], "question string, content string")
    assert [r.score for r in retrieval.rerank_score(df).collect()] == [0.0, 1.0, None, None]


def test_common_words_propose_no_chunks(spark):
    rows = [(i, "the " * 3 + ("rare" if i in (5, 9) else "dull") + (" extra" if i == 9 else "")) for i in range(300)]
    placed = websearch.positions(spark.createDataFrame(rows, "chunk_id long, content string"))
    q = spark.createDataFrame([(1, "the rare"), (2, "the rare -extra"), (3, "the missing"), (4, '"the rare" or extra')], "q_id long, question string")
    found = {(r.q_id, r.part, r.chunk_id) for r in websearch.matching_chunks(websearch.clauses(q), placed).collect()}
    assert found == {(1, 0, 5), (1, 0, 9), (2, 0, 5), (2, 0, 9), (4, 0, 5), (4, 0, 9), (4, 1, 9)}
    got = {(r.q_id, r.chunk_id) for r in websearch.web_search(q, placed).collect()}
    assert got == {(1, 5), (1, 9), (2, 5), (4, 5), (4, 9)}


def test_windows_of_a_long_text_do_not_hold_the_text(spark):
    df = spark.createDataFrame([(1, " ".join(f"w{i % 97}" for i in range(1000)))], "doc_id long, text string")
    seen = []

    def model(rows, column):
        seen.extend(rows.columns + [rows._jdf.queryExecution().optimizedPlan().toString()])
        return answers.embed(rows, column)

    got = files.semantic_pieces(df, model=model).orderBy("piece").collect()
    assert " ".join(r.text for r in got) == df.first().text
    assert "Generate posexplode(sequence" not in seen[-1]


def test_equal_questions_are_looked_up_once(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, "alpha beta " * 3) for i in range(30)], "chunk_id long, content string")
    q = spark.createDataFrame([(i, "alpha beta") for i in range(40)], "q_id long, question string")
    seen, plain = [], websearch.cover_density
    monkeypatch.setattr(websearch, "cover_density", lambda hits, *a: seen.append((hits.count(), hits._jdf.queryExecution().executedPlan().toString())) or plain(hits, *a))
    by_place = {tuple(r) for r in websearch.web_search(q, websearch.positions(chunks)).collect()}
    by_row = {tuple(r) for r in websearch.web_search(q, websearch.word_places(chunks)).collect()}
    assert by_place == by_row == {(i, j, 5.0, j + 1) for i in range(40) for j in range(12)}
    assert [n for n, _ in seen] == [30 * 6, 30 * 6] and "hashpartitioning" not in seen[1][1]
