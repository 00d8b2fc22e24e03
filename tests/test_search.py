import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeline.functions import vector
from lakeline.operators import index as ix
from lakeline.operators import retrieval


def rows_of_vectors(n, seed, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 3
    out = [(i, int(rng.choice([0, 0, 0, 1, 2, 7])), (centres[i % 12] + rng.normal(size=dim)).tolist()) for i in range(n)]
    return out + [(n, 0, None), (n + 1, 0, []), (n + 2, 0, [0.0] * dim), (n + 3, 0, [1.0] * (dim - 1)), (n + 4, None, [1.0] * dim), (n + 5, 0, [None] + [1.0] * (dim - 1))]


def cosines(qs, items, scoped):
    for q, s, a in qs:
        for i, t, b in items:
            if a and b and len(a) == len(b) and None not in a + b and any(a) and any(b) and s is not None and t is not None and (not scoped or s == t):
                yield q, i, float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("scope", [None, "user"])
def test_similarity_join_against_brute_force(spark, monkeypatch, scope):
    qs, items = rows_of_vectors(60, 1), rows_of_vectors(900, 2)
    if scope is None:
        qs, items = [r for r in qs if r[1] is not None], [r for r in items if r[1] is not None]
    frame = lambda r: spark.createDataFrame(r, "id long, user int, v array<double>").repartition(5)
    want = list(cosines(qs, items, scope))
    monkeypatch.setattr(vector, "PACK", 16)
    got = vector.similarity_join(frame(qs), "id", "v", frame(items), "id", "v", least=0.8, scope=scope).collect()
    assert {(r.q_id, r.item_id) for r in got} == {(q, i) for q, i, s in want if s >= 0.8} and len(got) == len({(r.q_id, r.item_id) for r in got})
    best = {}
    for q, i, s in sorted(want, key=lambda x: (x[0], -round(x[2], 9), x[1])):
        best.setdefault(q, []).append(i)
    got = vector.similarity_join(frame(qs), "id", "v", frame(items), "id", "v", top=7, scope=scope).collect()
    assert sorted((r.q_id, r["rank"], r.item_id) for r in got) == sorted((q, k + 1, i) for q, found in best.items() for k, i in enumerate(found[:7]))


def test_angles_spare_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector, "PACK", 16)
    df = spark.createDataFrame([r for r in rows_of_vectors(600, 3) if r[1] is not None], "id long, user int, v array<double>").coalesce(2)
    pivots = vector.choose_pivots(df, "id", "v")
    p = vector.packs(df, "id", "v", None, pivots).collect()
    assert max(len(r.ids) for r in p) == 16 and sum(len(r.ids) for r in p) == 601
    apart = [max((max(a - d, c - b) for a, b, c, d in zip(x.low, x.high, y.low, y.high)), default=0) for x in p for y in p]
    assert sum(g > math.acos(0.9) for g in apart) > 0.1 * len(apart)  # a tenth of the pairs of blocks at the least
    empty = df.limit(0)
    assert vector.similarity_join(empty, "id", "v", df, "id", "v", least=0.5).count() == 0 == vector.similarity_join(df, "id", "v", empty, "id", "v", top=2).count()


def chunks(n=1500, seed=5):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    return [(i, None if i % 97 == 0 else " ".join(["the"] * (i % 3 > 0) + [rng.choice(words) for _ in range(rng.randrange(1, 40))]), None if i % 5 else f"head w{i % 9}") for i in range(n)]


def bm25(rows, question, fields=(1.0, 0.4)):
    words = lambda t: [w for w in "".join(c.lower() if c.isalnum() else " " for c in t or "").split()]
    docs = {}
    for i, *texts in rows:
        tf, size = Counter(), 0.0
        for w, t in zip(fields, texts):
            for x in words(t):
                tf[x] += w
            size += w * len(words(t))
        if tf:
            docs[i] = (tf, size)
    mean = sum(s for _, s in docs.values()) / len(docs)
    out = Counter()
    for term in set(words(question)):
        df = sum(term in tf for tf, _ in docs.values())
        idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
        for i, (tf, size) in docs.items():
            if tf[term]:
                out[i] += idf * tf[term] * 2.2 / (tf[term] + 1.2 * (0.25 + 0.75 * size / mean))
    return sorted(((-round(s, 9), i) for i, s in out.items()))


def test_index_finds_the_best_and_spares_the_rest(spark, monkeypatch):
    rows = chunks()
    monkeypatch.setattr(ix, "BLOCK", 64)
    index = ix.build_index(spark.createDataFrame(rows, "chunk_id long, content string, header string"))
    assert index.blocks.where("term = 'the'").select(F.countDistinct("part")).first()[0] > 4
    asked = ["the w3 w40", "w1 the", "w17 w5 the head", "head", "THE", "nothing-known", "the w3 w3 head w2 w9 w100", None, "..."]
    qs = spark.createDataFrame(list(enumerate(asked)), "q_id long, question string")
    for n in (3, 12, 20):
        got = {}
        for r in ix.text_topk(qs, index, n).collect():
            got.setdefault(r.q_id, []).append((r["rank"], r.chunk_id))
        for k, q in enumerate(asked):
            want = [(j + 1, i) for j, (_, i) in enumerate(bm25(rows, q or "")[:n])]
            assert sorted(got.get(k, [])) == want, (n, q)
    pairs = ix.proposals(ix.asked_terms(qs), index, 12).groupBy("q_id").count()
    spared = {r.q_id: r["count"] for r in pairs.collect()}
    assert spared[0] < 0.5 * len(bm25(rows, asked[0]))


def test_an_index_for_questions_holds_their_terms_and_gives_the_same_rows(spark):
    rows = chunks()
    table = spark.createDataFrame(rows, "chunk_id long, content string, header string")
    asked = ["the w3 w40", "w17 w5 the head", "nothing-known", None]
    qs = spark.createDataFrame(list(enumerate(asked)), "q_id long, question string")
    index = ix.build_index(table, questions=qs)
    assert {r.term for r in index.postings.select("term").distinct().collect()} == {"the", "w3", "w40", "w17", "w5", "head"}
    got = {}
    for r in ix.text_topk(qs, index, 12).collect():
        got.setdefault(r.q_id, []).append((r["rank"], r.chunk_id))
    assert {k: sorted(v) for k, v in got.items()} == {k: [(j + 1, i) for j, (_, i) in enumerate(bm25(rows, asked[k])[:12])] for k in (0, 1)}


def test_later_blocks_pass_on_what_beats_earlier_ones(spark, monkeypatch):
    monkeypatch.setattr(vector, "SPREAD", 1)
    monkeypatch.setattr(vector, "PACK", 16)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(640, 4))
    items = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>").coalesce(1)
    q = items.where("i < 40").select(F.col("i").alias("q"), F.col("v").alias("w"))
    found = vector.similarity_join(q, "q", "w", items, "i", "v", top=5)
    sims = vector.unit(v[:40]) @ vector.unit(v).T
    got = {(r.q_id, r["rank"]): r.item_id for r in found.collect()}
    assert got == {(k, j + 1): int(i) for k in range(40) for j, i in enumerate(np.argsort(-sims[k])[:5])}


def test_an_empty_index(spark):
    index = ix.build_index(spark.createDataFrame([], "chunk_id long, content string, header string"))
    assert ix.text_topk(spark.createDataFrame([(1, "a")], "q_id long, question string"), index).count() == 0


def test_hybrid_search_takes_the_enriched_question_and_the_syntax(spark):
    from lakeline.operators.websearch import positions

    rows = [(i, 1, "f", None, [1.0, float(i)], f"alpha {'beta' if i == 3 else 'gamma'} text number {i}", None, None) for i in range(6)]
    c = spark.createDataFrame(rows, "chunk_id long, doc_id long, file_name string, header string, embedding array<double>, content string, prev_id long, next_id long")
    q = spark.createDataFrame([(1, [1.0, 0.0], "gamma", "beta")], "q_id long, vec array<double>, question string, enriched string")
    asked = q.select(retrieval.asked_text(q).alias("t")).first().t
    assert asked == "beta" and retrieval.asked_text(q.drop("enriched")) is not None
    index = ix.build_index(c)
    found = ix.text_topk(q.select("q_id", retrieval.asked_text(q).alias("question")), index).collect()
    assert [r.chunk_id for r in found] == [3]
    by_syntax = retrieval.hybrid_search(q.withColumn("enriched", F.lit("alpha -gamma")), c, 2, placed=positions(c)).collect()
    assert 3 not in {r.chunk_id for r in retrieval.dense_topk(q, c, 2).collect()} and {r.q_id for r in by_syntax} <= {1}


def test_postings_are_counted_within_rows(spark):
    df = spark.createDataFrame([("a", "x y X"), ("b", "y"), ("b", "y"), ("b", "y z"), ("c", " "), ("d", None)], "chunk_id string, content string")
    assert sorted(tuple(r) for r in retrieval.postings(df).select("term", "chunk_id", "tf", "len").collect()) == [("x", "a", 2, 3), ("y", "a", 1, 3), ("y", "b", 1, 2), ("y", "b", 2, 1), ("z", "b", 1, 2)]
    once = retrieval.postings(df.where("chunk_id <> 'b'"))
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
