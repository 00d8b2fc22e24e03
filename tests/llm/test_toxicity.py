import random
import zlib
from collections import Counter

import numpy as np
import pytest

from lakeline.llm import toxicity


def test_op13_on_held_out_texts(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op13_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(got) == 10000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.score >= 0.3) for r in got)
    seen = Counter((r.toxic, r.predicted) for r in got if r.held_out and r.toxic is not None)
    assert seen[1, 1] >= 0.92 * (seen[1, 0] + seen[1, 1]) and seen[0, 1] <= 0.01 * (seen[0, 0] + seen[0, 1])
    brier = np.mean([(r.score - r.toxic) ** 2 for r in got if r.held_out and r.toxic is not None])
    assert brier < 0.02


def texts(n=900, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        rows.append((i, " ".join(rng.choice(["nastyword", "vilething"] if bad and rng.random() < 0.3 else words) for _ in range(30))))
        if i % 18 < 6:
            labels.append((i, int(bad)))
    return rows, labels


def test_unlabelled_toxic_texts_are_found(spark):
    rows, labels = texts()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, known)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.3) == (i % 6 == 0) for i, _ in rows)
    again = toxicity.learn(docs.repartition(3), known.repartition(5))
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias


def test_gradients_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(2)), sorted(rng.choice(5, size=int(rng.integers(4)), replace=False).tolist()), int(rng.integers(1, 9))) for _ in range(60)]
    rows = [(t, at, rng.random(len(at)).round(2).tolist(), n) for t, at, n in rows]
    df = spark.createDataFrame(rows, "toxic int, at array<int>, x array<float>, n long").repartition(4)
    w = rng.normal(size=6)
    want = np.zeros((3, 8))
    for toxic, at, x, n in rows:
        v = np.zeros(6)
        v[at], v[5] = np.float32(x), 1
        g = v @ w
        p = 1 / (1 + np.exp(-g))
        for side, slope, loss, of in ((0, p - 1, np.log1p(np.exp(-g)), n * toxic), (1, p, np.log1p(np.exp(g)), n * toxic), (2, p, np.log1p(np.exp(g)), n)):
            want[side] += of * np.concatenate([slope * v, [loss, 1]])
    assert np.allclose(toxicity.gradients(df, w), want, atol=1e-3)


def features(word):
    return set(toxicity.word_features([word])[0].tolist())


def test_counts_of_whole_texts(monkeypatch):
    lexicon = toxicity.Lexicon()
    long = b"Foobar, foo! " * 700_000  # several parts
    row, f, n, words = lexicon.counts([b"foo bar", long, None, b"1 2 ?", b"bar bar"])
    assert words.tolist() == [2, 1_400_000, 0, 0, 2] and set(n[row == 1].tolist()) == {700_000}
    assert set(f[row == 1].tolist()) == features(b"foobar") | features(b"foo") and set(n[row == 4].tolist()) == {2} and 2 not in row and 3 not in row
    assert len(features(b"foobarbazqux")) == 6 and len(features(b"foob")) == 1
    assert features(b"foobarx") & features(b"foobary") and len(features(b"foobarx") & features(b"foobary")) == 3
    monkeypatch.setattr(toxicity, "STEP_BYTES", 5)
    again = toxicity.Lexicon().counts([b"foo bar", b"Foobar, foo! " * 9, None, b"1 2 ?", b"bar bar"])
    assert [x[row == 0].tolist() for x in (f, n)] == [x[again[0] == 0].tolist() for x in again[1:3]]
    picked = np.array(sorted(features(b"foobar")))
    row, f, n, _ = toxicity.Lexicon(picked).counts([b"x foobar foobaz", b"y", b"foobar foobar"])
    assert f[row == 2].tolist() == list(range(len(picked))) and set(n[row == 2].tolist()) == {2} and len(f[row == 0]) == len(picked) and 1 not in row


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 1)], [(1, 0)], [(1, 1)], [(1, 1), (1, 0), (2, 0), (77, 0)]])
def test_odd_rows(spark, labels):
    schema = "doc_id long, text string, score string, toxic string, features int"
    rows = [(1, "x y z", "s", "t", 1), (1, "x y z", "s", "t", 1), (2, None, "s", "t", 1), (None, "x", "s", "t", 1), (3, "", "s", "t", 1)]
    model = toxicity.learn(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(spark.createDataFrame(rows, schema), model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(spark.createDataFrame([], schema), model).count() == 0
