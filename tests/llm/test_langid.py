import zlib

import numpy as np
from pyspark.sql import functions as F

from lakeline.llm import langid


def test_codewords_differ_from_each_other():
    for n in (2, 3, 4, 5, 9, 40):
        code = langid.codewords(n)
        gaps = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(gaps) >= (1 if n == 2 else 2) and code.shape[0] == n


def test_op1_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = langid.op1_langid(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)


def test_weights_against_brute_force(spark):
    texts = [("aa", "abab ba"), ("bb", "cdcd dc"), ("cc", "efef fe")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(texts)], "doc_id long, lang string, text string")
    model = langid.fit(langid.count_ngrams(df))
    counts = {lang: np.zeros(langid.FEATURES) for lang, _ in texts}
    for lang, t in texts:
        for g in langid.ngrams(t.encode()):
            for x in g:
                counts[lang][x] += 1
    size = np.median([c.sum() for c in counts.values()])
    for k in range(model.code.shape[1]):
        sides = [np.mean([counts[lang] / counts[lang].sum() for lang, c in zip(model.languages, model.code[:, k]) if c == s], axis=0) * size + 0.5 for s in (1, -1)]
        assert np.allclose(model.weights[:, k], np.log(sides[0] / sides[0].sum()) - np.log(sides[1] / sides[1].sum()), atol=1e-5)
    assert [r.lang_pred for r in langid.predict(df, model).orderBy("doc_id").collect()] == ["aa", "bb", "cc"]


def test_edges(spark):
    train = spark.createDataFrame([("en", "the of and"), ("de", "der die und")], "lang string, text string")
    model = langid.fit(langid.count_ngrams(train))
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 ... §", 0.5), (3, "12 ... §", 0.5), (None, "日", 0.5), (5, "the and of " * 900_000, 0.5)], "doc_id long, text string, score double")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.predict(docs, model).collect())
    assert got[1:5] == [(1, "und"), (2, "und"), (3, "und"), (3, "und")] and got[5] == (5, "en") and got[0][1] in ("de", "en")
    empty = langid.fit(langid.count_ngrams(train.limit(0)))
    assert {r.lang_pred for r in langid.predict(docs.limit(3), empty).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0
