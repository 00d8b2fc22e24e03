import math
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeline.llm import quality


def brute(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


CASES = [None, "", " \n\t", "a b c d e a b c d e", "x\nx\n x\n\n\nx", "é ö ### a|b <i>\x0bq\x0cq", "to be or not " * 50, "  nbsp word", "w" * 100_000]


@pytest.mark.parametrize("text", CASES)
def test_base_counts(text):
    assert quality.text_stats(None if text is None else text.encode())[:5] == brute(text)


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judge(docs).collect():
        n = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r.base_failed and r.kept)


def plain_em(votes):
    """Expectation-maximisation document by document, from the definition."""
    names = range(len(votes[0]))
    good = [(sum(x > 0 for x in d) + 1) / (sum(x > 0 for x in d) + 3 * sum(x < 0 for x in d) + 2) for d in votes]
    for _ in range(300):
        prior = sum(good) / len(good)
        rate = {}
        for j in names:
            for cls in (0, 1):
                for k in (-1, 0, 1):
                    own = sum((g if cls else 1 - g) for d, g in zip(votes, good) if d[j] == k)
                    total = sum(g if cls else 1 - g for g in good)
                    extra = quality.PRIOR * len(votes)
                    rate[j, cls, k] = (own + extra * quality.EXPECTED[cls][k + 1]) / (total + extra)
        new = []
        for d in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[j, 1, d[j]] / rate[j, 0, d[j]]) for j in names if d[j])
            new.append(1 / (1 + math.exp(-odds)))
        moved = max(abs(a - b) for a, b in zip(good, new))
        good = new
        if moved < 1e-9:
            break
    return good


def test_posterior_equals_a_plain_estimation(spark):
    rows = quality.judge(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    names = [f"vote_{r}" for r in quality.votes()]
    want = plain_em([[r[n] for n in names] for r in rows])
    assert all(abs(r.posterior - p) < 1e-6 for r, p in zip(rows, want))
    assert all(r.kept == (p >= 0.5 and not r.base_failed) for r, p in zip(rows, want) if abs(p - 0.5) > 1e-6)


def test_verdicts_follow_the_labels_and_beat_all_must_pass(spark):
    d = "/root/testdata/sf0.1"
    one_bad = F.least(*(F.col(f"vote_{r}") for r in quality.votes())) < 0
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet")).withColumn("passes", ~one_bad)
    rows = judged.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").select("quality", "kept", "passes").collect()
    share = lambda of, by: sum(r[by] for r in rows if r.quality == of) / sum(r.quality == of for r in rows)
    assert share(1, "kept") >= 0.995 and share(0, "kept") <= 0.005
    assert share(1, "passes") <= 0.96
    outvoted = judged.where("kept AND NOT passes").count()
    assert outvoted > 100


def test_one_bad_vote_can_be_outvoted():
    names = [f"r{i}" for i in range(5)]
    rows = [(1,) * 5] * 700 + [(-1,) * 5] * 200 + [(-1, 1, 1, 1, 1)] * 100  # r0 errs on one of eight good documents
    table = pd.DataFrame(rows, columns=names).value_counts().reset_index(name="n")
    fitted, rates = quality.fit(table, names)
    got = {tuple(r[n] for n in names): r.posterior for _, r in fitted.iterrows()}
    assert got[(-1, 1, 1, 1, 1)] > 0.99 and got[(-1,) * 5] < 0.01
    assert abs(rates.set_index(["rule", "of"]).loc[("r0", "good"), "vote_-1"] - 0.125) < 0.01


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x", 5), (1, "a b c", "y", 6), (1, "a b c", "y", 6), (None, "", "z", 7)], "doc_id long, text string, n_words string, kept int")
    rows = quality.judge(docs).collect()
    assert len(rows) == 4 and all(r.base_failed and r.kept is False for r in rows)
    assert quality.judge(docs.limit(0)).count() == 0
