import random
import re
from collections import Counter

import pytest
from oracle import same_as_sql

from lakeline.llm import phrases


def test_op12_equals_its_sql(spark):
    assert same_as_sql(spark, phrases.op12_phrases, phrases.ORACLE, "/root/testdata/sf0.01", ["documents"]) > 0


def brute(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    out = {}
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    inside = {(lang, w[i : i + m]) for (lang, w), a in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if a >= f[lang, w[i : i + m]]}
    for (lang, w), a in found.items():
        if (lang, w) in inside:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, r) in enumerate(sorted(rows)[:top]))


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["a", "b", "B", "ab", "é", "日本", "x-y", "q"]
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ",", "\x0b"]) for _ in range(rng.randrange(40)))
        rows.append((rng.choice(["en", "de", None, ""]), text + (passage if i % 7 == 0 else "") + (" ha ha ha ha ha ha ha ha" if i % 5 == 0 else "")))
    return rows


@pytest.mark.parametrize("least,top", [(2, 2000), (5, 30), (40, 7)])
def test_small_corpora_against_brute_force(spark, least, top):
    rows = corpus(least)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(7)
    assert rows_of(phrases.collocations(df, least=least, top=top)) == brute(rows, least, top)


def test_steps_and_texts_larger_than_a_step(spark, monkeypatch):
    rows = corpus(9) + [("en", "p1 p2 p3 " * 5000)]
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    whole = brute(rows, 3, 50)
    monkeypatch.setattr(phrases, "STEP_WORDS", 50)
    b = df.toArrow().to_batches()
    words = phrases.Words()
    small = [(len(ids), starts) for ids, _, _, starts in phrases.steps(iter(b), words)]
    assert len(small) > 100 and sum(s for _, s in small) == sum(len(t.translate(str.maketrans(dict.fromkeys(",;:!?\n\x0b\x0c\r", ".")))
                                              .replace(".", " . ").split()) + 1 for _, t in rows if t)
    assert rows_of(phrases.collocations(df, least=3, top=50)) == whole


def test_spans_lose_nothing_and_cut_at_blanks():
    text = b"aaa bb cccccccccc d " * 50 + b"e" * 100
    parts = list(phrases.spans(text, 7))
    assert b"".join(parts) == text and b" ".join(parts).split() == text.split()


def test_unary_paths_join_what_nothing_else_enters(spark):
    runs = {"a b c d e": 9, "b c d e f": 9, "c d e f g": 9, "d e f g h": 4, "d e f g i": 5}
    nodes = {"b c d e": 9, "c d e f": 9, "d e f g": 9}
    frame = lambda d: spark.createDataFrame([("en", p, n) for p, n in d.items()], "lang string, phrase string, n long")
    got = {(r.path, r.n) for r in phrases.unary_paths(frame(runs), frame(nodes)).collect()}
    assert got == {("a b c d e f g", 9), ("d e f g h", 4), ("d e f g i", 5)}
    chain = [f"w{i}" for i in range(900)]
    edges = {" ".join(chain[i : i + 5]): 3 for i in range(896)}
    inner = {" ".join(chain[i : i + 4]): 3 for i in range(897)}
    got = {r.path for r in phrases.unary_paths(frame(edges), frame(inner), most=400).collect()}
    assert got == {" ".join(chain[:404]), " ".join(chain[400:804]), " ".join(chain[800:])}
    assert {r.phrase for r in phrases.on_paths(phrases.unary_paths(frame(edges), frame(inner), most=400)).collect()} == set(edges)


def test_odd_rows(spark):
    schema = "lang string, text string, phrase string, n int, rank int"
    rows = [("en", None, "x", 1, 1), ("en", "", "x", 1, 1), ("en", " . ,\n", "x", 1, 1), (None, "u v u v", "x", 1, 1), (None, "u v u v", "x", 1, 1)]
    got = rows_of(phrases.collocations(spark.createDataFrame(rows, schema), least=2))
    assert got == brute([r[:2] for r in rows], 2, 2000) and {r[0] for r in got} == {"und"}
    assert rows_of(phrases.collocations(spark.createDataFrame([], schema))) == []
