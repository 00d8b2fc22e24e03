from collections import Counter

import pytest

from lakeline.llm import decontaminate as dc


def grams(text, size=5):
    w = (text or "").lower().split()
    return w, [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def brute(text, item):
    iw, ig = grams(item)
    if not iw:
        return None
    size = min(5, len(iw))
    ig = grams(item, size)[1]
    dw, dg = grams(text, size)
    if not dw:
        return None
    n, want, best = len(ig), Counter(ig), None
    for a in range(max(1, len(dg) - n + 1)):
        have = Counter(dg[a : a + n])
        low, high = sum((have & want).values()), sum((have | want).values())
        if low >= 0.8 * high and (best is None or low / high > best[1]):
            best = (a, low / high)
    return best


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = {}
    texts = {d.doc_id: d.text for d in docs.collect()}
    bench = {i.item_id: i.text for i in items.collect()}
    first = {}
    for i, t in bench.items():
        for g in grams(t)[1]:
            first.setdefault(g, set()).add(i)
    for d, t in texts.items():
        for i in {i for g in grams(t)[1] for i in first.get(g, ())}:
            b = brute(t, bench[i])
            if b:
                want[d, i] = b
    got = {(r.doc_id, r.item_id): (r.start_word, r.similarity) for r in dc.op4_decontaminate(spark, "/root/testdata/sf0.01").collect()}
    assert want and set(got) <= set(want) and len(got) >= 0.97 * len(want)
    exact = {k for k, v in want.items() if v[1] == 1}
    assert exact <= set(got)
    assert all(got[k] == pytest.approx(want[k]) for k in exact)
    assert dc.contaminated(docs, items, items_a_pass=11).count() == len(got)


def test_edited_passages_are_found():
    item = " ".join(f"w{i}" for i in range(60))
    index = dc.Items([(7, item), (8, "a b"), (9, None), (10, " ")])
    lead = " ".join(f"x{i}" for i in range(500))
    assert index.matches(f"{lead} {item.upper()} {lead}".encode()) == [(7, 500, 60, 1.0)]
    assert [m[0] for m in index.matches(f"{lead} {item.replace('w30 ', 'zz ')} {lead}".encode())] == [7]
    assert index.matches(f"q A b c".encode()) == [(8, 1, 2, 1.0)]
    assert index.matches(" ".join(f"w{i}" for i in range(58)).encode())[0][0] == 7
    assert index.matches(lead.encode()) == [] and index.matches(b"") == []


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b c d e f", 1), (4, "a b c d e f", 2), (4, "a b c d e f", 2), (5, "z " * 200_000 + "a b c d e f", 3)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, "A b c d e f"), (2, None)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in dc.contaminated(docs, bench).collect())
    assert got == [(0, 1), (4, 1), (4, 1), (5, 1)]
    assert dc.contaminated(docs.limit(0), bench).count() == dc.contaminated(docs, bench.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in dc.drop_contaminated(docs, bench).collect()) == [0, 1, 2]
