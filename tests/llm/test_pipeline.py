import numpy as np
from test_decontaminate import brute
from test_packing import check
from test_simhash import brute_near
from test_substrings import brute_cover, words

import corpus_pipeline
from lakeline.llm import packing
from lakeline.llm.common import settle


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    before = spark.read.parquet(f"{d}/documents.parquet")
    columns = before.dtypes
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, before, d))
        assert after.dtypes == columns
        kept[name] = ({r.doc_id: r.text for r in before.collect()}, {r.doc_id: r.text for r in after.collect()})
        before = after

    had, left = kept["quality_rules"]
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(left[x] == had[x] for x in left)
    assert sum(good[x] == 0 for x in left if x in good) <= 0.05 * sum(q == 0 for q in good.values()) + 1

    had, left = kept["near_dedup"]
    root = {x: x for x in had}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_near(had):
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = {x for x in had if root[x] == x}
    assert want <= set(left) and len(left) <= len(want) + 1 and all(left[x] == had[x] for x in left)

    had, left = kept["substring_dedup"]
    cover = brute_cover(had)
    assert all(left[x] == had[x] for x in left if len(words(left[x])) == len(words(had[x])))
    again = brute_cover(left)
    assert sum(map(len, again.values())) <= 0.02 * sum(map(len, cover.values()))
    seen = set()
    for x in sorted(had):  # nine of ten words that were cut lie in five-word shingles that occur earlier
        w = words(had[x])
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        earlier, own = set(), set()
        for i, g in enumerate(grams):
            if g in seen or g in own:
                earlier.update(range(i, i + 5))
            own.add(g)
        seen |= own
        assert len(w) - len(words(left.get(x, ""))) <= len(earlier) / 0.9

    had, left = kept["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    exact = {x for x, t in had.items() for i in items if " ".join(words(i)) in " ".join(words(t))}
    assert exact and not exact & set(left)
    assert all(any(brute(had[x], i) for i in items) for x in set(had) - set(left))

    rows = settle(corpus_pipeline.STAGES[-1][1](spark, before, d)).collect()
    n = check(rows, {x: t for x, t in list(left.items())[:40]})
    assert n <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def test_run_over_empty_documents(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
