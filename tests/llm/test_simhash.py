import random

import numpy as np
import xxhash

from lakeline.llm import simhash


def brute_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    comp = {d: d for d in fps}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {d: root(d) for d in ids}


def test_op5_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fps = {r.doc_id: brute_fp(r.text) for r in docs.collect()}
    want = brute_components(fps)
    got = simhash.op5_simhash(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.fingerprint for r in got} == {d: f"{x:016x}" for d, x in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == want


def test_links_connect_dense_and_sparse_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(6)]
    fps = set()
    for b in base:
        for _ in range(150):
            x = b
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(simhash.signed(x), d) for d, x in fps.items()], "fp long, rep long")
    from lakeline.llm.common import components

    got = {d: d for d in fps} | {r.node: r.component for r in components(simhash.links(df)).collect()}
    assert got == brute_components(fps)


def test_pigeonring_holds_for_every_near_pair():
    rnd = random.Random(3)
    for _ in range(2000):
        x = 0
        for b in rnd.sample(range(64), rnd.randint(0, 3)):
            x |= 1 << b
        assert any(simhash.within(np.array([x], dtype=np.uint64), s, 3)[0] for s in range(4))


def test_edges(spark):
    docs = spark.createDataFrame([(5, None, 1), (3, "", 2), (3, "", 2), (None, "a b", 3), (7, "A b", 4)], "doc_id long, text string, fp int")
    got = {(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()}
    assert got == {(5, 3), (3, 3), (None, 7), (7, 7)}
    assert simhash.classes(docs.limit(0)).count() == 0
    assert simhash.keep_one(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.keep_one(docs).collect()) == [0, 3, 7]


def brute_near(docs, least=0.8):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {d: grams(t) for d, t in docs.items()}
    at = {}
    for d, s in sets.items():
        for g in s:
            at.setdefault(g, []).append(d)
    pairs = {(a, b) for ds in at.values() for i, b in enumerate(ds) for a in ds[:i]}
    return [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]


def test_near_duplicates_find_all_similar_pairs(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    want = brute_near({r.doc_id: r.text for r in d.collect()})
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(d).collect()}
    assert len(comp) == d.count()
    assert sum(comp[a] == comp[b] for a, b in want) >= 0.99 * len(want)
    linked = {x for p in want for x in p}
    assert all(comp[x] == x for x in comp if x not in linked)


def test_copies_with_different_edits_meet_their_original(spark, monkeypatch):
    monkeypatch.setattr(simhash, "MEMBERS", 256)  # so that buckets are dealt out as pairs of blocks
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    original, middle = [word() for _ in range(304)], 500
    docs = [(middle, " ".join(original))]
    for d in [*range(middle), *range(middle + 1, 1001)]:
        copy = list(original)
        for k in range(6):
            copy[25 + 50 * k + rnd.randrange(-20, 20)] = word()
        docs.append((d, " ".join(copy)))
    docs += [(d, " ".join(word() for _ in range(304))) for d in range(2000, 2100)]
    near = {x for d, t in docs if d != middle for pair in brute_near({middle: docs[0][1], d: t}) for x in pair} - {middle}
    assert len(near) >= 900
    comp = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(comp[d] == comp[middle] for d in near) >= 0.99 * len(near)
    assert all(comp[d] == d for d in range(2000, 2100))
