import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lakeline.llm import packing


def tokens(text):
    from tokenizers import Tokenizer

    t = getattr(tokens, "t", None) or Tokenizer.from_file(packing.tokenizer_path())
    tokens.t = t
    return t.encode(text or "", add_special_tokens=False).ids + [0]


TEXTS = [None, "", " \n", "Hello, World!! it's 12 o'clock.", "ÉCOLE  naïve x y ÄÖÜ. ß… école", "<|endoftext|> a <|ENDOFTEXT|> b<|startoftext|>C", "日本語 text 日本。 a.b,c. ... 3.14, x!?", "ΟΔΟΣ. İstanbul, ﬁn ǅ", "a\x00b\x1cc d\x85e", "İ. İ! ½. x…! é́. ŉ, (ab).%%% 3.! x'S' it's'.' don't!'", "\u0958. 1, ²! ..a a.. _x_ #|y|#", "\xa0a\u2003b.\u3000<|endoftext|>\u2028C's\x85 \x1fd\x1e e\u200bf " + "wörd\xa0" * 20_000]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_tokenizers(text):
    ids, sizes = packing.WordEncoder(packing.tokenizer_path()).encode(pa.array([text, "x"]))
    assert ids[: sizes[0]].tolist() == tokens(text)


def test_slices_of_a_batch_are_read_at_their_place():
    texts = [f"Wort{i} È{i * 7}. " * (i % 5) for i in range(300)]
    ids, sizes = packing.WordEncoder(packing.tokenizer_path()).encode(pa.array(texts).slice(100, 150))
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [tokens(t) for t in texts[100:250]]


def check(rows, texts, capacity=2048):
    """Every id once, in place, no overlap; returns the number of sequences."""
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append(r)
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    for d, text in texts.items():
        ids = np.array(tokens(text), dtype="<u4")
        own = sorted(by[d], key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), capacity)) and sum(r.length for r in own) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    return len(seqs)


def test_op7_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.op7_packing(spark, "/root/testdata/sf0.001").collect()
    n = check(rows, texts)
    assert n <= packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def test_exchange_between_partitions_saves_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    alone = len({r.sequence_id for r in packing.pack(docs, part_rows=100, rounds=0).collect()})
    rows = packing.pack(docs, part_rows=100).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.limit(20).collect()})
    assert n < alone and n <= 1.01 * packing.lower_bound(np.array([r.length for r in rows]), 2048) + 1


def optimum(items, cap):
    best = len(items)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= cap:
                go(i + 1, bins[:j] + [bins[j] + items[i]] + bins[j + 1 :])
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best


def test_bounds_hold_and_best_fit_is_best_fit():
    rnd = random.Random(5)
    for _ in range(150):
        items = sorted((rnd.randint(1, 20) for _ in range(rnd.randint(1, 8))), reverse=True)
        lengths = np.array(items)
        bins, offsets, fill = packing.best_fit_decreasing(lengths, 20)
        best = optimum(items, 20)
        assert packing.lower_bound(lengths, 20) <= best <= len(fill)
        for bins, offsets, fill in (packing.tighten(lengths, 20), packing.pack_lengths(lengths, 20)[:3]):
            assert len(fill) >= best and fill.max() <= 20 and fill.sum() == sum(items)
            for k in range(len(fill)):
                at = np.flatnonzero(bins == k)
                at = at[np.argsort(offsets[at])]
                assert offsets[at].tolist() == (np.cumsum(lengths[at]) - lengths[at]).tolist()
        fill = packing.best_fit_decreasing(lengths, 20)[2]
        own = []
        for n in items:
            fits = [k for k, f in enumerate(own) if f + n <= 20]
            k = max(fits, key=lambda k: own[k]) if fits else len(own)
            own[k:] = [own[k] + n, *own[k + 1 :]] if fits else [n]
        assert sorted(own) == sorted(fill.tolist())


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (2, "", 2), (None, "a b", 3), (4, "word " * 5000, 4)], "doc_id long, text string, offset int")
    rows = packing.pack(docs, with_ids=True).collect()
    assert sum(r.length for r in rows) == sum(len(r.ids) for r in rows) == 1 + 1 + 1 + 3 + 5001
    assert len({r.sequence_id for r in rows}) == 3
    assert packing.pack(docs.limit(0)).count() == 0
