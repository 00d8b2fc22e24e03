"""Benchmark decontamination with SimHash windows and a multi-index of Hamming blocks.

For every benchmark item the windows of its size in words are fingerprinted over the whole text. Fingerprints within
``RADIUS`` bits agree to within RADIUS // 4 bits in at least one of four 16-bit blocks, so tables of all block values
that near give every window within the radius; candidates are then checked by the exact similarity of the weighted
(repeats counted) five-word shingles. A window without a single shingle of an item has no similarity with any, so only windows
that hold one are fingerprinted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.llm.common import batch, map_batches, read_table, settle, text_bytes
from lakeline.llm.simhash import fingerprint, shingle_codes

SIZE, LEAST = 5, 0.8
#: Two texts at similarity 0.8 differ in 9.7 of 64 bits on average; 15 bits hold 98 of 100 such windows.
RADIUS, BLOCKS = 15, 4
#: Items in one pass over the documents; their tables take about 32 KB an item. More items take more passes.
ITEMS_A_PASS = 1000
#: Shingles of a text whose windows are counted at once.
STRETCH = 1 << 15

NEAR = np.array(sorted(sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), n)), dtype=np.uint16)


class Items:
    """The items of one pass: shingles, fingerprints and block tables by size."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids: list[int] = []
        self.bags: list[dict[int, int]] = []
        by: dict[tuple[int, int], list[int]] = {}
        fps = []
        for item, text in rows:
            b = (text or "").encode()
            words = len(b.split())
            if not words:
                continue
            size = min(SIZE, words)
            h = shingle_codes(b, size)
            values, counts = np.unique(h, return_counts=True)
            by.setdefault((size, len(h)), []).append(len(self.ids))
            self.ids.append(item)
            self.bags.append(dict(zip(values.tolist(), counts.tolist())))
            fps.append(fingerprint(h))
        self.fps = np.array(fps, dtype=np.uint64)
        self.groups = {k: np.array(v) for k, v in by.items()}
        self.sizes = sorted({size for size, _ in by})
        self.known, self.quick, self.tables = {}, {}, {}
        for size in self.sizes:
            mine = [i for (s, _), v in by.items() if s == size for i in v]
            self.known[size] = np.unique(np.array([h for i in mine for h in self.bags[i]], dtype=np.uint64))
            self.quick[size] = np.zeros(1 << 20, dtype=bool)
            self.quick[size][(self.known[size] & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        for key, own in self.groups.items():
            planes = np.zeros((-(-len(own) // 8), BLOCKS, 1 << 16), dtype=np.uint8)
            for j, i in enumerate(own):
                for b in range(BLOCKS):
                    planes[j // 8, b, NEAR ^ np.uint16(int(self.fps[i]) >> 16 * b & 0xFFFF)] |= 1 << j % 8
            self.tables[key] = planes

    def windows(self, bits: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of all windows of ``n`` shingles from running bit counts."""
        over = (bits[n:] - bits[:-n]) * 2 > n
        return np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()

    def search(self, h: np.ndarray, hits: np.ndarray, size: int, n: int) -> Iterator[tuple[int, int]]:
        """(window start, item index) of every window of ``n`` shingles that holds one of the shingles at ``hits`` and is
        within RADIUS bits of an item of that size."""
        own = self.groups[size, n]
        if len(h) <= n:
            spans = [(0, np.array([fingerprint(h)], dtype=np.uint64))]
        else:
            def stretches():
                cuts = np.flatnonzero(np.diff(hits) > n) + 1
                for own_hits in np.split(hits, cuts):
                    low, high = max(0, int(own_hits[0]) - n + 1), min(len(h) - n, int(own_hits[-1])) + 1
                    for a in range(low, high, STRETCH):
                        part = h[a : min(a + STRETCH, high) + n - 1]
                        bits = np.zeros((len(part) + 1, 64), dtype=np.int32)
                        np.cumsum(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, out=bits[1:], dtype=np.int32)
                        yield a, self.windows(bits, n)

            spans = stretches()
        for a, fps in spans:
            for p, plane in enumerate(self.tables[size, n]):
                hit = plane[0][fps & np.uint64(0xFFFF)]
                for b in range(1, BLOCKS):
                    hit = hit | plane[b][(fps >> np.uint64(16 * b)) & np.uint64(0xFFFF)]
                at = np.flatnonzero(hit)
                for j in range(min(8, len(own) - 8 * p)):
                    i = int(own[8 * p + j])
                    near = at[(hit[at] >> j & 1) == 1]
                    near = near[np.bitwise_count(fps[near] ^ self.fps[i]) <= RADIUS]
                    for x in near.tolist():
                        yield a + x, i

    def matches(self, text: bytes | None) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window of each item that reaches LEAST."""
        best: dict[int, tuple[float, int, int]] = {}
        for size in self.sizes:
            h = shingle_codes(text, size)
            if not len(h):
                continue
            may = np.flatnonzero(self.quick[size][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            known = self.known[size]
            hits = may[known[np.minimum(np.searchsorted(known, h[may]), len(known) - 1)] == h[may]]
            if not len(hits):
                continue
            common = set(h[hits].tolist())
            for (s, n), own in self.groups.items():
                if s != size or not any(not common.isdisjoint(self.bags[i]) for i in own):
                    continue
                for a, i in self.search(h, hits, size, n):
                    bag = self.bags[i]
                    values, counts = np.unique(h[a : a + n], return_counts=True)
                    least = sum(min(bag.get(v, 0), c) for v, c in zip(values.tolist(), counts.tolist()))
                    total = int(counts.sum()) + sum(bag.values()) - least
                    if least >= LEAST * total and (least / total, -a) > best.get(i, (0.0, 1))[:2]:
                        best[i] = (least / total, -a, min(n, len(h)) + size - 1)
        return [(self.ids[i], -a, words, sim) for i, (sim, a, words) in sorted(best.items())]


FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """``doc_id, item_id, start_word, n_words, similarity``: for each document and item the best window that reaches
    similarity 0.8 (the first of equals).

    Words are separated by ASCII white space and A-Z lower-cased. Null or blank texts and items match nothing; an item
    of fewer than five words is one shingle; a text shorter than an item is one window. Repeated documents and items
    give repeated rows; an empty side gives an empty table. Items with a null item_id are searched too. Only
    ``items_a_pass`` items are shipped to the tasks at once; each further block of items is one more pass.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = settle(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")))
    passes = max(1, -(-rows.count() // items_a_pass))
    out = None
    for k in range(passes):
        mine = rows if passes == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast([(r.item_id, r.text) for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(shared.value)
            for b in batches:
                got = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b.column("text"))) if t for m in items.matches(t)]
                if got:
                    yield batch(FOUND, **dict(zip(FOUND.names, map(list, zip(*got)))))

        part = map_batches(plain, run, "doc_id long, item_id long, start_word long, n_words long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; all columns are kept.

    Rows with a null doc_id can't be told apart; they stay.
    """
    found = settle(contaminated(docs, benchmark).select("doc_id").distinct())
    return docs.join(found, "doc_id", "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """``contaminated`` on the whole tables ``documents`` and ``benchmark``; see there for odd rows."""
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
