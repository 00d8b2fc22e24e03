"""Phrase mining over a weighted de Bruijn graph of words.

Nodes are runs of four words, edges runs of five: an edge joins the node of its first four words to that of its last
four and weighs how often it occurs. Only the longest run that starts at each word is counted: an edge, or what is left
before the end of the piece. A phrase of four words is a node, and occurs as often as its outgoing edges weigh together
plus the ends of pieces it stands at; the same step gives phrases of three, two and one word from the next longer ones.
So the corpus is counted once, whatever the number of lengths. Unary paths, where the node between two edges is left and
entered by nothing else, are compacted into one row: nodes within them occur only inside their edges.

Pieces are also cut between two words whose pair can't reach the least count: pair counts fold into ``2^PAIR_BITS``
buckets (saturating, a fixed size), and a pair in a light bucket is in no phrase of two words or more that is wanted.
The end corrections make up for these cuts as for the others, so counts of all wanted phrases stay exact. When buckets
fill up nothing is cut any more and every edge travels once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeline.llm.common import CHUNK_BYTES, batch, map_batches, mix64, read_table, settle, text_bytes

LONGEST = 5
PAIR_BITS = 24
#: Words held in one numpy step, and distinct words remembered by a task.
STEP_WORDS, MOST_WORDS = 1 << 18, 1 << 17
BLOCK_BITS = 18
_SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz......... ")


def spans(text: bytes, most: int = CHUNK_BYTES) -> Iterator[bytes]:
    """``text`` in parts of about ``most`` bytes, cut only at blanks (a longer word stays whole)."""
    a = 0
    while len(text) - a > most:
        b = text.find(b" ", a + most)
        if b < 0:
            break
        yield text[a:b]
        a = b
    yield text[a:] if a else text


class Words:
    """Numbers for the words of one task; 0 is the end of a piece. Forgets all words when there are too many."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {b".": 0}
        self.names: list[bytes] = [b"."]
        self.hashes = np.zeros(1, np.uint64)

    def look_up(self, tokens: list[bytes]) -> np.ndarray:
        known, n = self.number, len(self.names)
        for w in set(tokens).difference(known):
            known[w] = len(self.names)
            self.names.append(w)
        if len(self.names) > n:
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w) for w in self.names[n:]], np.uint64)])
        return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))


def steps(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], int]]:
    """Runs of ``(word numbers, language numbers, languages, starts)``; only the first ``starts`` words start runs here.

    A step ends with the LONGEST - 1 words that start the next one, so no run is lost at its border. Every text ends
    with the end of a piece.
    """
    langs: dict[str, int] = {}
    parts: list[np.ndarray] = []
    tags: list[np.ndarray] = []
    held = 0

    def drain(last: bool):
        nonlocal held
        ids, tag = np.concatenate(parts), np.concatenate(tags)
        starts = len(ids) if last else len(ids) - LONGEST + 1
        out = (ids, tag, list(langs), starts)
        parts[:], tags[:] = ([], []) if last else ([ids[starts:]], [tag[starts:]])
        held = sum(map(len, parts))
        return out

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), text_bytes(b.column("text"))):
            if not text:
                continue
            tag = langs.setdefault(lang, len(langs))
            for part in spans(text.translate(_SIGNS)):
                tokens = part.replace(b".", b" . ").split()
                parts.append(words.look_up(tokens))
                tags.append(np.full(len(tokens), tag, np.int32))
                held += len(tokens)
                if held > STEP_WORDS:
                    yield drain(False)
            parts.append(np.zeros(1, np.int32))
            tags.append(np.full(1, tag, np.int32))
            held += 1
        if len(words.names) > MOST_WORDS and parts:
            yield drain(True)  # texts are complete here
            words.forget()
    if parts:
        yield drain(True)


def buckets(ids: np.ndarray, tag: np.ndarray, langs: list[str], words: Words) -> np.ndarray:
    """The bucket of each word with its next one, -1 where one of them is the end of a piece."""
    own = np.array([xxhash.xxh64_intdigest(x, seed=7) for x in langs], np.uint64)[tag[:-1]]
    h = words.hashes[ids]
    pair = mix64(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ own)) >> np.uint64(64 - PAIR_BITS)
    return np.where((ids[:-1] > 0) & (ids[1:] > 0), pair.astype(np.int64), -1)


BLOCKS = pa.schema([("block", pa.int32()), ("counts", pa.binary())])


def heavy_pairs(texts: DataFrame, least: int) -> np.ndarray:
    """Bits of the buckets whose pairs occur ``least`` times or more together; 2^PAIR_BITS bits whatever the corpus."""
    kind = np.uint8 if least <= 127 else np.int64
    size = 1 << BLOCK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, words = np.zeros(1 << PAIR_BITS, kind), Words()
        for ids, tag, langs, starts in steps(batches, words):
            at = buckets(ids, tag, langs, words)[:starts]
            at, n = np.unique(at[at >= 0], return_counts=True)
            seen[at] = np.minimum(seen[at] + n, least)
        for k in range(len(seen) // size):
            part = seen[k * size : (k + 1) * size]
            if part.any():
                yield batch(BLOCKS, block=[k], counts=[pa.compress(part.tobytes(), codec="zstd", asbytes=True)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("block").to_pylist(), b.column("counts").to_pylist()):
                part = np.frombuffer(pa.decompress(data, decompressed_size=size * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)
                sums[k] = np.minimum(sums.get(k, 0) + part, least).astype(kind)
        for k, part in sums.items():
            yield batch(BLOCKS, block=[k], counts=[np.packbits(part >= least).tobytes()])

    counted = map_batches(texts, count, "block int, counts binary").repartition(16, "block")
    heavy = np.zeros((1 << PAIR_BITS) // 8, np.uint8)
    for r in map_batches(counted, add, "block int, counts binary").toLocalIterator():  # 2^PAIR_BITS bits
        heavy[r.block * size // 8 : (r.block + 1) * size // 8] = np.frombuffer(r.counts, np.uint8)
    return heavy


RUNS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int32()), ("n", pa.int64())])


def ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for equal rows of the keys, and the place of the first of each. As many keys as fit in 62 bits
    are packed before each sort."""
    code, used, first = np.zeros(len(keys[0]), np.int64), 0, None
    for k in keys:
        bits = int(k.max()).bit_length()
        if used + bits > 62:
            _, first, code = np.unique(code, return_index=True, return_inverse=True)
            used = len(first).bit_length()
        code, used = code << bits | k.astype(np.int64), used + bits
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def longest_runs(texts: DataFrame, heavy: np.ndarray) -> DataFrame:
    """``(lang, phrase, m, n)``: the longest runs of up to LONGEST words that start at each word, with their counts."""
    shared = texts.sparkSession.sparkContext.broadcast(heavy)  # 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for ids, tag, langs, starts in steps(batches, words):
            at = buckets(ids, tag, langs, words)
            go = (at >= 0) & (shared.value[np.maximum(at, 0) >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            go = np.concatenate([go, np.zeros(LONGEST, bool)])
            length = np.where(ids > 0, 1, 0)
            reach = length > 0
            for j in range(LONGEST - 1):
                reach = reach & go[j : j + len(ids)]
                length += reach
            place = np.flatnonzero(length[:starts])
            length = length[place]
            grid = np.stack([np.where(length > j, ids[np.minimum(place + j, len(ids) - 1)], 0) for j in range(LONGEST)])
            if not len(place):
                continue
            code, first = ranks(tag[place], *grid)
            n = np.bincount(code)
            names, take = pa.array(words.names, pa.binary()), grid[:, first]
            columns = [names.take(pa.array(w, mask=w == 0)) for w in take]
            phrase = pc.binary_join_element_wise(*columns, pa.scalar(b" "), null_handling="skip").cast(pa.string())
            yield batch(RUNS, lang=pa.array(langs, pa.string()).take(pa.array(tag[place][first])), phrase=phrase, m=length[first].astype(np.int32), n=n)

    found = map_batches(texts, run, "lang string, phrase string, m int, n long")
    return found.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("n"))


def first_words(phrase, k):
    return F.substring_index(phrase, " ", k)


def last_words(phrase, k: int):
    return F.substring_index(phrase, " ", -k)


def flows(runs: DataFrame) -> dict[int, DataFrame]:
    """``(lang, phrase, n)`` of each length: what flows out of a phrase plus the ends of pieces it stands at."""
    out, longer = {}, None
    for m in range(LONGEST, 0, -1):
        ends = runs.where(F.col("m") == m).select("lang", "phrase", "n")
        if longer is None:
            out[m] = ends
        else:
            both = ends.union(longer.select("lang", first_words("phrase", m).alias("phrase"), "n"))
            out[m] = settle(both.groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
        longer = out[m]
    return out


def unary_paths(edges: DataFrame, nodes: DataFrame, most: int = 1024) -> DataFrame:
    """``(lang, path, n)``: the edges with chains of them joined where the node between is entered and left by one
    edge only, that is, weighs as much as both. Longer chains come as parts of at most ``most`` edges, overlapping by a
    node. Chains are ranked by pointer doubling, so the number of rounds is the logarithm of the longest one."""
    node = nodes.select("lang", F.col("phrase").alias("node"), F.col("n").alias("f"))
    ahead = edges.select("lang", "phrase", "n", last_words("phrase", LONGEST - 1).alias("node"))
    after = edges.select("lang", F.col("phrase").alias("next"), "n", first_words("phrase", LONGEST - 1).alias("node"))
    link = ahead.join(node, ["lang", "node"]).where("n = f").join(after, ["lang", "node", "n"]).select("lang", F.col("next").alias("phrase"), F.col("phrase").alias("to"))
    now = settle(edges.join(link, ["lang", "phrase"], "left").select("lang", "phrase", "n", F.coalesce("to", "phrase").alias("to"), F.col("to").isNotNull().cast("int").alias("rank"), F.col("to").isNull().alias("ready")))
    while now.where(~F.col("ready")).limit(1).count():
        there = now.select("lang", F.col("phrase").alias("to"), F.col("to").alias("on"), F.col("rank").alias("more"), F.col("ready").alias("end"))
        now = settle(now.join(there, ["lang", "to"]).select("lang", "phrase", "n", F.when(F.col("ready"), F.col("to")).otherwise(F.col("on")).alias("to"), F.when(F.col("ready"), F.col("rank")).otherwise(F.col("rank") + F.col("more")).alias("rank"), (F.col("ready") | F.col("end")).alias("ready")))
    part = now.select("lang", "n", "to", "rank", (F.col("rank") / most).cast("int").alias("part"), "phrase")
    chain = part.groupBy("lang", "to", "part", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "phrase"))).alias("e"))
    rest = F.transform(F.slice("e", 2, most), lambda x: last_words(x["phrase"], 1))
    return chain.select("lang", F.concat_ws(" ", F.concat(F.array(F.col("e")[0]["phrase"]), rest)).alias("path"), "n")


def on_paths(paths: DataFrame) -> DataFrame:
    """The phrases of LONGEST words that lie on the paths, and the nodes within a path as ``inner``."""
    words = paths.select("lang", "n", F.split("path", " ", -1).alias("w"))
    return words.select("lang", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - LONGEST + 1), lambda i: F.slice("w", i, LONGEST))).alias("i", "g")).select(
        "lang", F.concat_ws(" ", "g").alias("phrase"), "n", F.when(F.col("i") > 0, F.concat_ws(" ", F.slice("g", 1, LONGEST - 1))).alias("inner")
    )


def collocations(docs: DataFrame, least: int = 100, inside: int = 100, top: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the best phrases of each language of ``docs(lang, text)``.

    Phrases of 2 to 5 words that occur ``least`` times; dropped when ``inside`` per cent or more of the occurrences lie
    in one longer phrase. It is enough to look one word further, since a phrase between the two occurs at least as often
    as the longer one. A null text is empty, a null language ``und``; an empty text or table gives no phrases, repeated
    rows count each time, other columns aren't read. Words are compared byte by byte after A-Z were lower-cased.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    runs = settle(longest_runs(texts, heavy_pairs(texts, least)))
    total = runs.groupBy("lang").agg(F.sum("n").alias("total"))
    by_length = {m: df.where(F.col("n") >= least) for m, df in flows(runs).items()}
    paths = settle(unary_paths(by_length[LONGEST], by_length[LONGEST - 1]))
    edges = on_paths(paths)
    counts = settle(edges.select("lang", "phrase", "n", F.lit(LONGEST).alias("m")).unionByName(_union([df.select("lang", "phrase", "n", F.lit(m).alias("m")) for m, df in by_length.items() if m < LONGEST])))
    inner = edges.where(F.col("inner").isNotNull()).select("lang", F.col("inner").alias("phrase")).distinct()
    many = counts.where("m >= 2")
    over = many.where("m >= 3").select("lang", F.col("n").alias("f"), F.explode(F.array(F.expr("substring_index(phrase, ' ', m - 1)"), F.expr("substring_index(phrase, ' ', 1 - m)"))).alias("phrase"))
    over = over.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    kept = many.join(inner, ["lang", "phrase"], "left_anti") if inside <= 100 else many  # nodes within a path lie wholly in its edges
    kept = kept.join(over, ["lang", "phrase"], "left").where(F.coalesce(F.lit(100) * F.col("f") < F.lit(inside) * F.col("n"), F.lit(True)))
    cut = kept.select("lang", "phrase", "m", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cut = cut.withColumns({"left": F.expr("substring_index(phrase, ' ', k)"), "right": F.expr("substring_index(phrase, ' ', k - m)")})
    part = counts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    cut = cut.join(part, ["lang", "left"]).join(part.toDF("lang", "right", "r"), ["lang", "right"]).join(total, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(total as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = cut.groupBy("lang", "phrase", "a", "total").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b"))
    best = best.select("lang", "phrase", "a", "b.l", "b.r", F.col("total").alias("n"), "b.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    dealt = best.withColumn("hand", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = dealt.withColumn("at", F.row_number().over(Window.partitionBy("lang", "hand").orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


#: Counts every run of one to five words by itself, without graph, cuts or paths.
ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS MATERIALIZED (SELECT lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS phrase, count(*) AS a FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE i + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
long AS (SELECT lang, a, string_split(phrase, ' ') AS w, m FROM f WHERE m >= 3),
within AS (SELECT DISTINCT l.lang, l.a, array_to_string(list_slice(l.w, s, s + k - 1), ' ') AS phrase FROM long l, (SELECT unnest([2, 3, 4]) AS k), (SELECT unnest([1, 2, 3, 4]) AS s) WHERE k < l.m AND s + k - 1 <= l.m),
most AS (SELECT lang, phrase, max(a) AS longer FROM within GROUP BY ALL),
c AS (SELECT f.lang, f.phrase, f.a, f.m, string_split(f.phrase, ' ') AS w FROM f LEFT JOIN most USING (lang, phrase) WHERE f.m >= 2 AND NOT coalesce(100 * longer >= 100 * f.a, false)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(list_slice(w, 1, k), ' ') AS x, array_to_string(list_slice(w, k + 1, m), ' ') AS y FROM c, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < m),
scored AS (SELECT cuts.lang, cuts.phrase, cuts.a, k, fx.a AS l, fy.a AS r, n.n AS n, (CAST(1000 AS HUGEINT) * cuts.a * n.n) // (CAST(fx.a AS HUGEINT) * fy.a) AS score
  FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    """``collocations`` with the contract's parameters on the whole table ``documents``; see there for odd rows."""
    return collocations(read_table(spark, sf_dir, "documents"))
