"""A built index for ranked full-text search: impacts of terms in blocks, with the bounds that spare most of them.

Building it reads all texts once. A posting's impact is its whole share of a chunk's BM25 score, with weights by field.
Postings of a term are held in levels of impact, large ones cut further by a hash of the chunk, and each such block
keeps its largest impact; each term keeps its best chunks. A query scores the best chunks of its terms, and the n-th
best of these scores is a floor: no chunk below it is among the first n. Terms whose largest impacts together stay below
the floor need not propose chunks, nor need blocks whose largest impact and all other terms' together stay below it.
What is left is added up as it is read; only chunks that the other terms can still lift to the floor are looked up in
these, all terms of a chunk at once, so words that are in most chunks make no pairs with queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.sources.shared import settle

#: Weights of a chunk's text and of its header.
FIELDS = {"content": 1.0, "header": 0.4}
#: Postings of a block at most (about), and levels of impact per unit of term saturation.
BLOCK, LEVELS = 1 << 16, 8
#: Floors are lowered by this before anything is left out, for sums in another order.
SLACK = 1e-6


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


@dataclass
class Index:
    """``postings(term, level, part, chunk_id, impact)``, ``blocks(term, level, part, n, top)`` and
    ``best(term, chunk_id, impact)``: the ``depth`` best chunks of each term. All are settled tables."""

    postings: DataFrame
    blocks: DataFrame
    best: DataFrame
    depth: int


def field_words(chunks: DataFrame, fields: dict[str, float]) -> DataFrame:
    """``chunk_id, len`` and an array of terms for each field: ``len`` is the weighted number of terms. Null texts are empty."""
    words = chunks.select("chunk_id", *(F.coalesce(terms(F.col(f)), F.array().cast("array<string>")).alias(f"_{f}") for f in fields))
    return words.withColumn("len", sum(w * F.size(f"_{f}") for f, w in fields.items()))


def field_terms(chunks: DataFrame, fields: dict[str, float], only: DataFrame | None = None) -> DataFrame:
    """``term, chunk_id, len, tf``: weighted occurrences of each term in each chunk, and the chunk's weighted length; of
    the terms in ``only(term)`` where that is given. Equal chunk_ids count as one chunk only if their texts have the same
    length."""
    weigh = lambda w: lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))
    weighed = F.concat(*(F.transform(f"_{f}", weigh(w)) for f, w in fields.items()))
    x = field_words(chunks, fields).select("chunk_id", "len", F.explode(weighed).alias("x")).select(F.col("x.term").alias("term"), "chunk_id", "len", "x.w")
    if only is not None:
        x = x.join(only, "term", "left_semi")
    return x.groupBy("term", "chunk_id", "len").agg(F.sum("w").alias("tf"))


def build_index(chunks: DataFrame, fields: dict[str, float] | None = None, k1: float = 1.2, b: float = 0.75, depth: int = 12, questions: DataFrame | None = None) -> Index:
    """The index of ``chunks(chunk_id, …)`` over its text columns ``fields`` with their weights. Chunks without a term
    don't count; an empty table gives an empty index. With ``questions(q_id, question)`` it holds all postings of the
    terms that these ask for and serves them only; whole tables still give the number and mean length of chunks."""
    fields = fields or FIELDS
    only = settle(asked_terms(questions).select("term").distinct()) if questions is not None else None
    posted = settle(field_terms(chunks, fields, only))
    sizes = field_words(chunks, fields).where("len > 0").select("chunk_id", "len").distinct().agg(F.count("*").alias("n_chunks"), F.avg("len").alias("avg_len"))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    x = posted.join(df, "term").crossJoin(F.broadcast(sizes))  # one row
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    filled = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    parts = F.ceil(F.col("df") / BLOCK)
    postings = settle(x.select("term", F.floor(filled * LEVELS).cast("int").alias("level"), F.pmod(F.xxhash64("chunk_id"), parts).cast("int").alias("part"), "chunk_id", (idf * filled).alias("impact")))
    blocks = settle(postings.groupBy("term", "level", "part").agg(F.count("*").alias("n"), F.max("impact").alias("top")))
    order = [F.desc("impact"), "chunk_id"]
    near = postings.withColumn("_r", F.row_number().over(Window.partitionBy("term", "level", "part").orderBy(*order))).where(F.col("_r") <= depth)
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("term").orderBy(*order))).where(F.col("_r") <= depth)
    return Index(postings, blocks, settle(best.select("term", "chunk_id", "impact")), depth)


def bounds(asked: DataFrame, index: Index, n: int) -> DataFrame:
    """``q_id, term, most, below, all, floor`` of ``asked(q_id, term)``, distinct, for terms that occur: the term's largest
    impact, the sum of these up to it in rising order, that of all terms of the query, and the query's floor (0 where
    fewer than ``n`` chunks are known)."""
    known_best = asked.join(index.best, "term").select("q_id", "chunk_id").distinct()  # depth chunks a term of a query
    sums = known_best.join(asked, "q_id").join(index.postings, ["term", "chunk_id"]).groupBy("q_id", "chunk_id").agg(F.sum("impact").alias("s"))
    nth = sums.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("s")))).where(F.col("_r") == n)
    floor = nth.select("q_id", (F.col("s") - SLACK).alias("floor"))
    most = index.blocks.groupBy("term").agg(F.max("top").alias("most"))
    up = Window.partitionBy("q_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
    known = asked.join(most, "term").withColumn("below", F.sum("most").over(up)).withColumn("all", F.sum("most").over(Window.partitionBy("q_id")))
    return known.join(floor, "q_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))


def begun(known: DataFrame, index: Index) -> DataFrame:
    """``q_id, chunk_id, s`` of every chunk that may be among the first of its query: its score without the terms that
    need not propose. A chunk of a block that is left out can't reach the floor, whatever else it holds."""
    leading = known.where(F.col("below") >= F.col("floor"))
    opened = leading.join(index.blocks, "term").where(F.col("all") - F.col("most") + F.col("top") >= F.col("floor"))
    sums = opened.select("q_id", "term", "level", "part").join(index.postings, ["term", "level", "part"]).groupBy("q_id", "chunk_id").agg(F.sum("impact").alias("s"))
    rest = known.groupBy("q_id").agg(F.max("floor").alias("floor"), F.coalesce(F.max(F.when(F.col("below") < F.col("floor"), F.col("below"))), F.lit(0.0)).alias("rest"))
    return sums.join(rest, "q_id").where(F.col("s") + F.col("rest") >= F.col("floor")).select("q_id", "chunk_id", "s")


def proposals(asked: DataFrame, index: Index, n: int) -> DataFrame:
    """``q_id, chunk_id`` of every chunk that may be among the first ``n`` of its query; ``asked(q_id, term)`` distinct."""
    return begun(settle(bounds(asked, index, n)), index).select("q_id", "chunk_id")


def asked_terms(questions: DataFrame) -> DataFrame:
    return questions.select("q_id", F.explode(F.array_distinct(terms(F.col("question")))).alias("term")).distinct()


def text_topk(questions: DataFrame, index: Index, n: int = 12) -> DataFrame:
    """``q_id, chunk_id, score, rank`` of the ``n`` best chunks by BM25 for each of ``questions(q_id, question)``; terms
    repeated in a question count once, equal scores (to nine digits) go by chunk_id. Questions that are null, or without
    a term that occurs, find nothing."""
    known = settle(bounds(asked_terms(questions), index, n))  # a row for each term of a question
    others = known.where(F.col("below") < F.col("floor"))
    numbers = settle(others.select("term").distinct().withColumn("no", F.monotonically_increasing_id()))  # rows with texts are wide
    per_query = others.join(numbers, "term").groupBy("q_id").agg(F.collect_list("no").alias("others"))
    looked_up = begun(known, index).join(per_query, "q_id", "left")
    by_chunk = index.postings.join(numbers, "term").groupBy("chunk_id").agg(F.collect_list(F.struct("no", "impact")).alias("held"))
    more = F.aggregate(F.filter("held", lambda x: F.array_contains("others", x["no"])), F.lit(0.0), lambda a, x: a + x["impact"])
    scored = looked_up.join(by_chunk, "chunk_id", "left").groupBy("q_id", "chunk_id").agg(F.sum(F.col("s") + F.coalesce(more, F.lit(0.0))).alias("score"))
    w = Window.partitionBy("q_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
