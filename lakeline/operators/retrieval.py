"""Hybrid retrieval over many questions at once: dense and full-text candidates, fusion, re-ranking, stitching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.functions.compose import blank, let, search_texts
from lakeline.functions.vector import similarity_join
from lakeline.operators.index import Index, build_index, terms, text_topk
from lakeline.sources.shared import settle

RRF_K = 60


def dense_topk(questions: DataFrame, chunks: DataFrame, n: int = 12) -> DataFrame:
    """``q_id, chunk_id, sim, rank``: the ``n`` chunks with the highest cosine for each question."""
    found = similarity_join(questions, "q_id", "vec", chunks, "chunk_id", "embedding", top=n)
    return found.select("q_id", F.col("item_id").alias("chunk_id"), "sim", "rank")


def postings(chunks: DataFrame, content: str = "content", chunk_id: str = "chunk_id") -> DataFrame:
    """``term, chunk_id, tf, len``: how often each term occurs in each chunk, with the chunk's number of terms.

    Terms are counted within the chunk's row. Only rows whose chunk_id occurs again are shuffled: those of equal length
    are counted together.
    """

    def counted(w: Column) -> Column:
        starts = F.array_compact(F.transform(w, lambda t, i: F.when((i == 0) | (t != F.get(w, i - 1)), i)))
        return let(starts, lambda at: F.transform(at, lambda s, i: F.struct(F.get(w, s).alias("term"), (F.coalesce(F.get(at, i + 1), F.size(w)) - s).cast("long").alias("tf"), F.size(w).alias("len"))))

    x = chunks.select(F.col(chunk_id).alias("chunk_id"), F.xxhash64(chunk_id).alias("_h"), F.col(content).alias("_c"))
    repeated = settle(x.groupBy("_h").count().where("count > 1").select("_h"))
    post = lambda df: df.select("chunk_id", F.explode(let(F.sort_array(terms(F.col("_c"))), counted)).alias("p")).select("p.term", "chunk_id", "p.tf", "p.len")
    if repeated.isEmpty():
        return post(x)
    again = post(x.join(repeated, "_h", "left_semi")).groupBy("term", "chunk_id", "len").agg(F.sum("tf").alias("tf"))
    return post(x.join(repeated, "_h", "left_anti")).unionByName(again)


def rrf(dense: DataFrame, text: DataFrame, n: int = 12, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: ``q_id, chunk_id, score, rank``.

    Ties follow the dense list, then the text list. A chunk may be in one list only; null ranks add nothing.
    """
    both = dense.select("q_id", "chunk_id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("text_rank")).unionByName(text.select("q_id", "chunk_id", F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("text_rank")))
    fused = both.groupBy("q_id", "chunk_id").agg(F.min("dense_rank").alias("dense_rank"), F.min("text_rank").alias("text_rank"))
    score = F.coalesce(1 / (k + F.col("dense_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("text_rank")), F.lit(0.0))
    w = Window.partitionBy("q_id").orderBy(F.round("score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("text_rank").asc_nulls_last())
    return fused.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def fuse_full_outer(dense: DataFrame, text: DataFrame, k: int = RRF_K) -> DataFrame:
    """The scores of ``rrf`` by a full outer join: ``q_id, chunk_id, score``."""
    d, t = dense.select("q_id", "chunk_id", F.col("rank").alias("d")), text.select("q_id", "chunk_id", F.col("rank").alias("t"))
    return d.join(t, ["q_id", "chunk_id"], "full_outer").select("q_id", "chunk_id", (F.coalesce(1 / (k + F.col("d")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("t")), F.lit(0.0))).alias("score"))


def dynamic_k(n: Column) -> Column:
    """How many results are kept of ``n`` candidates."""
    return F.when(n <= 5, n).when(n <= 10, 6).when(n <= 20, 10).otherwise(12)


def rerank_filter(scored: DataFrame, least: float = 0.15, soft: float = 0.05, fallback: int = 3) -> DataFrame:
    """Keep scores of ``least`` or more; if a question has none, its best ``fallback`` above ``soft``. Adds ``place``.

    A question none of whose candidates has a score keeps all in their order with score 0; negative scores never stay.
    """
    q = Window.partitionBy("q_id")
    order = Window.partitionBy("q_id").orderBy(F.col("s").desc_nulls_last(), "rank")
    s = scored.withColumn("s", F.col("score")).withColumn("good", F.count_if(F.col("s") >= least).over(q)).withColumn("known", F.count("s").over(q)).withColumn("place", F.row_number().over(order))
    keep = F.when(F.col("known") == 0, True).when(F.col("good") > 0, F.col("s") >= least).otherwise((F.col("s") > soft) & (F.col("place") <= fallback))
    return s.where(keep & (F.coalesce("s", F.lit(0.0)) >= 0)).withColumn("score", F.coalesce("s", F.lit(0.0))).drop("s", "good", "known")


def round_robin(ranked: DataFrame, rank: str = "rank", key: str = "doc_id") -> DataFrame:
    """Take one item of each document in turn: adds ``diverse_rank``; documents come in the order of their best item."""
    per = Window.partitionBy("q_id", key).orderBy(rank)
    x = ranked.withColumn("round", F.row_number().over(per)).withColumn("best", F.min(rank).over(Window.partitionBy("q_id", key)))
    return x.withColumn("diverse_rank", F.row_number().over(Window.partitionBy("q_id").orderBy("round", "best"))).drop("round", "best")


def stitch_neighbors(matches: DataFrame, chunks: DataFrame, wide: int = 3) -> DataFrame:
    """Adds ``stitched``: the bodies of the previous chunk, the match and the next chunk joined by blank lines.

    A neighbour that is itself a match of the question is left out, as are blank bodies; questions whose matches come
    from ``wide`` files or more keep their bodies alone. ``matches`` needs q_id, chunk_id, file_name.
    """
    body = chunks.select("chunk_id", "prev_id", "next_id", "content")
    m = matches.join(body, "chunk_id")
    taken = matches.select("q_id", "chunk_id")
    side = {}
    for name, col in (("before", "prev_id"), ("after", "next_id")):
        want = m.select("q_id", F.col("chunk_id").alias("of"), F.col(col).alias("chunk_id")).where(F.col("chunk_id").isNotNull()).join(taken, ["q_id", "chunk_id"], "left_anti")
        side[name] = want.join(chunks.select("chunk_id", F.trim("content").alias(name)), "chunk_id").where(F.col(name) != "").select("q_id", F.col("of").alias("chunk_id"), name)
    files = F.size(F.collect_set("file_name").over(Window.partitionBy("q_id")))
    x = m.withColumn("files", files).join(side["before"], ["q_id", "chunk_id"], "left").join(side["after"], ["q_id", "chunk_id"], "left")
    return x.withColumn("stitched", F.when(F.col("files") >= wide, F.col("content")).otherwise(F.concat_ws("\n\n", "before", "content", "after"))).drop("files", "before", "after", "prev_id", "next_id")


def select_context(items: DataFrame, budget: int, most: int = 16, cost: str = "tokens", key: str = "q_id", rank: str = "rank") -> DataFrame:
    """Items in order up to the first that would exceed the budget or the count; the first item always stays."""
    w = Window.partitionBy(key).orderBy(rank)
    x = items.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.where((F.col("place") == 1) | ((F.col("used") <= budget) & (F.col("place") <= most)))


def overlap_score(question: Column, content: Column) -> Column:
    """Share of the question's distinct terms that occur in a text; the stand-in of a re-ranking model."""
    asked = F.array_distinct(terms(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(content))) / F.size(asked))


def rerank_score(pairs: DataFrame, cut: int = 1500, model=overlap_score) -> DataFrame:
    """Adds ``score`` to pairs of ``question`` and ``content`` by ``model(question, text)``, which gets the first ``cut``
    characters of a text; blank texts and questions have no score."""
    known = ~blank(F.col("content")) & ~blank(F.col("question"))
    return pairs.withColumn("score", F.when(known, model(F.col("question"), F.left("content", F.lit(cut)))))


def asked_text(questions: DataFrame) -> Column:
    """What is looked up in full text: the enriched question where there is one, else the question."""
    enriched = F.col("enriched") if "enriched" in questions.columns else F.lit(None).cast("string")
    return search_texts(F.col("question"), enriched, F.lit(None).cast("string"), F.lit(True))[0]


def hybrid_search(questions: DataFrame, chunks: DataFrame, n: int = 12, index: Index | None = None, placed: DataFrame | None = None) -> DataFrame:
    """Dense and text candidates fused, re-ranked, made diverse, cut and stitched with their neighbours.

    ``questions`` needs q_id, vec, question and may have enriched; ``chunks`` chunk_id, doc_id, file_name, header,
    embedding, content, prev_id, next_id. The text side ranks by BM25 on ``index`` (built here if not given), or, with
    ``placed`` (see websearch.positions), takes the query syntax and ranks by cover density. Returns q_id, chunk_id,
    doc_id, score, diverse_rank and stitched.
    """
    looked_up = questions.select("q_id", asked_text(questions).alias("question"))
    if placed is not None:
        from lakeline.operators.websearch import web_search

        found = web_search(looked_up, placed, n)
    else:
        found = text_topk(looked_up, index or build_index(chunks, questions=looked_up), n)
    fused = rrf(dense_topk(questions, chunks, n), found, n)
    rich = fused.select("q_id", "chunk_id", "rank").join(chunks.select("chunk_id", "doc_id", "file_name", "content"), "chunk_id").join(questions.select("q_id", "question"), "q_id")
    scored = rich.withColumn("score", overlap_score(F.col("question"), F.col("content")))
    kept = round_robin(rerank_filter(scored), rank="place")
    kept = kept.withColumn("n", F.count("*").over(Window.partitionBy("q_id"))).where(F.col("diverse_rank") <= dynamic_k(F.col("n")))
    return stitch_neighbors(kept.select("q_id", "chunk_id", "doc_id", "file_name", "score", "diverse_rank"), chunks)
