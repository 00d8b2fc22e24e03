"""Registered retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.functions.vector import similarity_join
from lakeline.operators import index as ix
from lakeline.operators import retrieval as r
from lakeline.sources import tables as t
from lakeline.sources.store import exists

TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
COS = "list_cosine_similarity({}::DOUBLE[], {}::DOUBLE[])"


def text_chunks(spark, d):
    """A chunk for each number of a document or a vector: the document's whole text, its source as header, and the vector
    of that number. Those without a vector belong to a document of their own."""
    docs = t.load(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("header"))
    x = docs.join(t.vector_chunks(spark, d), "chunk_id", "full_outer").withColumn("doc_id", F.coalesce("doc_id", F.col("chunk_id") + 1000))
    return x.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("file_name", F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".pdf")))


TEXT_CHUNKS = """text_chunks AS (SELECT coalesce(v.chunk_id, d.doc_id) AS chunk_id, coalesce(v.doc_id, d.doc_id + 1000) AS doc_id, v.chunk_idx, v.prev_id, v.next_id, v.embedding, coalesce(d.text, '') AS content, d.source AS header,
  concat('doc', coalesce(v.doc_id, d.doc_id + 1000), '.pdf') AS file_name FROM documents d FULL OUTER JOIN vector_chunks v ON d.doc_id = v.chunk_id)"""

DENSE = f"""dense AS (SELECT q_id, chunk_id, sim, rank FROM (SELECT q_id, chunk_id, {COS.format('vec', 'embedding')} AS sim, row_number() OVER (PARTITION BY q_id ORDER BY round({COS.format('vec', 'embedding')}, 9) DESC, chunk_id) AS rank
  FROM questions, vector_chunks) AS a WHERE rank <= 12)"""

BM25 = f"""words AS (SELECT chunk_id, {TERMS.format("coalesce(content, '')")} AS w, {TERMS.format("coalesce(header, '')")} AS h FROM __chunks),
posted AS (SELECT term, chunk_id, len, sum(x) AS tf FROM (SELECT chunk_id, len(w) + 0.4::DOUBLE * len(h) AS len, unnest(w) AS term, 1.0::DOUBLE AS x FROM words
  UNION ALL SELECT chunk_id, len(w) + 0.4::DOUBLE * len(h), unnest(h), 0.4::DOUBLE FROM words) AS a GROUP BY ALL),
stats AS (SELECT count(*) AS n_chunks, avg(len) AS avg_len FROM (SELECT DISTINCT chunk_id, len FROM posted) AS a),
asked AS (SELECT DISTINCT q_id, unnest({TERMS.format('question')}) AS term FROM __questions),
dfs AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
bm25 AS (SELECT q_id, chunk_id, sum(ln(1 + (n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))) AS score
  FROM asked JOIN posted USING (term) JOIN dfs USING (term), stats GROUP BY q_id, chunk_id),
texts AS (SELECT q_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm25) AS a WHERE rank <= 12)"""


def bm25_sql(chunks: str, questions: str) -> str:
    return BM25.replace("__chunks", chunks).replace("__questions", questions)


BENCH = "bench AS (SELECT item_id AS q_id, text AS question FROM benchmark WHERE item_id % 20 = 0)"
FUSED = """fused AS (SELECT q_id, chunk_id, min(d) AS d, min(x) AS x FROM (SELECT q_id, chunk_id, rank AS d, NULL AS x FROM dense UNION ALL SELECT q_id, chunk_id, NULL, rank FROM texts) AS a GROUP BY q_id, chunk_id),
scored AS (SELECT *, coalesce(1 / (60 + d), 0) + coalesce(1 / (60 + x), 0) AS score FROM fused),
rrf AS (SELECT q_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 12) DESC, d NULLS LAST, x NULLS LAST) AS rank FROM scored) AS a WHERE rank <= 12)"""
P1 = f"""rich AS (SELECT f.q_id, f.chunk_id, f.rank, c.doc_id, c.file_name, c.content, c.prev_id, c.next_id, list_distinct({TERMS.format('q.question')}) AS asked, {TERMS.format('c.content')} AS has
  FROM rrf f JOIN text_chunks c USING (chunk_id) JOIN questions q USING (q_id)),
judged AS (SELECT *, CASE WHEN len(asked) > 0 THEN len(list_intersect(asked, has)) / len(asked) END AS s FROM rich),
placed AS (SELECT *, count(*) FILTER (WHERE s >= 0.15) OVER (PARTITION BY q_id) AS good, count(s) OVER (PARTITION BY q_id) AS known, row_number() OVER (PARTITION BY q_id ORDER BY s DESC NULLS LAST, rank) AS place FROM judged),
kept AS (SELECT *, coalesce(s, 0) AS score FROM placed WHERE known = 0 OR (good > 0 AND s >= 0.15) OR (known > 0 AND good = 0 AND s > 0.05 AND place <= 3)),
turned AS (SELECT *, row_number() OVER (PARTITION BY q_id, doc_id ORDER BY place) AS round, min(place) OVER (PARTITION BY q_id, doc_id) AS best, count(*) OVER (PARTITION BY q_id) AS n FROM kept),
final AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round, best) AS diverse_rank FROM turned),
cut AS (SELECT * FROM final WHERE diverse_rank <= CASE WHEN n <= 5 THEN n WHEN n <= 10 THEN 6 WHEN n <= 20 THEN 10 ELSE 12 END),
wide AS (SELECT q_id, count(DISTINCT file_name) AS files FROM cut GROUP BY q_id)
SELECT c.q_id, c.chunk_id, c.doc_id, c.diverse_rank, round(c.score, 6) AS score, CASE WHEN w.files >= 3 THEN c.content ELSE concat_ws(chr(10) || chr(10), nullif(trim(p.content), ''), c.content, nullif(trim(x.content), '')) END AS stitched
FROM cut c JOIN wide w USING (q_id) LEFT JOIN text_chunks p ON p.chunk_id = c.prev_id AND NOT EXISTS (SELECT 1 FROM cut o WHERE o.q_id = c.q_id AND o.chunk_id = c.prev_id)
LEFT JOIN text_chunks x ON x.chunk_id = c.next_id AND NOT EXISTS (SELECT 1 FROM cut o WHERE o.q_id = c.q_id AND o.chunk_id = c.next_id)"""


def dense(spark, d):
    return r.dense_topk(t.questions(spark, d), t.vector_chunks(spark, d))


_built: dict[tuple, ix.Index] = {}


def index_of(spark, d, name, chunks, questions):
    """The index of a table of chunks for the terms of a table of questions, built by the first query of an application
    that needs it; built anew where its files were cleared away meanwhile."""
    key = (spark.sparkContext.applicationId, d, name)
    found = _built.get(key)
    if found is None or not all(exists(spark, f) for f in found.postings.inputFiles()[:1]):
        found = _built[key] = ix.build_index(chunks(spark, d), questions=questions(spark, d))
    return found


def texts(spark, d):
    return ix.text_topk(t.questions(spark, d), index_of(spark, d, "texts", text_chunks, t.questions))


def bench_questions(spark, d):
    return t.load(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


QUERIES = {
    "dense_topk": lambda s, d: rounded(dense(s, d), "sim"),
    "postings": lambda s, d: r.postings(t.chunks(s, d)).select("term", "chunk_id", F.col("tf").cast("long"), F.col("len").cast("long")),
    "text_topk": lambda s, d: rounded(ix.text_topk(bench_questions(s, d), index_of(s, d, "lines", t.chunks, bench_questions)), "score"),
    "rrf": lambda s, d: rounded(r.rrf(dense(s, d), texts(s, d)).select("q_id", "chunk_id", "score", "rank"), "score"),
    "fuse_full_outer": lambda s, d: rounded(r.fuse_full_outer(dense(s, d), texts(s, d)), "score"),
    "union_candidates": lambda s, d: dense(s, d).select("q_id", "chunk_id").union(texts(s, d).select("q_id", "chunk_id")).distinct(),
    "round_robin": lambda s, d: r.round_robin(dense(s, d).join(t.vector_chunks(s, d).select("chunk_id", "doc_id"), "chunk_id")).select("q_id", "chunk_id", "doc_id", "diverse_rank"),
    "rerank_filter": lambda s, d: rounded(r.rerank_filter(dense(s, d).withColumn("score", F.round(F.col("sim") - 0.3, 6))).select("q_id", "chunk_id", "score", "place"), "score"),
    "dynamic_k": lambda s, d: similarity_join(t.questions(s, d), "q_id", "vec", t.vector_chunks(s, d), "chunk_id", "embedding", least=0.3).groupBy("q_id").agg(F.count("*").alias("n")).select("q_id", "n", r.dynamic_k(F.col("n")).alias("k")),
    "select_context": lambda s, d: r.select_context(
        t.chunks(s, d).select("doc_id", "chunk_idx", F.size(F.filter(F.split("content", r"\s+"), lambda x: x != "")).alias("tokens")), 200, 16, key="doc_id", rank="chunk_idx"
    ).select("doc_id", "chunk_idx", "tokens"),
    "hybrid_search": lambda s, d: rounded(r.hybrid_search(t.questions(s, d).where("question IS NOT NULL"), text_chunks(s, d), index=index_of(s, d, "texts", text_chunks, t.questions)).select("q_id", "chunk_id", "doc_id", "score", "diverse_rank", "stitched"), "score"),
}

_dense = t.with_tables(f"MORE {DENSE} ", "questions", "vector_chunks").rstrip()
_texts = t.with_tables(f"MORE {TEXT_CHUNKS}, {DENSE}, {bm25_sql('text_chunks', 'questions')}", "vector_chunks", "questions").rstrip()
ORACLE_SQL = {
    "dense_topk": f"{_dense} SELECT q_id, chunk_id, round(sim, 6) AS sim, rank FROM dense",
    "postings": t.with_tables(f"MORE words AS (SELECT chunk_id, {TERMS.format('content')} AS w FROM chunks) SELECT term, chunk_id, len, count(*) AS tf FROM (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM words) AS a GROUP BY ALL", "chunks"),
    "text_topk": t.with_tables(f"MORE {BENCH}, {bm25_sql('chunks', 'bench')} SELECT q_id, chunk_id, round(score, 6) AS score, rank FROM texts", "chunks"),
    "rrf": f"{_texts}, {FUSED} SELECT q_id, chunk_id, round(score, 6) AS score, rank FROM rrf",
    "fuse_full_outer": f"{_texts} SELECT q_id, chunk_id, round(coalesce(1 / (60 + d.rank), 0) + coalesce(1 / (60 + t.rank), 0), 6) AS score FROM dense d FULL OUTER JOIN texts t USING (q_id, chunk_id)",
    "union_candidates": f"{_texts} SELECT q_id, chunk_id FROM dense UNION SELECT q_id, chunk_id FROM texts",
    "round_robin": f"""{_dense}, x AS (SELECT d.q_id, d.chunk_id, v.doc_id, row_number() OVER (PARTITION BY d.q_id, v.doc_id ORDER BY d.rank) AS round, min(d.rank) OVER (PARTITION BY d.q_id, v.doc_id) AS best FROM dense d JOIN vector_chunks v USING (chunk_id))
      SELECT q_id, chunk_id, doc_id, row_number() OVER (PARTITION BY q_id ORDER BY round, best) AS diverse_rank FROM x""",
    "rerank_filter": f"""{_dense}, s AS (SELECT q_id, chunk_id, rank, round(sim - 0.3, 6) AS s FROM dense),
      p AS (SELECT *, count(*) FILTER (WHERE s >= 0.15) OVER (PARTITION BY q_id) AS good, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, rank) AS place FROM s)
      SELECT q_id, chunk_id, s AS score, place FROM p WHERE s >= 0 AND ((good > 0 AND s >= 0.15) OR (good = 0 AND s > 0.05 AND place <= 3))""",
    "dynamic_k": t.with_tables(f"SELECT q_id, n, CASE WHEN n <= 5 THEN n WHEN n <= 10 THEN 6 WHEN n <= 20 THEN 10 ELSE 12 END AS k FROM (SELECT q_id, count(*) AS n FROM questions, vector_chunks WHERE {COS.format('vec', 'embedding')} >= 0.3 GROUP BY q_id) AS a", "questions", "vector_chunks"),
    "select_context": t.with_tables(r"""SELECT doc_id, chunk_idx, tokens FROM (SELECT doc_id, chunk_idx, tokens, row_number() OVER w AS place, sum(tokens) OVER w AS used FROM
      (SELECT doc_id, chunk_idx, CAST(len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS INT) AS tokens FROM chunks) AS a WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx)) AS b WHERE place = 1 OR (used <= 200 AND place <= 16)""", "chunks"),
    "hybrid_search": f"{_texts.replace(' FROM questions, vector_chunks', ' FROM questions, vector_chunks WHERE question IS NOT NULL')}, {FUSED}, {P1}",
}
