"""Registered queries of joins and small aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import links as ln
from lakeline.plans.chunking import tokens
from lakeline.plans.retrieval import DENSE, TEXT_CHUNKS, dense, text_chunks
from lakeline.sources import tables as t


def image_links(s, d):
    """Two images for each vector chunk whose number is even, given out of order."""
    e = t.load(s, d, "embeddings").where("vec_id % 2 = 0")
    return e.select(F.col("vec_id").alias("chunk_id"), F.explode(F.array(*(F.struct(F.lit(p).alias("position"), F.concat(F.lit(f"i{p}-"), F.col("vec_id") % 9).alias("path")) for p in (2, 1)))).alias("x")).select("chunk_id", "x.*")


def files(s, d):
    return t.load(s, d, "embeddings").select(F.col("label").cast("long").alias("doc_id"), F.concat(F.lit("doc"), "label", F.lit(".pdf")).alias("file_name")).distinct()


def pictured_messages(s, d):
    return t.messages(s, d).select("message_id", F.when(F.col("turn") % 3 == 0, F.concat(F.lit('["P'), F.col("session_id") % 8, F.lit('.png","x"]'))).when(F.col("turn") % 3 == 1, "no list").alias("images_json"))


QUERIES = {
    "enrich_candidates": lambda s, d: ln.enrich_candidates(dense(s, d).select("q_id", "chunk_id", "rank"), text_chunks(s, d), files(s, d), image_links(s, d)).withColumn("paths", F.array_join("paths", "|")),
    "document_chunks_with_images": lambda s, d: ln.document_chunks_with_images(t.vector_chunks(s, d).select("chunk_id", "doc_id", "chunk_idx"), image_links(s, d)).withColumn("paths", F.array_join("paths", "|")),
    "cache_entries_of_documents": lambda s, d: ln.cache_entries_of_documents(t.cache(s, d), t.docs(s, d).where("doc_id < 4").select("doc_id"), True).select("cache_id"),
    "messages_with_dead_images": lambda s, d: ln.messages_with_dead_images(pictured_messages(s, d), t.load(s, d, "region").select(F.concat(F.lit("p"), "r_regionkey", F.lit(".PNG")).alias("path"))).select("message_id"),
    "source_ids": lambda s, d: ln.source_ids(dense(s, d).join(t.vector_chunks(s, d).select("chunk_id", "doc_id"), "chunk_id")),
    "docs_in_result": lambda s, d: ln.docs_in_result(dense(s, d).join(t.vector_chunks(s, d).select("chunk_id", "doc_id"), "chunk_id")),
    "image_count": lambda s, d: ln.image_count(pictured_messages(s, d).withColumn("doc_id", F.col("message_id") % 50)).select("doc_id", "images"),
    "chunk_stats": lambda s, d: ln.chunk_stats(t.docs(s, d), t.chunks(s, d), tokens(s, d).where("tokens > 5")),
    "neighbor_ids": lambda s, d: ln.neighbor_ids(dense(s, d), t.vector_chunks(s, d)),
    "caption_work": lambda s, d: ln.caption_work(t.chunks(s, d).select(F.col("chunk_id").alias("path"), F.when(F.length("content") > 30, F.left("content", F.lit(6))).alias("hash"))),
    "suggested_questions": lambda s, d: ln.suggested_questions(t.cache(s, d), t.messages(s, d), 7),
}
_T = t.with_tables
LINK = "il AS (SELECT vec_id AS chunk_id, concat('i1-', vec_id % 9, '|', 'i2-', vec_id % 9) AS paths FROM embeddings WHERE vec_id % 2 = 0)"
PICS = """pm AS (SELECT message_id, CASE WHEN turn % 3 = 0 THEN session_id % 8 END AS p FROM messages)"""
_dense = _T(f"MORE {DENSE} ", "questions", "vector_chunks").rstrip()
ORACLE_SQL = {
    "enrich_candidates": _T(f"MORE {TEXT_CHUNKS}, {DENSE}, {LINK} SELECT q_id, d.chunk_id, rank, c.doc_id, c.content, c.file_name, coalesce(paths, '') AS paths FROM dense d JOIN text_chunks c USING (chunk_id) LEFT JOIN il USING (chunk_id)", "vector_chunks", "questions"),
    "document_chunks_with_images": _T(f"MORE {LINK} SELECT chunk_id, doc_id, chunk_idx, coalesce(paths, '') AS paths FROM vector_chunks LEFT JOIN il USING (chunk_id)", "vector_chunks"),
    "cache_entries_of_documents": _T("SELECT cache_id FROM cache WHERE source_doc_ids IS NULL OR EXISTS (SELECT 1 FROM docs WHERE doc_id < 4 AND list_contains(string_split(source_doc_ids, ','), CAST(doc_id AS VARCHAR)))", "cache", "docs"),
    "messages_with_dead_images": _T(f"MORE {PICS} SELECT message_id FROM pm WHERE p IN (SELECT r_regionkey FROM region)", "messages"),
    "source_ids": f"{_dense} SELECT q_id, array_to_string(list_sort(list(DISTINCT v.doc_id)), ',') AS sources FROM dense d JOIN vector_chunks v USING (chunk_id) GROUP BY q_id",
    "docs_in_result": f"{_dense} SELECT q_id, v.doc_id, count(*) AS chunks FROM dense d JOIN vector_chunks v USING (chunk_id) GROUP BY q_id, v.doc_id",
    "image_count": _T(f"MORE {PICS} SELECT message_id % 50 AS doc_id, CAST(sum(CASE WHEN p IS NOT NULL THEN 2 ELSE 0 END) AS BIGINT) AS images FROM pm GROUP BY 1", "messages"),
    "chunk_stats": _T(r"""MORE c AS (SELECT doc_id, count(*) AS p, count(*) FILTER (WHERE len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) > 5) AS e FROM chunks GROUP BY doc_id)
      SELECT d.doc_id, coalesce(e, 0) AS chunks, coalesce(p, 0) - coalesce(e, 0) AS skipped FROM docs d LEFT JOIN c USING (doc_id)""", "docs", "chunks"),
    "neighbor_ids": f"{_dense}, n AS (SELECT q_id, unnest([prev_id, next_id]) AS chunk_id FROM dense JOIN vector_chunks USING (chunk_id)) SELECT DISTINCT q_id, chunk_id FROM n WHERE chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dense d WHERE d.q_id = n.q_id AND d.chunk_id = n.chunk_id)",
    "caption_work": _T("SELECT min(chunk_id) AS path FROM chunks WHERE length(content) > 30 GROUP BY left(content, 6) UNION ALL SELECT chunk_id FROM chunks WHERE length(content) <= 30 OR content IS NULL", "chunks"),
    "suggested_questions": _T("SELECT question FROM cache ORDER BY hit_count DESC, cache_id LIMIT 7", "cache"),
}
