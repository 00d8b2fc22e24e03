"""Registered queries of whole answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeline.functions.text import count_tokens
from lakeline.operators import answers as an
from lakeline.plans.chunking import ASK, asking
from lakeline.plans.retrieval import COS, DENSE, TEXT_CHUNKS, dense, text_chunks
from lakeline.sources import tables as t


def results(s, d):
    c = text_chunks(s, d).select("chunk_id", "file_name", "content")
    return dense(s, d).join(c, "chunk_id").withColumn("tokens", count_tokens(F.col("content")))


def image_context(s, d):
    return t.chunks(s, d).select((F.col("doc_id") % 50).alias("q_id"), F.row_number().over(Window.partitionBy(F.col("doc_id") % 50).orderBy("doc_id", "chunk_idx")).alias("rank"), F.concat(F.col("content"), F.lit("[IMG:"), F.col("chunk_idx") % 4, F.lit(" x] [IMG:2]")).alias("content"), F.array(F.lit("p1"), F.lit("p2")).alias("paths"))


def imports(s, d):
    o = t.load(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("row_no"), F.concat(F.lit("CUSTOMER#"), F.lpad((F.col("o_custkey") * 3 % 401).cast("string"), 9, "0"), F.lit("@X.test")).alias("email"), F.concat(F.lit("EMP"), F.lpad((F.col("o_orderkey") % 307).cast("string"), 3, "0")).alias("personnel_code"))


QUERIES = {
    "complaint_context": lambda s, d: an.complaint_context(asking(s, d), t.feedback(s, d), t.START - 2000 * t.DAY, 0.2, 0.5),
    "answer_context": lambda s, d: an.answer_context(results(s, d), 120),
    "global_image_numbers": lambda s, d: an.global_image_numbers(image_context(s, d)).select("q_id", "rank", F.col("at").cast("int").alias("place"), "local", "number"),
    "bulk_import_users": lambda s, d: an.bulk_import_users(t.users(s, d).where("user_id % 2 = 0"), imports(s, d)).select("row_no", "outcome"),
    "embed_texts": lambda s, d: an.embed(t.chunks(s, d).select("chunk_id", "content")).select("chunk_id", F.size("embedding").alias("size")),
}
ORACLE_SQL = {
    "complaint_context": "WITH RECURSIVE " + t.with_tables(f"""MORE {ASK}, p AS (SELECT q_id, feedback_id, rating, created, question_vec::DOUBLE[] AS v, {COS.format('vec', 'question_vec')} AS sim FROM asking a JOIN feedback f ON f.user_id = a.user_id AND created >= {t.START - 2000 * t.DAY}),
      o AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 9) DESC, feedback_id) AS place FROM p WHERE sim >= 0.2) AS r WHERE place <= 30),
      w AS (SELECT q_id, place, feedback_id, rating, created, 0::BIGINT AS cluster, [v] AS heads FROM o WHERE place = 1 UNION ALL
        SELECT q_id, place, feedback_id, rating, created, k, CASE WHEN k = len(heads) THEN list_append(heads, v) ELSE heads END FROM
        (SELECT o.*, w.heads, coalesce(nullif(list_position(list_transform(w.heads, lambda h: list_cosine_similarity(h, o.v) > 0.5), true), 0) - 1, len(w.heads)) AS k FROM w JOIN o ON o.q_id = w.q_id AND o.place = w.place + 1) AS x),
      n AS (SELECT q_id, cluster, count(*) FILTER (WHERE rating = -1) - count(*) FILTER (WHERE rating = 1) AS net, arg_max(feedback_id, created) FILTER (WHERE rating = -1) AS feedback_id FROM w GROUP BY q_id, cluster)
      SELECT q_id, cluster, net, feedback_id FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY net DESC, cluster) AS rn FROM n WHERE net > 0) AS a WHERE rn <= 10""", "questions", "feedback").removeprefix("WITH "),
    "bulk_import_users": "WITH RECURSIVE " + t.with_tables("""MORE had AS (SELECT list(lower(email)) AS m, list(personnel_code) AS c FROM users WHERE user_id % 2 = 0),
      r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey AS row_no, lower(concat('CUSTOMER#', lpad(CAST(o_custkey * 3 % 401 AS VARCHAR), 9, '0'), '@X.test')) AS m, concat('EMP', lpad(CAST(o_orderkey % 307 AS VARCHAR), 3, '0')) AS c FROM orders),
      w AS (SELECT 0::BIGINT AS i, 0::BIGINT AS row_no, '' AS outcome, m, c FROM had UNION ALL
        SELECT r.i, r.row_no, x.o, CASE WHEN x.o = 'ok' THEN list_append(w.m, r.m) ELSE w.m END, CASE WHEN x.o = 'ok' THEN list_append(w.c, r.c) ELSE w.c END
        FROM w JOIN r ON r.i = w.i + 1, LATERAL (SELECT CASE WHEN list_contains(w.m, r.m) THEN 'email taken' WHEN list_contains(w.c, r.c) THEN 'code taken' ELSE 'ok' END AS o) AS x)
      SELECT row_no, outcome FROM w WHERE i > 0""", "users").removeprefix("WITH "),
    "embed_texts": t.with_tables("SELECT chunk_id, CASE WHEN trim(content) <> '' THEN 64 END AS size FROM chunks", "chunks"),
    "answer_context": t.with_tables(rf"""MORE {TEXT_CHUNKS}, {DENSE}, g AS (SELECT d.q_id, d.rank, c.file_name, c.content, len(list_filter(regexp_split_to_array(c.content, '\s+'), lambda w: w <> '')) AS tokens FROM dense d JOIN text_chunks c USING (chunk_id) WHERE length(trim(c.content)) > 20),
      p AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER w AS used FROM g WINDOW w AS (PARTITION BY q_id ORDER BY rank)) SELECT q_id, string_agg(concat('[', place, '] ', file_name, chr(10), content), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context FROM p WHERE place = 1 OR (used <= 120 AND place <= 16) GROUP BY q_id""", "vector_chunks", "questions"),
    "global_image_numbers": t.with_tables("""MORE c AS (SELECT doc_id % 50 AS q_id, row_number() OVER (PARTITION BY doc_id % 50 ORDER BY doc_id, chunk_idx) AS rank, concat(content, '[IMG:', chunk_idx % 4, ' x] [IMG:2]') AS content FROM chunks),
      e AS (SELECT q_id, rank, list_transform(regexp_extract_all(content, '\\[IMG:([0-9]+)[^\\]]*\\]', 1), lambda n: CAST(n AS INT)) AS a FROM c), m AS (SELECT q_id, rank, CAST(k AS INT) AS place, a[k + 1] AS local FROM e, range(0, 3) AS r(k) WHERE k < len(a))
      SELECT q_id, rank, place, local, row_number() OVER (PARTITION BY q_id ORDER BY rank, place) AS number FROM m WHERE local BETWEEN 1 AND 2""", "chunks"),
}
