"""Registered queries of ordered passes, the cache and state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.functions.text import count_tokens
from lakeline.operators import cache as ca
from lakeline.operators import chunking as ch
from lakeline.operators import folds
from lakeline.plans.retrieval import COS, rounded
from lakeline.sources import tables as t


def tokens(s, d):
    return t.chunks(s, d).withColumn("tokens", count_tokens(F.col("content")))


def asking(s, d):
    return t.questions(s, d).withColumn("user_id", F.col("q_id") % 5)


def events(s, d):
    return t.load(s, d, "events").select("event_id", F.col("user_id").alias("client"), "event_type", F.unix_timestamp("ts").alias("at"))


def new_answers(s, d):
    return t.load(s, d, "documents").where("doc_id % 20 = 0").select((F.col("doc_id") + 1_000_000).alias("new_id"), F.concat(F.lit(" "), F.col("text")).alias("question"), F.lit("new").alias("answer"))


QUERIES = {
    "link_chunks": lambda s, d: ch.link_chunks(t.vector_chunks(s, d)),
    "section_runs": lambda s, d: ch.section_runs(t.messages(s, d), "session_id", "turn", "role").select("message_id", F.col("section").cast("long")),
    "longest_run": lambda s, d: ch.longest_run(tokens(s, d), "doc_id", "chunk_idx", F.col("tokens") >= 10),
    "dedup_chunks": lambda s, d: ch.dedup_chunks(t.chunks(s, d)).select("doc_id", "chunk_idx"),
    "page_layout": lambda s, d: rounded(ch.page_layout(t.chunks(s, d).withColumn("weight", F.greatest(F.length("content"), F.lit(20)))).select("doc_id", "chunk_idx", "top", "bottom"), "top", "bottom"),
    "adjacent_distance": lambda s, d: rounded(ch.adjacent_distance(t.vector_chunks(s, d)), "distance"),
    "breakpoints": lambda s, d: rounded(ch.breakpoints(ch.adjacent_distance(t.vector_chunks(s, d))), "threshold"),
    "adaptive_budget": lambda s, d: ch.adaptive_budget(tokens(s, d)),
    "header_skeleton": lambda s, d: ch.header_skeleton(t.chunks(s, d).withColumn("header", F.left("content", F.lit(4)))),
    "even_sample": lambda s, d: ch.even_sample(t.chunks(s, d)),
    "carry_heading": lambda s, d: ch.carry_heading(t.chunks(s, d), F.when(F.length("content") < 40, F.col("content"))).select("doc_id", "chunk_idx", "heading"),
    "build_history": lambda s, d: ch.build_history(t.messages(s, d).withColumn("cost", count_tokens(F.col("content"))), 200).select("message_id", "kept"),
    "sniff_delimiter": lambda s, d: ch.sniff_delimiter(t.chunks(s, d).select(F.col("doc_id").alias("file_id"), F.col("chunk_idx").alias("line_no"), F.col("content").alias("line"))),
    "pack_budget": lambda s, d: folds.pack_budget(tokens(s, d), "doc_id", "chunk_idx", "tokens", 200),
    "coalesce_small": lambda s, d: folds.coalesce_small(tokens(s, d), "doc_id", "chunk_idx", "tokens", 40, 120),
    "best_cache_match": lambda s, d: rounded(ca.best_cache_match(t.questions(s, d), t.cache(s, d).where("cache_id % 20 <> 0"), 0.5), "sim", "nearest"),
    "feedback_net": lambda s, d: ca.feedback_net(asking(s, d), t.feedback(s, d), 0.3),
    "nearest_feedback": lambda s, d: rounded(ca.nearest_feedback(asking(s, d), t.feedback(s, d), t.START - 180 * t.DAY, 0.2), "sim"),
    "answer_from_cache": lambda s, d: ca.answer_from_cache(asking(s, d), t.cache(s, d), t.feedback(s, d)),
    "cache_upsert": lambda s, d: ca.cache_upsert(t.cache(s, d), new_answers(s, d), t.NOW),
    "cache_hits": lambda s, d: ca.cache_hits(t.cache(s, d).select("cache_id", "hit_count", "last_hit"), events(s, d).select((F.col("event_id") % 997).alias("cache_id"), "at")),
    "cache_expire": lambda s, d: ca.cache_expire(t.cache(s, d), t.NOW).select("cache_id", "created", "last_hit"),
    "cache_invalidate": lambda s, d: ca.cache_invalidate(t.cache(s, d), t.docs(s, d).where("status = 3").select("doc_id")).select("cache_id"),
    "normalize_cache": lambda s, d: ca.normalize_cache(t.cache(s, d)).select("cache_id", "last_hit", "source_doc_ids"),
    "lookup_stats": lambda s, d: ca.lookup_stats(events(s, d).select(F.concat("client", "event_type").alias("key"), "at"), 86400, 7 * 86400),
    "rate_quota": lambda s, d: ca.rate_quota(events(s, d), 2, 86400).select("event_id", "allowed", "retry_after"),
}

_T = t.with_tables
TOK = r"tok AS (SELECT *, CAST(len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) AS INT) AS tokens FROM chunks)"
EV = "ev AS (SELECT event_id, user_id AS client, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events)"
ASK = "asking AS (SELECT *, q_id % 5 AS user_id FROM questions)"
DIST = f"dist AS (SELECT chunk_id, doc_id, CASE WHEN nxt IS NOT NULL THEN 1 - {COS.format('embedding', 'nxt')} END AS distance FROM (SELECT *, lead(embedding) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS nxt FROM vector_chunks) AS a)"
ORACLE_SQL = {
    "link_chunks": _T("SELECT chunk_id, doc_id, chunk_idx, prev_id, next_id FROM vector_chunks", "vector_chunks"),
    "section_runs": _T("SELECT message_id, sum(CASE WHEN role IS DISTINCT FROM p AND rn > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS section FROM (SELECT *, lag(role) OVER w AS p, row_number() OVER w AS rn FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY turn)) AS a", "messages").replace("SELECT message_id, sum(", "SELECT message_id, CAST(sum(").replace("ORDER BY turn) AS section", "ORDER BY turn) AS BIGINT) AS section"),
    "longest_run": _T(f"MORE {TOK}, g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS r FROM tok), i AS (SELECT doc_id, chunk_idx, r - row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS i FROM g WHERE tokens >= 10),"
      " n AS (SELECT doc_id, min(chunk_idx) AS first, max(chunk_idx) AS last, count(*) AS n FROM i GROUP BY doc_id, i) SELECT doc_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS b FROM n) AS a WHERE b = 1 AND n >= 2", "chunks"),
    "dedup_chunks": _T("SELECT doc_id, chunk_idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, CASE WHEN length(content) < 50 THEN concat('#', chunk_idx) ELSE content END ORDER BY chunk_idx) AS rn FROM chunks) AS a WHERE rn = 1", "chunks"),
    "page_layout": _T("SELECT doc_id, chunk_idx, round((run - w) / total, 6) AS top, round(run / total, 6) AS bottom FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id, page ORDER BY chunk_idx) AS run, sum(w) OVER (PARTITION BY doc_id, page) AS total FROM (SELECT *, greatest(length(content), 20) AS w FROM chunks) AS a) AS b", "chunks"),
    "adjacent_distance": _T(f"MORE {DIST} SELECT chunk_id, doc_id, round(distance, 6) AS distance FROM dist", "vector_chunks"),
    "breakpoints": _T(f"MORE {DIST} SELECT doc_id, round(percentile_disc(0.85) WITHIN GROUP (ORDER BY distance), 6) AS threshold FROM dist WHERE distance IS NOT NULL GROUP BY doc_id", "vector_chunks"),
    "adaptive_budget": _T(f"MORE {TOK}, p AS (SELECT doc_id, coalesce(list_sort(list(tokens) FILTER (WHERE tokens > 5)), []) AS t FROM tok GROUP BY doc_id) SELECT doc_id, CASE WHEN len(t) < 3 THEN 400 ELSE least(greatest(CAST(floor(t[len(t) // 2 + 1] * 2.5) AS INT), 400), 1024) END AS budget FROM p", "chunks"),
    "header_skeleton": _T("MORE h AS (SELECT doc_id, chunk_idx, trim(left(content, 4)) AS h FROM chunks), f AS (SELECT doc_id, lower(h) AS k, min(chunk_idx) AS i, arg_min(h, chunk_idx) AS h FROM h WHERE h <> '' GROUP BY doc_id, lower(h)),"
      " r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM f) SELECT doc_id, string_agg(concat('- ', h), chr(10) ORDER BY i) AS skeleton FROM r WHERE rn <= 40 GROUP BY doc_id", "chunks"),
    "even_sample": _T("MORE p AS (SELECT doc_id, list(left(content, 300) ORDER BY chunk_idx) AS a, count(*) AS c, CAST(least(greatest(floor(count(*) / 40), 6), 24) AS INT) AS n FROM chunks GROUP BY doc_id)"
      " SELECT doc_id, array_to_string(CASE WHEN c <= n THEN a ELSE list_transform(range(n), lambda i: a[CAST(floor(i * c / n) AS INT) + 1]) END, chr(10)) AS sample FROM p", "chunks"),
    "carry_heading": _T("SELECT doc_id, chunk_idx, last_value(CASE WHEN length(content) < 40 THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY chunk_idx ROWS UNBOUNDED PRECEDING) AS heading FROM chunks", "chunks"),
    "build_history": _T(r"SELECT message_id, b = 1 OR (b <= 6 AND u <= 200) AS kept FROM (SELECT message_id, row_number() OVER w AS b, sum(cost) OVER w AS u FROM (SELECT *, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) AS cost FROM messages) AS a WINDOW w AS (PARTITION BY session_id ORDER BY turn DESC)) AS b", "messages"),
    "sniff_delimiter": _T("""MORE f AS (SELECT doc_id AS file_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS r FROM chunks WHERE trim(content) <> ''), g AS (SELECT file_id, regexp_replace(content, '"[^"]*"', '', 'g') AS b FROM f WHERE r <= 30),
      tot AS (SELECT file_id, count(*) AS total FROM g GROUP BY file_id), c AS (SELECT * FROM (VALUES (0, ';'), (1, ','), (2, chr(9)), (3, '|')) AS v(o, c)), h AS (SELECT file_id, o, c, length(b) - length(replace(b, c, '')) AS n FROM g, c),
      m AS (SELECT file_id, o, c, n, count(*) AS f FROM h WHERE n > 0 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY file_id, o ORDER BY f DESC, n DESC) AS rn FROM m),
      s AS (SELECT file_id, c, row_number() OVER (PARTITION BY file_id ORDER BY 10.0::DOUBLE * f / total + n DESC, o) AS b FROM k JOIN tot USING (file_id) WHERE rn = 1) SELECT tot.file_id, coalesce(s.c, ',') AS delimiter FROM tot LEFT JOIN s ON s.file_id = tot.file_id AND b = 1""", "chunks"),
    "best_cache_match": _T(f"MORE p AS (SELECT q_id, cache_id, round({COS.format('vec', 'question_vec')}, 9) AS sim FROM questions, cache WHERE cache_id % 20 <> 0), b AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, cache_id) AS rn FROM p)"
      " SELECT q_id, CASE WHEN sim >= 0.5 THEN cache_id END AS cache_id, CASE WHEN sim >= 0.5 THEN round(sim, 6) END AS sim, round(sim, 6) AS nearest FROM b WHERE rn = 1", "questions", "cache"),
    "feedback_net": _T(f"MORE {ASK} SELECT q_id, CAST(coalesce(sum(-rating), 0) AS BIGINT) AS net FROM asking a LEFT JOIN feedback f ON f.user_id = a.user_id AND {COS.format('vec', 'question_vec')} >= 0.3 GROUP BY q_id", "questions", "feedback"),
    "nearest_feedback": _T(f"MORE {ASK}, p AS (SELECT q_id, feedback_id, {COS.format('vec', 'question_vec')} AS sim FROM asking a JOIN feedback f ON f.user_id = a.user_id AND created >= {t.START - 180 * t.DAY}),"
      " r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(sim, 9) DESC, feedback_id) AS place FROM p WHERE sim >= 0.2) SELECT q_id, feedback_id, round(sim, 6) AS sim, place FROM r WHERE place <= 30", "questions", "feedback"),
    "answer_from_cache": _T(f"MORE {ASK}, p AS (SELECT q_id, cache_id, round({COS.format('vec', 'question_vec')}, 9) AS sim FROM questions, cache), b AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, cache_id) AS rn FROM p),"
      f" n AS (SELECT q_id, CAST(coalesce(sum(-rating), 0) AS BIGINT) AS net FROM asking a LEFT JOIN feedback f ON f.user_id = a.user_id AND {COS.format('vec', 'question_vec')} >= 0.85 GROUP BY q_id)"
      " SELECT q_id, CASE WHEN sim >= 0.9 THEN cache_id END AS cache_id, net, CASE WHEN sim < 0.9 THEN 'MISS' WHEN net > 0 THEN 'BYPASS' WHEN sim >= 0.97 OR net < 0 THEN 'FAST' ELSE 'VALIDATE' END AS route FROM b JOIN n USING (q_id) WHERE rn = 1", "questions", "cache", "feedback"),
    "cache_upsert": _T(f"""MORE n AS (SELECT doc_id + 1000000 AS new_id, text AS question FROM documents WHERE doc_id % 20 = 0), k AS (SELECT lower(trim(question)) AS k, max(new_id) AS new_id, arg_max(question, new_id) AS q FROM n GROUP BY 1)
      SELECT coalesce(cache_id, new_id) AS cache_id, CASE WHEN cache_id IS NOT NULL THEN question ELSE trim(q) END AS question, CASE WHEN new_id IS NOT NULL THEN 'new' ELSE answer END AS answer, coalesce(hit_count, 0) AS hit_count, last_hit, CASE WHEN new_id IS NOT NULL THEN {t.NOW} END AS updated
      FROM cache FULL OUTER JOIN k ON lower(question) = k""", "cache"),
    "cache_hits": _T(f"MORE {EV}, h AS (SELECT event_id % 997 AS cache_id, count(*) AS n, max(sec) AS sec FROM ev GROUP BY 1) SELECT c.cache_id, CAST(hit_count + coalesce(n, 0) AS BIGINT) AS hit_count, greatest(last_hit, sec) AS last_hit FROM cache c LEFT JOIN h USING (cache_id)", "cache"),
    "cache_expire": _T(f"SELECT cache_id, created, last_hit FROM cache WHERE NOT (created < {t.NOW - 30 * t.DAY} AND (last_hit IS NULL OR last_hit < {t.NOW - 30 * t.DAY}))", "cache"),
    "cache_invalidate": _T("SELECT cache_id FROM cache WHERE source_doc_ids IS NOT NULL AND NOT EXISTS (SELECT 1 FROM docs WHERE status = 3 AND list_contains(string_split(source_doc_ids, ','), CAST(doc_id AS VARCHAR)))", "cache", "docs"),
    "normalize_cache": _T("SELECT cache_id, CASE WHEN hit_count > 0 THEN last_hit END AS last_hit, CASE WHEN source_doc_ids IS NOT NULL THEN concat(',', source_doc_ids, ',') END AS source_doc_ids FROM cache", "cache"),
    "rate_quota": f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY client, sec // 86400 ORDER BY sec, event_id) AS rn FROM ev) SELECT event_id, rn <= 2 AS allowed, CASE WHEN rn > 2 THEN (sec // 86400 + 1) * 86400 - sec END AS retry_after FROM r",
    "pack_budget": "WITH RECURSIVE " + _T(f"""MORE {TOK}, o AS (SELECT doc_id, chunk_idx, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS rn FROM tok),
      w AS (SELECT doc_id, chunk_idx, rn, 0 AS no, CAST(tokens AS BIGINT) AS used FROM o WHERE rn = 1 UNION ALL
        SELECT o.doc_id, o.chunk_idx, o.rn, CASE WHEN w.used > 0 AND w.used + o.tokens > 200 THEN w.no + 1 ELSE w.no END, CASE WHEN w.used > 0 AND w.used + o.tokens > 200 THEN o.tokens ELSE w.used + o.tokens END FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
      SELECT doc_id, chunk_idx, no AS group_no FROM w""", "chunks").removeprefix("WITH "),
    "coalesce_small": "WITH RECURSIVE " + _T(f"""MORE {TOK}, o AS (SELECT doc_id, chunk_idx, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS rn FROM tok),
      w AS (SELECT doc_id, chunk_idx, rn, 0 AS group_no, CASE WHEN tokens < 40 THEN tokens ELSE -1 END AS used FROM o WHERE rn = 1 UNION ALL
        SELECT o.doc_id, o.chunk_idx, o.rn, CASE WHEN o.tokens < 40 AND w.used >= 0 AND w.used + o.tokens <= 120 THEN w.group_no ELSE w.group_no + 1 END, CASE WHEN o.tokens >= 40 THEN -1 WHEN w.used >= 0 AND w.used + o.tokens <= 120 THEN w.used + o.tokens ELSE o.tokens END FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
      SELECT doc_id, chunk_idx, group_no FROM w""", "chunks").removeprefix("WITH "),
    "lookup_stats": "WITH RECURSIVE " + f"""{EV}, o AS (SELECT concat(client, event_type) AS key, sec, row_number() OVER (PARTITION BY client, event_type ORDER BY sec) AS rn FROM ev),
      w AS (SELECT key, rn, sec AS loaded, sec AS last, false AS hit FROM o WHERE rn = 1 UNION ALL
        SELECT o.key, o.rn, CASE WHEN o.sec - w.last < 86400 AND o.sec - w.loaded < 604800 THEN w.loaded ELSE o.sec END, o.sec, o.sec - w.last < 86400 AND o.sec - w.loaded < 604800 FROM w JOIN o ON o.key = w.key AND o.rn = w.rn + 1)
      SELECT key, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM w GROUP BY key""",
}
