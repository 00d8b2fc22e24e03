"""Registered listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.functions import text as x
from lakeline.operators import listing as ls
from lakeline.sources import tables as t

CATEGORIES = ["wrong", "incomplete", "outdated", "irrelevant"]
ROW = "session_id, user_id, title, is_archived, is_pinned, pinned_at, created, updated"

QUERIES = {
    "project_public": lambda s, d: ls.project_public(t.docs(s, d), "documents"),
    "search_contains": lambda s, d: ls.search_contains(t.docs(s, d), "text", "the_e").select("doc_id", "file_name"),
    "search_any": lambda s, d: ls.search_any(t.users(s, d), ["full_name", "email"], "00001").select("user_id", "email"),
    "status_in": lambda s, d: t.docs(s, d).where(F.col("status").isin(0, 1)).select("doc_id", "status"),
    "deletable_users": lambda s, d: t.users(s, d).where("role <> 'Admin'").select("user_id"),
    "owner_or_admin": lambda s, d: t.sessions(s, d).where(F.col("user_id") == 3).select("session_id", "title"),
    "filter_sessions": lambda s, d: ls.filter_sessions(t.sessions(s, d), archived=False, since=t.START, until=t.START + 3 * t.DAY).select(ROW.split(", ")),
    "validate_feedback": lambda s, d: t.feedback(s, d).withColumn("reason", F.repeat(F.lit("x"), (F.col("feedback_id") % 7 * 100).cast("int")))
    .select("feedback_id", F.array_join(ls.violations(ls.feedback_rules(CATEGORIES)), ",").alias("violations")),
    "validate_questions": lambda s, d: t.messages(s, d).withColumn("question", F.col("content")).select("message_id", F.array_join(ls.violations(ls.question_rules(300)), ",").alias("violations")),
    "validate_users": lambda s, d: t.users(s, d).select("user_id", F.array_join(ls.violations(ls.user_rules()), ",").alias("violations")),
    "order_sessions": lambda s, d: ls.paginate(t.sessions(s, d), ls.order_sessions(), 2, 10).select(*ROW.split(", "), "total", "has_next", "has_prev"),
    "paginate_documents": lambda s, d: ls.paginate(ls.project_public(t.docs(s, d), "documents"), [F.col("created").desc(), F.col("doc_id")], 3, 25),
    "top_hits": lambda s, d: ls.top_rows(t.cache(s, d), 20, F.col("hit_count").desc(), F.col("cache_id")).select("cache_id", "question", "hit_count"),
    "take_last": lambda s, d: ls.take_last(t.messages(s, d), 4, "session_id", "turn").select("session_id", "message_id"),
    "head_n": lambda s, d: ls.head_n(t.chunks(s, d), 3, 60, "doc_id", "chunk_idx", "content").select("doc_id", "chunk_idx", "content"),
    "session_with_messages": lambda s, d: ls.session_with_messages(t.sessions(s, d), t.messages(s, d)).select("session_id", "title", "message_id", "turn", "role"),
    "answer_question_pairs": lambda s, d: ls.answer_question_pairs(t.messages(s, d)),
    "orphan_questions": lambda s, d: ls.orphan_questions(t.messages(s, d)).select("message_id", "session_id"),
    "popular_questions": lambda s, d: ls.popular_questions(t.messages(s, d)),
    "users_with_roles": lambda s, d: ls.users_with_roles(t.users(s, d).drop("role"), t.users(s, d).select("user_id", "role").union(t.users(s, d).select("user_id", F.lit("Reader")))).select("user_id", "email", "roles"),
    "messages_per_session": lambda s, d: t.messages(s, d).groupBy("session_id").agg(F.count("*").alias("n")),
    "status_counts": lambda s, d: t.docs(s, d).rollup("user_id", "status").agg(F.count("*").alias("n")),
    "reason_counts": lambda s, d: t.feedback(s, d).select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n")),
    "duplicate_content": lambda s, d: t.docs(s, d).groupBy("user_id", "content_hash").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"),
    "normalize_question": lambda s, d: t.messages(s, d).select("message_id", x.normalize_question(F.col("content")).alias("norm"), x.normalize_ws(F.col("content")).alias("spaced"), x.clip(F.col("content"), 40).alias("clipped")),
    "structure_meta": lambda s, d: t.docs(s, d).select("doc_id", *(c.alias(n) for n, c in zip(("table_lines", "list_items", "code", "words"), x.structure_meta(F.col("text"))))),
    "head_mid_tail": lambda s, d: t.docs(s, d).select("doc_id", x.head_mid_tail(F.col("text")).alias("sample")),
    "clip_to_tokens": lambda s, d: t.docs(s, d).select("doc_id", x.count_tokens(x.clip_to_tokens(F.col("text"), 50)).alias("tokens")),
}

_T = t.with_tables
ORACLE_SQL = {
    "project_public": _T("SELECT doc_id, user_id, file_name, CASE status WHEN 0 THEN 'Pending' WHEN 1 THEN 'Processing' WHEN 2 THEN 'Ready' WHEN 3 THEN 'Failed' WHEN 4 THEN 'Stale' END AS status, created FROM docs", "docs"),
    "search_contains": _T("SELECT doc_id, file_name FROM docs WHERE text ILIKE '%the_e%'", "docs"),
    "search_any": _T("SELECT user_id, email FROM users WHERE full_name ILIKE '%00001%' OR email ILIKE '%00001%'", "users"),
    "status_in": _T("SELECT doc_id, status FROM docs WHERE status IN (0, 1)", "docs"),
    "deletable_users": _T("SELECT user_id FROM users WHERE role <> 'Admin'", "users"),
    "owner_or_admin": _T("SELECT session_id, title FROM sessions WHERE user_id = 3", "sessions"),
    "filter_sessions": _T(f"SELECT {ROW} FROM sessions WHERE NOT is_archived AND created >= {t.START} AND created <= {t.START + 4 * t.DAY}", "sessions"),
    "validate_feedback": _T("SELECT feedback_id, concat_ws(',', CASE WHEN len(list_filter(categories, lambda c: c NOT IN ('wrong', 'incomplete', 'outdated', 'irrelevant'))) > 0 THEN 'categories' END, CASE WHEN feedback_id % 7 * 100 > 500 THEN 'reason' END) AS violations FROM feedback", "feedback"),
    "validate_questions": _T("SELECT message_id, concat_ws(',', CASE WHEN coalesce(trim(content), '') = '' THEN 'empty' END, CASE WHEN length(content) > 300 THEN 'long' END) AS violations FROM messages", "messages"),
    "validate_users": _T(r"""SELECT user_id, concat_ws(',', CASE WHEN length(full_name) > 100 THEN 'name' END, CASE WHEN NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email' END,
      CASE WHEN NOT (regexp_matches(personnel_code, '^\S{6,50}$') AND regexp_matches(personnel_code, '\p{L}') AND regexp_matches(personnel_code, '\d')) THEN 'code' END) AS violations FROM users""", "users"),
    "order_sessions": _T(f"SELECT *, 20 < total AS has_next, true AS has_prev FROM (SELECT {ROW}, count(*) OVER () AS total FROM sessions ORDER BY is_pinned DESC, pinned_at DESC NULLS FIRST, coalesce(updated, created) DESC, session_id LIMIT 10 OFFSET 10) AS a", "sessions"),
    "paginate_documents": _T("""SELECT *, 75 < total AS has_next, true AS has_prev FROM (SELECT doc_id, user_id, file_name, CASE status WHEN 0 THEN 'Pending' WHEN 1 THEN 'Processing' WHEN 2 THEN 'Ready' WHEN 3 THEN 'Failed' WHEN 4 THEN 'Stale' END AS status,
      created, count(*) OVER () AS total FROM docs ORDER BY created DESC, doc_id LIMIT 25 OFFSET 50) AS a""", "docs"),
    "top_hits": _T("SELECT cache_id, question, hit_count FROM cache ORDER BY hit_count DESC, cache_id LIMIT 20", "cache"),
    "take_last": _T("SELECT session_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS rn FROM messages) AS a WHERE rn <= 4", "messages"),
    "head_n": _T("SELECT doc_id, chunk_idx, left(content, 60) AS content FROM chunks WHERE chunk_idx < 3", "chunks"),
    "session_with_messages": _T("SELECT s.session_id, title, message_id, turn, role FROM sessions s LEFT JOIN messages m ON s.session_id = m.session_id", "sessions", "messages"),
    "answer_question_pairs": _T("SELECT a.response_to AS question_id, a.message_id AS answer_id, a.content AS answer, q.content AS question FROM messages a JOIN messages q ON a.response_to = q.message_id AND q.role = 0 WHERE a.role = 1", "messages"),
    "orphan_questions": _T("SELECT message_id, session_id FROM messages m WHERE role = 0 AND NOT EXISTS (SELECT 1 FROM messages a WHERE a.response_to = m.message_id)", "messages"),
    "popular_questions": _T(r"""SELECT question, n FROM (SELECT norm, count(*) AS n, min(message_id) AS first, arg_min(q, length(q) * 100000000 + message_id) AS question FROM
      (SELECT message_id, trim(content) AS q, trim(regexp_replace(lower(trim(content)), '[^\p{L}\p{Nd}\s]', '', 'g')) AS norm FROM messages WHERE role = 0) AS a WHERE length(q) > 10 AND length(q) < 200 GROUP BY norm) AS b ORDER BY n DESC, first LIMIT 10""", "messages"),
    "users_with_roles": _T("SELECT user_id, email, CASE WHEN role = 'Admin' THEN 'Admin,Reader' ELSE 'Reader,User' END AS roles FROM users", "users"),
    "messages_per_session": _T("SELECT session_id, count(*) AS n FROM messages GROUP BY session_id", "messages"),
    "status_counts": _T("SELECT user_id, status, count(*) AS n FROM docs GROUP BY ROLLUP (user_id, status)", "docs"),
    "reason_counts": _T("SELECT category, count(*) AS n FROM (SELECT unnest(categories) AS category FROM feedback) AS a GROUP BY category", "feedback"),
    "duplicate_content": _T("SELECT user_id, content_hash, min(doc_id) AS first, count(*) AS n FROM docs GROUP BY user_id, content_hash HAVING count(*) > 1", "docs"),
    "normalize_question": _T(r"""SELECT message_id, trim(regexp_replace(lower(content), '[^\p{L}\p{Nd}\s]', '', 'g')) AS norm, trim(regexp_replace(content, '[ \t\r\n]+', ' ', 'g')) AS spaced,
      CASE WHEN length(content) > 40 THEN left(content, 40) || '…' ELSE content END AS clipped FROM messages""", "messages"),
    "structure_meta": _T(r"""SELECT doc_id, CAST(len(list_filter(lines, lambda l: starts_with(l, '|') AND NOT contains(l, '---'))) AS INT) AS table_lines, CAST(len(list_filter(lines, lambda l: regexp_matches(l, '^([-*] |([1-9]|1[0-2])\. )'))) AS INT) AS list_items,
      contains(text, '```') AS code, CAST(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS INT) AS words FROM (SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda l: trim(l, ' ')) AS lines FROM docs) AS a""", "docs"),
    "head_mid_tail": _T("SELECT doc_id, CASE WHEN length(text) > 540 THEN concat(left(text, 250), chr(10), '[...]', chr(10), substr(text, CAST(floor(length(text) / 2 - 62.5) AS INT) + 1, 125), chr(10), '[...]', chr(10), right(text, 125)) ELSE text END AS sample FROM docs", "docs"),
    "clip_to_tokens": _T(r"SELECT doc_id, CAST(least(50, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))) AS INT) AS tokens FROM docs", "docs"),
}
