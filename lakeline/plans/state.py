"""Registered queries of state changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import state as st
from lakeline.sources import tables as t


def requests(s, d):
    return t.messages(s, d).select(F.col("message_id").alias("request_id"), (F.col("session_id") % 6).alias("user_id"), (F.col("message_id") + F.col("turn") % 3 - 1).alias("message_id"), (F.col("session_id") % 10 == 0).alias("is_admin"))


def given(s, d):
    return t.messages(s, d).where("role = 1").select((F.col("session_id") % 7).alias("user_id"), "message_id").where("message_id % 3 = 0")


def uploads(s, d):
    x = t.docs(s, d)
    return x.select(F.col("doc_id").alias("file_id"), (F.col("doc_id") % 3).alias("user_id"), F.upper("file_name").alias("file_name"), "content_hash", F.when(F.col("doc_id") % 9 > 0, "Pdf").alias("kind"))


def actions(s, d):
    e = t.load(s, d, "events")
    names = F.create_map(*(F.lit(x) for kv in {"click": "archive", "view": "pin", "error": "unpin", "signup": "unarchive", "purchase": "rename"}.items() for x in kv))
    return e.select((F.col("event_id") % 97).alias("session_id"), F.element_at(names, F.col("event_type")).alias("action"), F.col("event_id").alias("at"))


def user_changes(s, d):
    u = t.users(s, d)
    return u.select((F.col("user_id") + F.when(F.col("user_id") % 11 == 0, 1_000_000).otherwise(0)).alias("user_id"), F.when(F.col("user_id") % 5 == 0, F.upper("email")).when(F.col("user_id") % 5 == 1, F.lit("customer#000000007@x.test")).otherwise(F.concat(F.lit("new"), "email")).alias("new_email"),
                    F.concat(F.lit("EMP"), F.col("user_id") + F.when(F.col("user_id") % 4 == 0, 1).otherwise(0)).alias("new_code"))


def ids(s, d):
    return t.load(s, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"))


IMAGES = """concat('["', source, '.png","x', doc_id % 4, '.png"]')"""

QUERIES = {
    "feedback_insert": lambda s, d: st.feedback_insert(requests(s, d), t.messages(s, d), t.sessions(s, d), given(s, d)),
    "swap_document": lambda s, d: st.swap_document(t.chunks(s, d).select("doc_id", "chunk_idx"), t.chunks(s, d).where("doc_id % 3 = 0 AND chunk_idx < 2").select("doc_id", "chunk_idx"), t.docs(s, d).where("doc_id % 6 = 0").select("doc_id")),
    "cascade_delete": lambda s, d: st.cascade_delete(t.docs(s, d), t.chunks(s, d), t.docs(s, d).where("user_id = 3").select("doc_id"))[1].select("doc_id", "chunk_idx"),
    "unlink_answers": lambda s, d: st.unlink_answers(t.messages(s, d), t.messages(s, d).where("role = 0 AND turn % 4 = 0").select("message_id")).select("message_id", "response_to"),
    "session_transition": lambda s, d: st.session_transition(t.sessions(s, d), actions(s, d)),
    "delete_batch": lambda s, d: st.delete_batch(t.docs(s, d), ids(s, d)),
    "reprocess_batch": lambda s, d: st.reprocess_batch(t.docs(s, d), ids(s, d)),
    "drop_dead_images": lambda s, d: st.drop_dead_images(t.docs(s, d).select("doc_id", F.expr(IMAGES).alias("images_json")), F.array(F.lit("X1.png"), F.lit("x3.png"), F.lit("src3.png"))),
    "admit_uploads": lambda s, d: st.admit_uploads(t.docs(s, d).where("doc_id % 2 = 0"), uploads(s, d)),
    "update_users": lambda s, d: st.update_users(t.users(s, d), user_changes(s, d)),
    "delete_users": lambda s, d: st.delete_users(t.users(s, d), t.load(s, d, "orders").select((F.col("o_custkey") * 2).alias("user_id"))),
}

_T = t.with_tables
ORACLE_SQL = {
    "feedback_insert": _T("""MORE r AS (SELECT message_id AS request_id, session_id % 6 AS user_id, message_id + turn % 3 - 1 AS mid, session_id % 10 = 0 AS is_admin FROM messages), g AS (SELECT DISTINCT session_id % 7 AS user_id, message_id FROM messages WHERE role = 1 AND message_id % 3 = 0),
      x AS (SELECT r.*, m.role, m.content, m.response_to, s.user_id AS owner, q.content AS question, g.message_id AS given FROM r LEFT JOIN messages m ON m.message_id = r.mid LEFT JOIN sessions s ON s.session_id = m.session_id LEFT JOIN messages q ON q.message_id = m.response_to AND q.role = 0 LEFT JOIN g ON g.user_id = r.user_id AND g.message_id = r.mid),
      y AS (SELECT *, CASE WHEN role IS NULL THEN 'no message' WHEN role <> 1 THEN 'no answer' WHEN NOT is_admin AND NOT coalesce(owner = user_id, false) THEN 'forbidden' WHEN given IS NOT NULL THEN 'already given' WHEN response_to IS NULL THEN 'no link' WHEN question IS NULL THEN 'no question' ELSE 'ok' END AS status FROM x),
      z AS (SELECT *, row_number() OVER (PARTITION BY user_id, mid, status ORDER BY request_id) AS rn FROM y) SELECT request_id, CASE WHEN status = 'ok' AND rn > 1 THEN 'already given' ELSE status END AS status, CASE WHEN status = 'ok' AND rn = 1 THEN question END AS question, CASE WHEN status = 'ok' AND rn = 1 THEN content END AS answer FROM z""", "messages", "sessions"),
    "swap_document": _T("SELECT doc_id, chunk_idx FROM chunks WHERE NOT (doc_id % 3 = 0 AND doc_id % 6 <> 0) UNION ALL SELECT doc_id, chunk_idx FROM chunks WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0 AND chunk_idx < 2", "chunks"),
    "cascade_delete": _T("SELECT doc_id, chunk_idx FROM chunks WHERE doc_id % 7 <> 3", "chunks"),
    "unlink_answers": _T("MORE g AS (SELECT message_id FROM messages WHERE role = 0 AND turn % 4 = 0) SELECT message_id, CASE WHEN response_to NOT IN (SELECT message_id FROM g) THEN response_to END AS response_to FROM messages WHERE message_id NOT IN (SELECT message_id FROM g)", "messages"),
    "delete_batch": _T("SELECT DISTINCT l_orderkey AS doc_id, CASE WHEN status IS NULL THEN 'not found' WHEN status = 1 THEN 'processing' ELSE 'deleted' END AS outcome FROM lineitem LEFT JOIN docs ON doc_id = l_orderkey", "docs"),
    "reprocess_batch": _T("SELECT count(*) FILTER (WHERE status >= 2) AS queued, count(*) FILTER (WHERE status < 2) AS skipped, count(*) FILTER (WHERE status IS NULL) AS not_found FROM (SELECT DISTINCT l_orderkey, status FROM lineitem LEFT JOIN docs ON doc_id = l_orderkey) AS a", "docs"),
    "drop_dead_images": _T("""MORE p AS (SELECT doc_id, list_filter([concat(source, '.png'), concat('x', doc_id % 4, '.png')], lambda x: lower(x) NOT IN ('x1.png', 'x3.png', 'src3.png')) AS a FROM docs)
      SELECT doc_id, CASE WHEN len(a) > 0 THEN concat('["', array_to_string(a, '","'), '"]') END AS images_json FROM p""", "docs"),
    "admit_uploads": _T("""MORE f AS (SELECT doc_id AS file_id, doc_id % 3 AS user_id, lower(file_name) AS k, content_hash, doc_id % 9 > 0 AS kind FROM docs), e AS (SELECT DISTINCT user_id, lower(file_name) AS k FROM docs WHERE doc_id % 2 = 0), h AS (SELECT DISTINCT user_id, content_hash FROM docs WHERE doc_id % 2 = 0)
      SELECT file_id, CASE WHEN e.k IS NOT NULL OR row_number() OVER (PARTITION BY f.user_id, f.k ORDER BY file_id) > 1 THEN 'name conflict' WHEN NOT kind THEN 'unknown type' WHEN h.content_hash IS NOT NULL OR row_number() OVER (PARTITION BY f.user_id, f.content_hash ORDER BY file_id) > 1 THEN 'content conflict' ELSE 'Pending' END AS outcome
      FROM f LEFT JOIN e ON e.user_id = f.user_id AND e.k = f.k LEFT JOIN h ON h.user_id = f.user_id AND h.content_hash = f.content_hash""", "docs"),
    "update_users": _T("""MORE c AS (SELECT user_id + CASE WHEN user_id % 11 = 0 THEN 1000000 ELSE 0 END AS user_id, CASE WHEN user_id % 5 = 0 THEN upper(email) WHEN user_id % 5 = 1 THEN 'customer#000000007@x.test' ELSE concat('new', email) END AS new_email, concat('EMP', user_id + CASE WHEN user_id % 4 = 0 THEN 1 ELSE 0 END) AS new_code FROM users)
      SELECT c.user_id, CASE WHEN u.role IS NULL THEN 'not found' WHEN u.role = 'Admin' THEN 'forbidden' WHEN k.user_id <> c.user_id THEN 'code taken' WHEN lower(new_email) <> lower(u.email) AND m.user_id <> c.user_id THEN 'email taken' ELSE 'ok' END AS outcome
      FROM c LEFT JOIN users u ON u.user_id = c.user_id LEFT JOIN users k ON k.personnel_code = c.new_code LEFT JOIN users m ON lower(m.email) = lower(c.new_email)""", "users"),
    "delete_users": _T("SELECT count(*) FILTER (WHERE role <> 'Admin') AS deleted, count(*) FILTER (WHERE role = 'Admin') AS admins, count(*) FILTER (WHERE role IS NULL) AS not_found FROM (SELECT DISTINCT o_custkey * 2 AS user_id FROM orders) AS o LEFT JOIN users USING (user_id)", "users"),
    "session_transition": "WITH RECURSIVE " + _T("""MORE a AS (SELECT event_id % 97 AS session_id, CASE event_type WHEN 'click' THEN 'archive' WHEN 'view' THEN 'pin' WHEN 'error' THEN 'unpin' WHEN 'signup' THEN 'unarchive' WHEN 'purchase' THEN 'rename' END AS action, event_id AS sec, row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id) AS rn FROM events),
      w AS (SELECT session_id, CAST(0 AS BIGINT) AS rn, is_archived, is_pinned, pinned_at, updated FROM sessions UNION ALL
        SELECT w.session_id, a.rn, CASE WHEN action = 'archive' THEN true WHEN action IN ('unarchive', 'pin') THEN false ELSE w.is_archived END, CASE WHEN action = 'pin' THEN true WHEN action IN ('unpin', 'archive') THEN false ELSE w.is_pinned END,
          CASE WHEN action = 'pin' THEN sec WHEN action NOT IN ('unpin', 'archive') AND w.is_pinned THEN w.pinned_at END, sec FROM w JOIN a ON a.session_id = w.session_id AND a.rn = w.rn + 1),
      l AS (SELECT session_id, arg_max({'a': is_archived, 'p': is_pinned, 't': pinned_at, 'u': updated}, rn) AS s FROM w GROUP BY session_id)
      SELECT s.session_id, user_id, title, l.s.a AS is_archived, l.s.p AS is_pinned, l.s.t AS pinned_at, created, l.s.u AS updated FROM sessions s JOIN l ON l.session_id = s.session_id""", "sessions").removeprefix("WITH "),
}
