"""Registered queries of single steps: membership, duplicates, history, layout, uploads, sessions, cache and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.functions import text as x
from lakeline.functions.text import count_tokens
from lakeline.operators import answers as an
from lakeline.operators import cache as ca
from lakeline.operators import chunking as ch
from lakeline.operators import files as fl
from lakeline.operators import links as ln
from lakeline.operators import listing as ls
from lakeline.operators import retrieval as r
from lakeline.operators import state as st
from lakeline.plans.chunking import ORACLE_SQL as CHUNKING_SQL
from lakeline.plans.chunking import TOK, asking, events, tokens
from lakeline.plans.retrieval import TERMS, rounded
from lakeline.plans.state import actions, uploads
from lakeline.sources import tables as t


def checked_uploads(s, d):
    fmt = F.element_at(F.array(*map(F.lit, ("Pdf", "Ooxml", "Unknown"))), (F.col("file_id") % 3 + 1).cast("int"))
    return uploads(s, d).withColumn("format", fmt).withColumn("size", F.col("file_id") % 20)


def kinds(s, d):
    """Chunks of all kinds, by their number."""
    kind = F.element_at(F.array(*map(F.lit, ("table", "code", "figure", "rule", "text"))), F.col("chunk_idx") % 5 + 1)
    return t.chunks(s, d).withColumn("weight", ch.block_weight(kind, F.col("content")))


def turns(s, d):
    m = t.messages(s, d)
    return m.where("role = 0").select((F.col("session_id") + F.when(F.col("turn") % 4 == 0, 100_000).otherwise(0)).alias("session_id"), F.col("content").alias("question"), F.col("created").alias("at"))


def named_actions(s, d):
    return actions(s, d).withColumn("title", F.concat(F.lit(" T"), F.repeat(F.lit("x"), (F.col("at") % 80).cast("int"))))


def doc_notes(s, d):
    c = t.chunks(s, d)
    return c.where("chunk_idx % 3 = 0").select("doc_id", F.col("chunk_idx").alias("pos"), F.when(F.col("chunk_idx") % 2 == 0, F.concat(F.lit(" n"), F.col("chunk_idx"))).otherwise(" ").alias("note"))


def sourced(s, d):
    """Every document is a question, its lines the sources."""
    c = tokens(s, d)
    return c.select(F.col("doc_id").alias("q_id"), F.col("chunk_idx").alias("rank"), F.col("header").alias("file_name"), F.concat("content", F.lit(" [IMG:1 — cap]")).alias("content"), "tokens", "page", F.when(F.col("chunk_idx") % 2 == 0, F.left("content", F.lit(3))).alias("header"), F.when(F.col("chunk_idx") % 3 > 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")).alias("paths"))


def told_feedback(s, d):
    f = t.feedback(s, d)
    texts = t.load(s, d, "documents").select(F.col("doc_id").alias("feedback_id"), F.col("text").alias("question"), F.reverse("text").alias("answer"))
    return f.join(texts, "feedback_id", "left").withColumn("reason", F.when(F.col("feedback_id") % 2 == 0, "reason"))


def upserts(s, d):
    x = t.load(s, d, "documents").where("doc_id % 20 = 0")
    return x.select((F.col("doc_id") + 1_000_000).alias("new_id"), F.concat(F.lit(" "), F.col("text")).alias("question"), F.lit("new").alias("answer"), F.array(F.concat(F.lit("i"), "doc_id")).alias("images"), F.col("doc_id").cast("string").alias("source_doc_ids"))


def overlap(s, d):
    """Each benchmark item against its twenty documents: texts are cut, blank ones have no score."""
    b = t.load(s, d, "benchmark").select("item_id", F.col("text").alias("question"))
    docs = t.load(s, d, "documents").select("doc_id", (F.col("doc_id") % 40).alias("item_id"), F.when(F.col("doc_id") % 9 > 0, F.col("text")).otherwise(" ").alias("content"))
    return r.rerank_score(docs.join(b, "item_id")).select("doc_id", "score")


QUERIES = {
    "ids_in": lambda s, d: ls.ids_in(t.chunks(s, d).select("chunk_id", "doc_id"), t.load(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id"),
    "exists_flag": lambda s, d: ls.exists_flag(t.docs(s, d).select("doc_id", "user_id", "content_hash"), t.docs(s, d).where("status = 2").select("user_id", "content_hash"), ["user_id", "content_hash"], "ready_twin").select("doc_id", "ready_twin"),
    "new_duplicates": lambda s, d: ls.new_duplicates(uploads(s, d), t.docs(s, d).where("doc_id % 2 = 0")),
    "selectable_docs": lambda s, d: ls.selectable_docs(t.docs(s, d)).select("doc_id", "status"),
    "may_see": lambda s, d: ls.may_see(t.messages(s, d).select(F.col("message_id").alias("request_id"), (F.col("session_id") + F.col("turn") % 2 * 50_000).alias("session_id"), (F.col("message_id") % 7).alias("user_id"), (F.col("turn") % 5 == 4).alias("is_admin")), t.sessions(s, d)),
    "lookup_rate": lambda s, d: rounded(ca.hit_rate(ca.lookup_stats(events(s, d).select(F.col("event_type").alias("key"), "at"), 600, 7200)), "rate"),
    "processing_notes": lambda s, d: ln.processing_notes(t.docs(s, d).select("doc_id"), doc_notes(s, d)),
    "history_plan": lambda s, d: ch.history_plan(t.messages(s, d).withColumn("cost", count_tokens(F.col("content"))), 200, 60, 4, 8),
    "page_layout_by_kind": lambda s, d: rounded(ch.page_layout(kinds(s, d)).select("doc_id", "chunk_idx", "top", "bottom"), "top", "bottom"),
    "split_rows": lambda s, d: fl.split_items(tokens(s, d).select("doc_id", "chunk_idx", "tokens"), "doc_id", "chunk_idx", "tokens", 150, F.col("doc_id") % 40),
    "semantic_pieces": lambda s, d: fl.semantic_pieces(t.load(s, d, "documents")),
    "session_rename": lambda s, d: st.session_transition(t.sessions(s, d), named_actions(s, d)).select("session_id", "title"),
    "bump_sessions": lambda s, d: st.bump_sessions(t.sessions(s, d), turns(s, d)),
    "cascade_users": lambda s, d: st.cascade_users(t.users(s, d), t.sessions(s, d), t.messages(s, d), t.docs(s, d), t.chunks(s, d), t.users(s, d).where("user_id % 7 IN (2, 3)").select("user_id"))["messages"].select("message_id", "response_to"),
    "admit_checked": lambda s, d: st.admit_checked(t.docs(s, d).where("doc_id % 2 = 0"), checked_uploads(s, d)),
    "serve_from_cache": lambda s, d: ca.serve_from_cache(asking(s, d), t.cache(s, d), t.feedback(s, d), t.NOW)[1].select("cache_id", "hit_count", "last_hit"),
    "cache_upsert_sources": lambda s, d: ca.cache_upsert(t.cache(s, d), upserts(s, d), t.NOW).select("cache_id", "answer", F.array_join("images", ",").alias("images"), "source_doc_ids"),
    "numbered_context": lambda s, d: an.numbered_context(sourced(s, d), 120)[0],
    "complaint_prompts": lambda s, d: an.complaint_prompts(asking(s, d), told_feedback(s, d), t.START - 2000 * t.DAY, 0.2, 0.5),
    "image_hash": lambda s, d: t.load(s, d, "documents").select("doc_id", x.content_hash(F.col("text"), 400).alias("hash")),
    "cutoffs": lambda s, d: t.docs(s, d).select("doc_id", x.months_ago(F.col("created"), 6).alias("half_year"), x.day_end(F.col("created")).alias("day_end")),
    "rerank_score": overlap,
}
_T = t.with_tables
ORACLE_SQL = {
    "rerank_score": f"""WITH c AS (SELECT doc_id, b.text AS question, CASE WHEN doc_id % 9 > 0 THEN d.text ELSE ' ' END AS content FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 40),
      w AS (SELECT doc_id, content, list_distinct({TERMS.format('question')}) AS asked, {TERMS.format('left(content, 1500)')} AS has FROM c)
      SELECT doc_id, CASE WHEN len(asked) > 0 AND regexp_matches(content, '\\S') THEN len(list_intersect(asked, has)) / len(asked) END AS score FROM w""",
    "serve_from_cache": f"""WITH r AS (SELECT cache_id AS served, count(*) AS n FROM ({CHUNKING_SQL['answer_from_cache']}) AS a WHERE route = 'FAST' GROUP BY cache_id)
      SELECT cache_id, CAST(hit_count + coalesce(n, 0) AS BIGINT) AS hit_count, CASE WHEN n IS NULL THEN last_hit ELSE greatest(last_hit, {t.NOW}) END AS last_hit FROM ({t.SQL['cache']}) AS c LEFT JOIN r ON served = cache_id""",
    "ids_in": _T("SELECT chunk_id, doc_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)", "chunks"),
    "exists_flag": _T("SELECT doc_id, EXISTS (SELECT 1 FROM docs o WHERE o.status = 2 AND o.user_id = d.user_id AND o.content_hash = d.content_hash) AS ready_twin FROM docs d", "docs"),
    "new_duplicates": _T("SELECT f.doc_id AS file_id, min(o.doc_id) AS doc_id, arg_min(o.file_name, o.doc_id) AS file_name FROM docs f JOIN docs o ON o.doc_id % 2 = 0 AND o.user_id = f.doc_id % 3 AND o.content_hash = f.content_hash GROUP BY f.doc_id", "docs"),
    "selectable_docs": _T("SELECT doc_id, status FROM docs WHERE status NOT IN (0, 1)", "docs"),
    "may_see": _T("SELECT m.message_id AS request_id, CASE WHEN s.session_id IS NOT NULL THEN m.turn % 5 = 4 OR s.user_id = m.message_id % 7 END AS allowed FROM messages m LEFT JOIN sessions s ON s.session_id = m.session_id + m.turn % 2 * 50000", "messages", "sessions"),
    "lookup_rate": """WITH RECURSIVE o AS (SELECT event_type AS key, CAST(floor(epoch(ts)) AS BIGINT) AS sec, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS rn FROM events),
      w AS (SELECT key, rn, sec AS loaded, sec AS last, false AS hit FROM o WHERE rn = 1 UNION ALL
        SELECT o.key, o.rn, CASE WHEN o.sec - w.last < 600 AND o.sec - w.loaded < 7200 THEN w.loaded ELSE o.sec END, o.sec, o.sec - w.last < 600 AND o.sec - w.loaded < 7200 FROM w JOIN o ON o.key = w.key AND o.rn = w.rn + 1)
      SELECT key, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, round(count(*) FILTER (WHERE hit) / count(*), 6) AS rate FROM w GROUP BY key""",
    "processing_notes": _T("MORE n AS (SELECT doc_id, string_agg(concat('n', chunk_idx), ' | ' ORDER BY chunk_idx) AS notes FROM chunks WHERE chunk_idx % 6 = 0 GROUP BY doc_id) SELECT doc_id, notes FROM docs LEFT JOIN n USING (doc_id)", "docs", "chunks"),
    "history_plan": _T(r"""MORE c AS (SELECT *, len(list_filter(regexp_split_to_array(content, '\s+'), lambda w: w <> '')) AS cost FROM messages), w AS (SELECT *, row_number() OVER p AS back, sum(cost) OVER p AS used FROM c WINDOW p AS (PARTITION BY session_id ORDER BY turn DESC))
      SELECT session_id, message_id, CASE WHEN back = 1 OR (back <= 4 AND used <= 140) THEN 'raw' ELSE 'summary' END AS part FROM w WHERE back <= 8""", "messages"),
    "page_layout_by_kind": _T("""MORE w AS (SELECT doc_id, chunk_idx, page, CASE chunk_idx % 5 WHEN 0 THEN greatest(length(content), 200) WHEN 1 THEN greatest(length(content), 100) WHEN 2 THEN 100 WHEN 3 THEN 10 ELSE greatest(length(content), 20) END AS w FROM chunks),
      s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, page ORDER BY chunk_idx) AS run, sum(w) OVER (PARTITION BY doc_id, page) AS total FROM w) SELECT doc_id, chunk_idx, round((run - w) / total, 6) AS top, round(run / total, 6) AS bottom FROM s""", "chunks"),
    "split_rows": "WITH RECURSIVE " + _T(f"""MORE {TOK}, o AS (SELECT doc_id, chunk_idx, tokens, doc_id % 40 AS head, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS rn FROM tok),
      w AS (SELECT doc_id, chunk_idx, rn, 0 AS piece, CAST(tokens AS BIGINT) AS used, tokens, head FROM o WHERE rn = 1 UNION ALL
        SELECT o.doc_id, o.chunk_idx, o.rn, CASE WHEN w.used > 0 AND o.head + w.used + o.tokens > 150 THEN w.piece + 1 ELSE w.piece END, CASE WHEN w.used > 0 AND o.head + w.used + o.tokens > 150 THEN o.tokens ELSE w.used + o.tokens END, o.tokens, o.head FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
      SELECT doc_id, piece, min(chunk_idx) AS first, count(*) AS n, CAST(sum(tokens) + max(head) AS BIGINT) AS cost FROM w GROUP BY doc_id, piece""", "chunks").removeprefix("WITH "),
    "session_rename": _T("MORE r AS (SELECT event_id % 97 AS session_id, arg_max(left(concat('T', repeat('x', CAST(event_id % 80 AS INT))), 60), event_id) AS title FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT s.session_id, coalesce(r.title, s.title) AS title FROM sessions s LEFT JOIN r USING (session_id)", "sessions"),
    "bump_sessions": _T("""MORE p AS (SELECT session_id + CASE WHEN turn % 4 = 0 THEN 100000 ELSE 0 END AS session_id, max(created) AS last, arg_min(left(trim(content), 60), {'a': created, 'b': content}) AS first FROM messages WHERE role = 0 GROUP BY 1)
      SELECT coalesce(s.session_id, p.session_id) AS session_id, coalesce(nullif(trim(s.title), ''), p.first) AS title, greatest(s.updated, p.last) AS updated FROM sessions s FULL OUTER JOIN p ON s.session_id = p.session_id""", "sessions", "messages"),
    "cascade_users": _T("MORE gone AS (SELECT session_id FROM sessions WHERE user_id IN (SELECT user_id FROM users WHERE user_id % 7 IN (2, 3))), lost AS (SELECT message_id FROM messages WHERE session_id IN (SELECT session_id FROM gone)) SELECT message_id, CASE WHEN response_to NOT IN (SELECT message_id FROM lost) THEN response_to END AS response_to FROM messages WHERE message_id NOT IN (SELECT message_id FROM lost)", "users", "sessions", "messages"),
    "admit_checked": _T("""MORE f AS (SELECT doc_id AS file_id, doc_id % 3 AS user_id, upper(file_name) AS name, lower(file_name) AS k, content_hash, doc_id % 9 > 0 AS kind, doc_id % 20 < 5 OR doc_id % 3 = 0 AS fits FROM docs), e AS (SELECT DISTINCT user_id, lower(file_name) AS k FROM docs WHERE doc_id % 2 = 0),
      h AS (SELECT user_id, content_hash, min(file_name) AS had FROM docs WHERE doc_id % 2 = 0 GROUP BY ALL), x AS (SELECT f.*, e.k IS NOT NULL OR row_number() OVER (PARTITION BY f.user_id, f.k ORDER BY file_id) > 1 AS named, had, row_number() OVER (PARTITION BY f.user_id, f.content_hash ORDER BY file_id) AS twin,
        first_value(name) OVER (PARTITION BY f.user_id, f.content_hash ORDER BY file_id) AS first FROM f LEFT JOIN e ON e.user_id = f.user_id AND e.k = f.k LEFT JOIN h ON h.user_id = f.user_id AND h.content_hash = f.content_hash)
      SELECT file_id, CASE WHEN named THEN 'name conflict' WHEN NOT kind THEN 'unknown type' WHEN NOT fits THEN 'wrong content' WHEN had IS NOT NULL OR twin > 1 THEN 'content conflict' ELSE 'Pending' END AS outcome,
        CASE WHEN NOT named AND kind AND fits AND (had IS NOT NULL OR twin > 1) THEN coalesce(had, first) END AS same_as FROM x""", "docs"),
    "cache_upsert_sources": _T("""MORE n AS (SELECT lower(trim(text)) AS k, max(doc_id) AS id FROM documents WHERE doc_id % 20 = 0 GROUP BY 1)
      SELECT coalesce(c.cache_id, n.id + 1000000) AS cache_id, CASE WHEN n.id IS NULL THEN c.answer ELSE 'new' END AS answer, CASE WHEN n.id IS NOT NULL THEN concat('i', n.id) END AS images, CASE WHEN n.id IS NULL THEN c.source_doc_ids ELSE CAST(n.id AS VARCHAR) END AS source_doc_ids
      FROM cache c FULL OUTER JOIN n ON n.k = lower(c.question)""", "cache"),
    "numbered_context": _T(f"""MORE {TOK}, g AS (SELECT * FROM tok WHERE length(trim(content)) + 14 > 20), p AS (SELECT *, row_number() OVER w AS place, sum(tokens) OVER w AS used FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_idx)),
      k AS (SELECT *, sum(CASE WHEN chunk_idx % 3 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS number FROM p WHERE place = 1 OR (used <= 120 AND place <= 16))
      SELECT doc_id AS q_id, string_agg(concat(repeat('═', 59), chr(10), '  KAYNAK [', place, ']  •  Belge: ', header, ' | Sayfa ', page, CASE WHEN chunk_idx % 2 = 0 AND trim(left(content, 3)) <> '' THEN concat(' | ', left(content, 3)) ELSE '' END, chr(10), repeat('═', 59), chr(10), chr(10),
        ltrim(content), CASE WHEN chunk_idx % 3 > 0 THEN concat(' [[IMG-', number, ': cap]]') ELSE ' [IMG:1 — cap]' END), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context FROM k GROUP BY doc_id""", "chunks"),
    "image_hash": "SELECT doc_id, CASE WHEN octet_length(encode(text)) >= 400 THEN upper(sha256(text)) END AS hash FROM documents",
    "cutoffs": _T("SELECT doc_id, CAST(epoch(to_timestamp(created) - INTERVAL 6 MONTH) AS BIGINT) AS half_year, created + 86400 AS day_end FROM docs", "docs"),
}
