"""Registered queries of composed texts, finished answers and the full-text query syntax."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeline.functions import compose as c
from lakeline.operators import answers as an
from lakeline.operators import websearch as ws
from lakeline.operators.index import FIELDS, terms
from lakeline.plans.retrieval import TERMS, rounded
from lakeline.sources import tables as t


def asked(s, d):
    """Each question of a user with the last answer before it; every fourth session has an enriched form."""
    before = Window.partitionBy("session_id").orderBy("turn", "content").rowsBetween(Window.unboundedPreceding, -1)
    m = t.messages(s, d).withColumn("last_answer", F.last(F.when(F.col("role") == 1, F.col("content")), True).over(before)).where("role = 0")
    return m.select("message_id", "content", "last_answer", F.when(F.col("session_id") % 4 == 0, F.concat(F.lit("about "), "content")).alias("enriched"), (F.col("session_id") % 3 == 0).alias("standalone"))


def search_texts(s, d):
    text, vector = c.search_texts(F.col("content"), F.col("enriched"), F.col("last_answer"), F.col("standalone"))
    return asked(s, d).select("message_id", text.alias("text_query"), vector.alias("embed_text"))


def chunk_texts(s, d):
    """Every chunk with its header, a context for each second one, and a caption for its first image."""
    told = F.array(F.lit("cat"), F.lit(" "))
    x = t.chunks(s, d).withColumn("ctx", F.when(F.col("chunk_idx") % 2 == 0, F.concat(F.lit("part "), "chunk_idx")).otherwise(""))
    md, clean = c.chunk_text(F.col("header"), F.concat("content", F.lit(" [IMG:1] [IMG:2]")), F.col("content"))
    return x.select("chunk_id", c.final_content(F.col("ctx"), md, told).alias("stored"), c.embed_text(F.col("ctx"), clean, md, told).alias("embedded"))


def dedup_img_paths(s, d):
    x = t.chunks(s, d).withColumn("s", F.concat("content", F.lit(" [IMG:1] [IMG:2 x] [IMG:3] [IMG:4]")))
    paths = F.transform(F.array(F.lit("a"), F.lit("b"), F.lit("c")), lambda p: F.concat(p, F.col("chunk_id")))
    text, kept = c.dedup_img_paths(F.col("s"), paths, F.array((F.col("doc_id") % 2).cast("string"), (F.col("chunk_idx") % 2).cast("string"), F.lit(None)))
    return x.select("chunk_id", text.alias("content"), kept.alias("paths"))


def raw_answers(s, d):
    m = t.messages(s, d).where("role = 1")
    mark = F.when(F.col("message_id") % 5 == 0, "[NO_ANSWER]: ").otherwise("")
    image = F.when(F.col("message_id") % 3 == 0, " [[IMG-1]] [[IMG-7]]").otherwise("")
    return m.select(
        F.col("message_id").alias("q_id"), F.concat(mark, F.lit("A"), "content", F.lit(" (KAYNAK [1])"), image, F.lit(".")).alias("answer"), F.array(F.lit("p"), F.lit("q")).alias("paths"), F.array(F.lit("cat")).alias("captions"),
        (F.col("message_id") % 2 == 0).alias("standalone"), (F.col("message_id") % 11 / 10).alias("score"), F.when(F.col("message_id") % 7 == 0, F.array(F.lit("x"))).alias("issues"), (F.col("message_id") % 13 != 0).alias("validated"),
    )


def field_questions(s, d):
    """Every twentieth document asks for its source and the first word of its text: the one is in headers only. The word
    is quoted, since it may be ``or``; documents without a source, or whose source is that word, don't ask."""
    x = t.load(s, d, "documents").where("doc_id % 20 = 0").withColumn("w", terms(F.col("text"))).where((F.size("w") > 0) & (F.lower("source") != F.col("w")[0]))
    return x.select(F.col("doc_id").alias("q_id"), F.concat("source", F.lit(' "'), F.col("w")[0], F.lit('"')).alias("question"))


def syntax_questions(s, d):
    """Every twentieth benchmark item asks by two of its words: both, as a phrase, either, or one without the other."""
    b = t.load(s, d, "benchmark").where("item_id % 20 = 0").withColumn("w", terms(F.col("text"))).where(F.size("w") > 1)
    first, second, kind = F.col("w")[0], F.col("w")[1], F.floor(F.col("item_id") / 20) % 4
    q = F.when(kind == 0, F.concat_ws(" ", first, second)).when(kind == 1, F.concat(F.lit('"'), first, F.lit(" "), second, F.lit('"'))).when(kind == 2, F.concat(first, F.lit(" or "), second)).otherwise(F.concat(first, F.lit(" -"), second))
    return b.select(F.col("item_id").alias("q_id"), q.alias("question"))


QUERIES = {
    "search_texts": search_texts,
    "chunk_texts": chunk_texts,
    "dedup_img_paths": dedup_img_paths,
    "finalize_answers": lambda s, d: an.finalize_answers(raw_answers(s, d)),
    "web_search_fields": lambda s, d: rounded(ws.web_search(field_questions(s, d), ws.word_places(t.chunks(s, d), fields=FIELDS)), "score"),
    "web_search": lambda s, d: rounded(ws.web_search(syntax_questions(s, d), ws.word_places(t.chunks(s, d))), "score"),
}
ORACLE_SQL = {
    "search_texts": t.with_tables(
        """MORE a AS (SELECT *, last_value(CASE WHEN role = 1 THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn, content ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM messages)
      SELECT message_id, CASE WHEN session_id % 4 = 0 THEN 'about ' || content ELSE content END AS text_query,
      CASE WHEN session_id % 3 <> 0 AND trim(last) <> '' THEN concat_ws(' ', CASE WHEN session_id % 4 = 0 THEN 'about ' || content END, left(last, 600)) WHEN session_id % 4 = 0 THEN 'about ' || content ELSE content END AS embed_text FROM a WHERE role = 0""",
        "messages",
    ),
    "chunk_texts": t.with_tables(
        """SELECT chunk_id, CASE WHEN chunk_idx % 2 = 0 THEN concat('**[Bağlam]:** part ', chunk_idx, chr(10), chr(10)) ELSE '' END || replace(CASE WHEN trim(header) <> '' THEN concat('**', header, '**', chr(10), chr(10)) ELSE '' END || content || ' [IMG:1] [IMG:2]', '[IMG:1]', '[IMG:1 — cat]') AS stored,
      concat_ws(' ', CASE WHEN chunk_idx % 2 = 0 THEN concat('part ', chunk_idx) END, CASE WHEN trim(header) <> '' THEN header || ' ' || content WHEN content = '' THEN content || ' [IMG:1] [IMG:2]' ELSE content END, 'cat') AS embedded FROM chunks WHERE content IS NOT NULL""",
        "chunks",
    ),
    "dedup_img_paths": t.with_tables(
        """SELECT chunk_id, content || CASE WHEN doc_id % 2 = chunk_idx % 2 THEN ' [IMG:1] [IMG:1 x] [IMG:2] [IMG:4]' ELSE ' [IMG:1] [IMG:2 x] [IMG:3] [IMG:4]' END AS content,
      CASE WHEN doc_id % 2 = chunk_idx % 2 THEN ['a' || chunk_id, 'c' || chunk_id] ELSE ['a' || chunk_id, 'b' || chunk_id, 'c' || chunk_id] END AS paths FROM chunks""",
        "chunks",
    ),
    "finalize_answers": t.with_tables(
        """MORE a AS (SELECT message_id AS q_id, message_id % 5 = 0 AS rejected, message_id % 3 = 0 AS pictured, (message_id % 11) / 10 AS score, trim('A' || content) AS body FROM messages WHERE role = 1 AND content IS NOT NULL)
      SELECT q_id, rtrim(regexp_replace(body, '\\s+$', '')) || CASE WHEN pictured AND rejected THEN '  .' WHEN pictured THEN ' ![cat](/uploads/p) .' ELSE '.' END AS answer, CASE WHEN rejected THEN [] WHEN pictured THEN ['p'] ELSE ['p', 'q'] END AS images, rejected,
      CASE WHEN score < 0.4 THEN 'critical' WHEN score < 0.65 THEN 'medium' ELSE 'none' END AS badge, q_id % 2 = 0 AND NOT rejected AND q_id % 13 <> 0 AND (score >= 0.65 OR (score >= 0.4 AND q_id % 7 <> 0)) AS cached FROM a""",
        "messages",
    ),
    "web_search_fields": t.with_tables(
        rf"""MORE q AS (SELECT doc_id AS q_id, lower(source) AS a, ({TERMS.format('text')})[1] AS b FROM documents WHERE doc_id % 20 = 0 AND len({TERMS.format('text')}) > 0),
      w AS (SELECT chunk_id, {TERMS.format('content')} AS w, {TERMS.format('header')} AS h FROM chunks),
      p AS (SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos, 1.0::DOUBLE AS weight FROM w UNION ALL SELECT chunk_id, unnest(h), len(w) + 1 + generate_subscripts(h, 1) - 1, 0.4::DOUBLE FROM w),
      e AS (SELECT q_id, chunk_id, pos, weight, term = a AS is_a, lag(pos) OVER k AS p0, lag(weight) OVER k AS w0, lag(term) OVER k AS t0, term FROM p JOIN q ON term = a OR term = b WHERE a <> b WINDOW k AS (PARTITION BY q_id, chunk_id ORDER BY pos)),
      s AS (SELECT q_id, chunk_id, sum(2 / (1 / weight + 1 / w0) / (1 + pos - p0 - 1)) AS score FROM e WHERE t0 <> term GROUP BY ALL)
      SELECT q_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s) AS r WHERE rank <= 12""", "chunks"),
    "web_search": t.with_tables(
        f"""MORE q AS (SELECT item_id AS q_id, w[1] AS a, w[2] AS b, (item_id // 20) % 4 AS kind FROM (SELECT item_id, {TERMS.format('text')} AS w FROM benchmark WHERE item_id % 20 = 0) AS x WHERE len(w) > 1),
      words AS (SELECT chunk_id, {TERMS.format('content')} AS w FROM chunks), p AS (SELECT chunk_id, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM words),
      h AS (SELECT q_id, kind, a, b, chunk_id, pos, term FROM q JOIN p ON term = a OR term = b),
      n AS (SELECT *, lag(term) OVER w AS before_term, lag(pos) OVER w AS before FROM h WINDOW w AS (PARTITION BY q_id, chunk_id ORDER BY pos)),
      s AS (SELECT q_id, chunk_id, CASE WHEN kind = 0 AND before_term <> term THEN 1 / (pos - before) WHEN kind = 1 AND before_term = a AND term = b AND before = pos - 1 THEN 1 WHEN kind = 2 THEN 1 WHEN kind = 0 AND a = b THEN 1
        WHEN kind = 3 AND NOT EXISTS (SELECT 1 FROM p o WHERE o.chunk_id = n.chunk_id AND o.term = n.b) THEN 1 END AS part FROM n),
      r AS (SELECT q_id, chunk_id, sum(part) AS score FROM s WHERE part IS NOT NULL GROUP BY q_id, chunk_id)
      SELECT q_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM r) AS z WHERE rank <= 12""",
        "chunks",
    ),
}
