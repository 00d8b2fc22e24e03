"""Registered queries of pictures, pieces of text, pages and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.functions.split import split_text
from lakeline.operators import listing, pictures
from lakeline.plans.ingest import text_pages
from lakeline.sources import tables as t


def order_tables(s, d):
    """A table for each order: of its lines, with blanks by part and supplier."""
    cells = F.array(F.when(F.col("l_partkey") % 3 == 0, "").otherwise(F.col("l_partkey").cast("string")), F.when(F.col("l_suppkey") % 2 == 0, " ").otherwise("a|b"), F.col("l_returnflag"), F.when(F.col("l_partkey") % 5 < 4, "").otherwise("x"))
    rows = t.load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("c")))).alias("r"))
    return rows.select("table_id", F.array(F.lit("Part"), F.lit("col2"), F.lit("Flag"), F.lit("Pic")).alias("headers"), F.transform("r", lambda x: x.c).alias("rows"))


def order_images(s, d):
    """Up to three pictures for each order."""
    o = t.load(s, d, "orders").select(F.col("o_orderkey").alias("table_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pos"), (F.col("o_custkey") % 4).alias("n"))
    return o.where("pos <= n").select("table_id", "pos", F.concat(F.lit("i"), "pos").alias("path"))


def marked_chunks(s, d):
    """Each document is a question, its lines the chunks: two markers a line, and up to two paths."""
    c = t.chunks(s, d)
    content = F.concat("content", F.lit(" [IMG:"), F.col("chunk_idx") % 4, F.lit(" — cap"), F.col("doc_id") % 3, F.lit("] mid [IMG:2]"))
    return c.select(F.col("doc_id").alias("q_id"), F.col("chunk_idx").alias("rank"), content.alias("content"), F.slice(F.array(F.lit("p"), F.lit("q")), 1, F.col("chunk_idx") % 3).alias("paths"))


def embedded(s, d):
    """Names that pages may hold: the parts of their URLs, and one that none has."""
    p = t.load(s, d, "pages")
    return p.select("page_id", F.explode(F.concat(F.filter(F.split("url", "[/.:]+"), lambda x: x != ""), F.array(F.concat(F.lit("no-such-"), "page_id")))).alias("uri"))


def name_requests(s, d):
    x = t.docs(s, d)
    return x.select(F.col("doc_id").alias("request_id"), F.when(F.col("doc_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("user_id"), F.upper("file_name").alias("file_name"))


QUERIES = {
    "render_tables": lambda s, d: pictures.render_tables(order_tables(s, d), order_images(s, d)),
    "number_images": lambda s, d: pictures.number_images(marked_chunks(s, d))[0],
    "image_map": lambda s, d: pictures.number_images(marked_chunks(s, d))[1],
    "orphan_images": lambda s, d: pictures.orphan_images(embedded(s, d), t.load(s, d, "pages")),
    "split_text": lambda s, d: t.load(s, d, "documents").select("doc_id", "text").lateralJoin(split_text(F.col("text").outer(), F.lit(120))).select("doc_id", "piece_no", "piece"),
    "scan_pages": lambda s, d: t.scan_pages(text_pages(s, d)),
    "name_taken": lambda s, d: listing.name_taken(name_requests(s, d), t.docs(s, d)),
}
_T = t.with_tables
MARKED = """c AS (SELECT doc_id AS q_id, chunk_idx AS rank, content AS own, concat(' [IMG:', chunk_idx % 4, ' — cap', doc_id % 3, ']') AS first, chunk_idx % 4 AS n, chunk_idx % 3 AS k, doc_id % 3 AS cap FROM chunks),
  m AS (SELECT q_id, rank, 0 AS i, n AS name, concat('cap', cap) AS caption FROM c WHERE n BETWEEN 1 AND k UNION ALL SELECT q_id, rank, 1, 2, NULL FROM c WHERE k >= 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rank, i) AS number FROM m)"""
ORACLE_SQL = {
    "render_tables": """WITH z AS (SELECT l_orderkey AS table_id, l_linenumber, [CASE WHEN l_partkey % 3 = 0 THEN '' ELSE CAST(l_partkey AS VARCHAR) END, CASE WHEN l_suppkey % 2 = 0 THEN '' ELSE 'a\\|b' END, l_returnflag, CASE WHEN l_partkey % 5 < 4 THEN '' ELSE 'x' END] AS c FROM lineitem),
      r AS (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY l_linenumber, c) AS row, c FROM z),
      n AS (SELECT table_id, col, count(*) FILTER (WHERE c[col] = '') AS n, count(*) AS all_rows FROM r, (SELECT unnest([1, 2, 3, 4]) AS col) GROUP BY ALL), into_col AS (SELECT table_id, arg_min(col, -10 * n + col) AS col FROM n WHERE 2 * n >= all_rows AND n > 0 GROUP BY table_id),
      f AS (SELECT r.*, i.col, coalesce(c[i.col] = '' AND 2 * len(list_filter(c, lambda x: x = '')) < 4, false) AS free FROM r LEFT JOIN into_col i USING (table_id)), k AS (SELECT *, CASE WHEN free THEN row_number() OVER (PARTITION BY table_id, free ORDER BY row) END AS k FROM f),
      img AS (SELECT o_orderkey AS table_id, pos, concat('[IMG_PATH:i', pos, ']') AS mark FROM orders, (SELECT unnest([1, 2, 3]) AS pos) WHERE pos <= o_custkey % 4),
      lines AS (SELECT k.table_id, k.row, concat('| ', array_to_string(list_transform(c, lambda x, j: CASE WHEN j = col AND mark IS NOT NULL THEN mark ELSE x END), ' | '), ' |') AS line FROM k LEFT JOIN img ON img.table_id = k.table_id AND img.pos = k.k),
      body AS (SELECT table_id, string_agg(line, chr(10) ORDER BY row) AS body FROM lines GROUP BY table_id), room AS (SELECT table_id, count(k) AS room FROM k GROUP BY table_id),
      rest AS (SELECT table_id, string_agg(mark, chr(10) ORDER BY pos) AS rest FROM img JOIN room USING (table_id) WHERE pos > room GROUP BY table_id)
      SELECT table_id, concat('| Part |  | Flag | Pic |', chr(10), '| --- | --- | --- | --- |', chr(10), body, CASE WHEN rest IS NULL THEN '' ELSE chr(10) || rest END) AS markdown FROM body LEFT JOIN rest USING (table_id)""",
    "number_images": _T(f"""MORE {MARKED} SELECT c.q_id, c.rank, concat(own, CASE WHEN a.number IS NULL THEN first ELSE concat(' [[IMG-', a.number, ': ', a.caption, ']]') END, ' mid ', CASE WHEN b.number IS NULL THEN '[IMG:2]' ELSE concat('[[IMG-', b.number, ']]') END) AS content
      FROM c LEFT JOIN o a ON a.q_id = c.q_id AND a.rank = c.rank AND a.i = 0 LEFT JOIN o b ON b.q_id = c.q_id AND b.rank = c.rank AND b.i = 1""", "chunks"),
    "image_map": _T(f"MORE {MARKED} SELECT q_id, number, ['p', 'q'][name] AS path, caption FROM o", "chunks"),
    "orphan_images": "SELECT DISTINCT page_id, uri FROM (SELECT page_id, html, unnest(list_append(list_filter(regexp_split_to_array(url, '[/.:]+'), lambda x: x <> ''), concat('no-such-', page_id))) AS uri FROM pages) AS e WHERE NOT coalesce(contains(html, uri), false)",
    "scan_pages": _T("MORE p AS (SELECT doc_id, chunk_idx // 20 AS i, string_agg(content, chr(10) ORDER BY chunk_idx) AS markdown FROM chunks GROUP BY ALL) SELECT doc_id, CAST(i + 1 AS INT) AS page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INT) AS place, markdown FROM p", "chunks"),
    "name_taken": _T("SELECT doc_id AS request_id, EXISTS (SELECT 1 FROM docs o WHERE o.user_id = d.user_id + d.doc_id % 2 AND lower(o.file_name) = lower(d.file_name)) AS taken FROM docs d", "docs"),
}
