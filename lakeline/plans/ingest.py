"""Registered queries of split tables, sections, the store and the whole way from pages to chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeline.operators import ingest as ing
from lakeline.operators import markdown as md
from lakeline.operators import sections as se
from lakeline.plans.chunking import tokens
from lakeline.sources import store as st
from lakeline.sources import tables as t
from lakeline.sources.shared import shared_dir


def table_pages(s, d):
    """Each order is a page of one of a hundred documents: a table of its lines, with a text behind or before it on some.
    The headers are repeated, made up, partly made up or of another width, by the number of the order."""
    o, li = t.load(s, d, "orders"), t.load(s, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), "l_returnflag").alias("r")))).alias("r"))
    k = F.col("o_orderkey")
    headers = F.when(k % 11 == 0, F.array(F.lit("Part"), F.lit("Supp"))).when(k % 3 == 0, F.array(*map(F.lit, ("col1", "col2", "col3")))).when(k % 5 == 0, F.array(F.lit("x"), F.lit("col2"), k.cast("string"))).when(k % 2 == 0, F.array(*map(F.lit, ("PART", "supp", "Flag")))).otherwise(F.array(*map(F.lit, ("Part", "Supp", "Flag"))))
    pages = o.join(lines, k == F.col("l_orderkey")).select((F.col("o_custkey") % 100).alias("doc_id"), k.alias("page"), headers.alias("headers"), F.transform("r", lambda x: F.slice(x.r, 1, F.size(headers))).alias("rows"))
    none = F.lit(None)
    empty = (none.cast("array<string>"), none.cast("array<array<string>>"))
    kinds = [("table", 1, F.lit(True), F.col("headers"), F.col("rows")), ("text", 0, F.col("page") % 13 == 0, *empty), ("table", 2, F.col("page") % 7 == 0, F.col("headers"), F.col("rows")), ("text", 3, F.col("page") % 9 == 0, *empty)]
    parts = [pages.where(c).select("doc_id", (F.col("page") * 4 + n).alias("block"), "page", F.lit(k).alias("kind"), F.concat(F.lit("h"), F.col("page") % 2 * F.lit(n).cast("long")).alias("header_path"), F.lit("t").alias("text"), h.alias("headers"), r.alias("rows")) for k, n, c, h, r in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def lines_as_units(s, d):
    """Every line of the documents is a unit; three lines are a block, whose kind and header path go by its number."""
    x = tokens(s, d).withColumn("block", F.floor(F.col("chunk_idx") / 3).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("text", "text", "list", "table", "text", "code", "math"))), F.col("block") % 7 + 1)
    return x.select("doc_id", "block", (F.col("chunk_idx") % 3).cast("int").alias("unit"), kind.alias("kind"), F.concat(F.lit("h"), F.floor(F.col("block") / 5)).alias("header_path"), "tokens", F.when(kind == "table", 4).otherwise(0).alias("head_tokens"), (F.col("tokens") % 5 == 0).alias("far"))


def text_pages(s, d):
    """The documents' whole texts as pages of twenty lines."""
    lines = t.chunks(s, d).withColumn("page_index", F.floor(F.col("chunk_idx") / 20).cast("int"))
    return lines.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", "content"))), lambda x: x.content), "\n").alias("markdown"))


def two_runs(s, d):
    """All chunks are written, then those of every third document again, changed; every ninth loses its chunks."""
    store = f"{shared_dir(s)}/lakeline/{uuid.uuid4().hex}"
    c = t.chunks(s, d).select("doc_id", "chunk_idx", "content")
    st.write_chunks(c, store, 1)
    again = c.where("doc_id % 3 = 0")
    st.write_chunks(again.where("doc_id % 9 <> 0").withColumn("content", F.concat(F.lit("new "), "content")), store, 2, again)
    return st.read_table(s, store, "chunks").select("doc_id", "chunk_idx", "content")


QUERIES = {
    "join_split_tables": lambda s, d: md.join_split_tables(table_pages(s, d)).select("doc_id", "block", "page", "kind", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows")),
    "split_sections": lambda s, d: se.split_sections(lines_as_units(s, d), 120),
    "split_sections_semantic": lambda s, d: se.split_sections(lines_as_units(s, d), 120, "semantic", 60),
    "write_chunks": two_runs,
    "process_documents": lambda s, d: ing.process_documents(text_pages(s, d)),
}
_T = t.with_tables
UNITS = r"""tok AS (SELECT *, CAST(len(list_filter(regexp_split_to_array(content, '\s+'), lambda x: x <> '')) AS INT) AS tokens FROM chunks),
  u AS (SELECT doc_id, chunk_idx // 3 AS block, chunk_idx % 3 AS unit, chunk_idx AS i, ['text', 'text', 'list', 'table', 'text', 'code', 'math'][chunk_idx // 3 % 7 + 1] AS kind, chunk_idx // 15 AS section, tokens, tokens % 5 = 0 AS far FROM tok),
  v AS MATERIALIZED (SELECT *, CASE WHEN kind = 'table' THEN 4 ELSE 0 END AS head, sum(tokens) OVER (PARTITION BY doc_id, block) + CASE WHEN kind = 'table' THEN 4 ELSE 0 END AS total,
    sum(tokens + CASE WHEN kind = 'table' AND unit = 0 THEN 4 ELSE 0 END) OVER (PARTITION BY doc_id, section) AS whole FROM u)"""


def sections_sql(semantic: bool, most: int, atomic: int) -> str:
    """The rules by cases on the state before: ``how`` is what the chunk in hand is."""
    kinds = "('table', 'code', 'math')" if semantic else "('table', 'code')"
    limit = f"CASE WHEN v.kind IN {kinds} THEN {atomic if semantic else most} ELSE {most} END"
    whole = "false" if semantic else f"v.whole <= {most}"
    far = "v.far" if semantic else "false"
    begins = f"""CASE WHEN {whole} THEN (p.how IS NULL OR v.section <> p.section) WHEN v.unit > 0 THEN p.how = 'cut' AND (p.used + v.tokens > {limit} OR {far})
      ELSE v.kind IN {kinds} OR v.total > {most} OR p.how IS NULL OR p.how <> 'open' OR v.section <> p.section OR v.kind <> p.kind OR p.used + v.total > {most} END"""
    how = f"""CASE WHEN {whole} THEN 'section' WHEN v.unit > 0 THEN p.how WHEN v.kind IN {kinds} THEN CASE WHEN v.total > {limit} AND v.kind <> 'math' THEN 'cut' ELSE 'alone' END WHEN v.total > {most} THEN 'cut' ELSE 'open' END"""
    used = f"""CASE WHEN v.unit > 0 THEN CASE WHEN p.how = 'cut' THEN CASE WHEN p.used + v.tokens > {limit} OR {far} THEN v.head + v.tokens ELSE p.used + v.tokens END ELSE p.used END
      WHEN v.kind IN {kinds} OR v.total > {most} THEN v.head + v.tokens WHEN {begins} THEN v.total ELSE p.used + v.total END"""
    return "WITH RECURSIVE " + _T(f"""MORE {UNITS}, w AS (
      SELECT v.doc_id, v.block, v.unit, v.i, v.section, v.kind, 0 AS chunk, CAST({used} AS BIGINT) AS used, {how} AS how FROM v, (SELECT NULL::VARCHAR AS how, NULL::BIGINT AS section, NULL::VARCHAR AS kind, 0::BIGINT AS used) AS p WHERE v.i = 0
      UNION ALL SELECT v.doc_id, v.block, v.unit, v.i, v.section, v.kind, p.chunk + CASE WHEN {begins} THEN 1 ELSE 0 END, CAST({used} AS BIGINT), {how} FROM w p JOIN v ON v.doc_id = p.doc_id AND v.i = p.i + 1)
      SELECT doc_id, block, unit, chunk FROM w""", "chunks").removeprefix("WITH ")


MADE = "list_transform({0}, lambda h, i: h = concat('col', i))"
JOINED = f"""WITH RECURSIVE li AS (SELECT l_orderkey, list([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag] ORDER BY l_linenumber, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), l_returnflag]) AS r FROM lineitem GROUP BY l_orderkey),
  pages AS (SELECT o_custkey % 100 AS doc_id, o_orderkey AS page, CASE WHEN o_orderkey % 11 = 0 THEN ['Part', 'Supp'] WHEN o_orderkey % 3 = 0 THEN ['col1', 'col2', 'col3'] WHEN o_orderkey % 5 = 0 THEN ['x', 'col2', CAST(o_orderkey AS VARCHAR)] WHEN o_orderkey % 2 = 0 THEN ['PART', 'supp', 'Flag'] ELSE ['Part', 'Supp', 'Flag'] END AS headers, r
    FROM orders JOIN li ON l_orderkey = o_orderkey),
  b AS (SELECT doc_id, page * 4 + n AS block, page, n, n IN (1, 2) AS is_table, concat('h', page % 2 * n) AS path, headers, list_transform(r, lambda x: x[1:len(headers)]) AS rows FROM pages, (SELECT unnest([0, 1, 2, 3]) AS n)
    WHERE n = 1 OR (n = 0 AND page % 13 = 0) OR (n = 2 AND page % 7 = 0) OR (n = 3 AND page % 9 = 0)),
  o AS MATERIALIZED (SELECT *, list_transform(headers, lambda h: lower(h)) AS low, list_bool_or({MADE.format('headers')}) AS made, list_bool_and({MADE.format('headers')}) AS all_made, row_number() OVER w AS rn, coalesce(page <> lag(page) OVER w, true) AS first FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block)),
  f AS (SELECT doc_id, rn, block, block AS root, page AS root_page, low AS root_low, is_table AS open FROM o WHERE rn = 1 UNION ALL
    SELECT o.doc_id, o.rn, o.block, CASE WHEN x THEN root ELSE o.block END, CASE WHEN x THEN root_page ELSE o.page END, CASE WHEN x THEN root_low ELSE o.low END, o.is_table
    FROM (SELECT o.*, f.root, f.root_page, f.root_low, f.open AND o.is_table AND o.first AND o.page <> root_page AND len(o.low) = len(root_low) AND (o.made OR o.low = root_low) AS x FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1) AS o),
  part AS (SELECT o.doc_id, f.root, o.block, CASE WHEN o.block = f.root OR o.all_made OR (NOT o.made AND o.low = r.low) THEN o.rows ELSE list_concat([list_transform(o.headers, lambda h, i: CASE WHEN h = concat('col', i) THEN '' ELSE h END)], o.rows) END AS rows FROM f JOIN o USING (doc_id, block) JOIN o r ON r.doc_id = f.doc_id AND r.block = f.root),
  a AS MATERIALIZED (SELECT o.doc_id, o.block, o.page, o.is_table, o.path, o.headers, o.low, o.made, o.all_made, p.rows, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.block) AS rn FROM (SELECT doc_id, root AS block, flatten(list(rows ORDER BY block)) AS rows FROM part GROUP BY doc_id, root) AS p JOIN o USING (doc_id, block)),
  g AS (SELECT doc_id, rn, block, block AS root, page, path, low, is_table AS open FROM a WHERE rn = 1 UNION ALL
    SELECT z.doc_id, z.rn, z.block, CASE WHEN x THEN root ELSE z.block END, CASE WHEN x THEN g_page ELSE z.page END, CASE WHEN x THEN g_path ELSE z.path END, CASE WHEN x THEN g_low ELSE z.low END, z.is_table
    FROM (SELECT a.*, g.root, g.page AS g_page, g.path AS g_path, g.low AS g_low, g.open AND a.is_table AND a.page = g.page AND a.path = g.path AND len(a.low) = len(g.low) AND (a.made OR a.low = g.low) AS x FROM g JOIN a ON a.doc_id = g.doc_id AND a.rn = g.rn + 1) AS z),
  last AS (SELECT a.doc_id, g.root, a.block, CASE WHEN a.block = g.root OR a.all_made OR (NOT a.made AND a.low = r.low) THEN a.rows ELSE list_concat([list_transform(a.headers, lambda h, i: CASE WHEN h = concat('col', i) THEN '' ELSE h END)], a.rows) END AS rows FROM g JOIN a USING (doc_id, block) JOIN a r ON r.doc_id = g.doc_id AND r.block = g.root)
  SELECT o.doc_id, o.block, o.page, CASE WHEN o.is_table THEN 'table' ELSE 'text' END AS kind, CASE WHEN o.is_table THEN array_to_string(o.headers, '|') END AS headers, CASE WHEN o.is_table THEN array_to_string(list_transform(l.rows, lambda r: array_to_string(r, '|')), ';') END AS rows
  FROM (SELECT doc_id, root AS block, flatten(list(rows ORDER BY block)) AS rows FROM last GROUP BY doc_id, root) AS l JOIN o USING (doc_id, block)"""
ORACLE_SQL = {
    "join_split_tables": JOINED,
    "split_sections": sections_sql(False, 120, 0),
    "split_sections_semantic": sections_sql(True, 120, 60),
    "write_chunks": _T("SELECT doc_id, chunk_idx, CASE WHEN doc_id % 3 = 0 THEN concat('new ', content) ELSE content END AS content FROM chunks WHERE doc_id % 9 <> 0", "chunks"),
}
