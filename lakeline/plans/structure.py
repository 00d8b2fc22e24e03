"""Registered queries of document structure; orders and their lines stand in for parsed pages and sheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.operators import chunking as ch
from lakeline.operators import markdown as md
from lakeline.sources import tables as t


def pages(s, d):
    """One markdown page for each order: a heading, a paragraph and a pipe table of its lines."""
    o, li = t.load(s, d, "orders"), t.load(s, d, "lineitem")
    lines = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("| "), "l_partkey", F.lit(" | "), "l_suppkey", F.lit(" |")).alias("r")))), lambda x: x.r), "\n").alias("table"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("o_custkey") % 100).alias("doc_id"), F.col("o_orderkey").alias("page_index"), F.concat(F.lit("# Customer "), "o_custkey", F.lit("\n\n## Order "), "o_orderkey", F.lit("\nStatus "), "o_orderstatus", F.lit("\n\n"), "table", F.lit("\n7\n- "), "o_orderpriority").alias("markdown")
    )


def sheet(s, d):
    li = t.load(s, d, "lineitem").where("l_linenumber <= 7")
    return li.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").cast("int").alias("row"), F.explode(F.array(F.struct((F.col("l_linenumber") % 3 + 1).cast("int").alias("c"), F.col("l_returnflag").alias("v")), F.struct(F.lit(5).alias("c"), F.when(F.col("l_linenumber") != 2, F.col("l_linestatus")).otherwise("").alias("v")))).alias("x")).select("sheet", "row", F.col("x.c").alias("col"), F.col("x.v").alias("text"))


def file_rows(s, d):
    li = t.load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").repartition("l_orderkey")  # the one shuffle: all steps behind go by file
    li = li.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"))
    cell = lambda k: F.when(F.col("l_linenumber") % k == 0, "").otherwise(F.col("l_returnflag"))
    return li.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").cast("int").alias("row_idx"), F.array(cell(2), cell(3), cell(5), F.lit("x|y")).alias("cells"))


def page_blocks(s, d):
    c = t.chunks(s, d).withColumn("weight", F.greatest(F.length("content"), F.lit(20)))
    return ch.page_layout(c).select("doc_id", "page", F.col("chunk_idx").alias("block"), "top", "bottom")


def images(s, d):
    return t.chunks(s, d).where("chunk_idx % 3 = 0").select("doc_id", F.col("chunk_id").alias("image_id"), (F.col("page") + F.col("chunk_idx") % 2).alias("page"), ((F.col("chunk_idx") * 7 % 10 + 0.5) / 10).alias("y"), F.col("chunk_id").alias("path"), F.left("content", F.lit(2)).alias("hash"), F.col("chunk_idx").alias("pos"))


QUERIES = {
    "markdown_blocks": lambda s, d: md.blocks(pages(s, d)),
    "cells_to_rows": lambda s, d: md.cells_to_rows(sheet(s, d)).select("sheet", "row", F.array_join("cells", ",").alias("cells")),
    "table_region": lambda s, d: md.table_region(file_rows(s, d)),
    "render_rows": lambda s, d: md.render_rows(file_rows(s, d)),
    "link_images": lambda s, d: md.link_images(page_blocks(s, d), images(s, d)),
    "first_image_by_hash": lambda s, d: md.first_image_by_hash(images(s, d)).select("image_id", "shared_path"),
}
_T = t.with_tables
CELL = "CASE WHEN l_linenumber % {k} = 0 THEN '' ELSE l_returnflag END"
ROWS = f"r AS (SELECT l_orderkey AS file_id, CAST(l_linenumber AS INT) AS row_idx, [{CELL.format(k=2)}, {CELL.format(k=3)}, {CELL.format(k=5)}, 'x|y'] AS cells FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) AS x)"
REGION = f"""{ROWS}, f AS (SELECT *, len(list_filter(cells, lambda c: trim(c) <> '')) AS filled FROM r), g AS (SELECT *, greatest(2, (max(filled) OVER (PARTITION BY file_id) + 1) // 2) AS need, row_number() OVER (PARTITION BY file_id ORDER BY row_idx) AS rn FROM f),
  i AS (SELECT *, rn - row_number() OVER (PARTITION BY file_id ORDER BY row_idx) AS i FROM g WHERE filled >= need), n AS (SELECT file_id, min(row_idx) AS first, max(row_idx) AS last, count(*) AS n FROM i GROUP BY file_id, i),
  region AS (SELECT file_id, first, last, n FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, first) AS b FROM n) AS a WHERE b = 1 AND n >= 2)"""
IMG = "img AS (SELECT doc_id, chunk_id AS image_id, page + chunk_idx % 2 AS page, (chunk_idx * 7 % 10 + 0.5) / 10 AS y, chunk_id AS path, left(content, 2) AS hash, chunk_idx AS pos FROM chunks WHERE chunk_idx % 3 = 0)"
ORACLE_SQL = {
    "markdown_blocks": """WITH li AS (SELECT l_orderkey, string_agg(r, chr(10) ORDER BY l_linenumber, r) AS lines FROM (SELECT l_orderkey, l_linenumber, concat('| ', l_partkey, ' | ', l_suppkey, ' |') AS r FROM lineitem) AS a GROUP BY l_orderkey),
      p AS (SELECT o_custkey % 100 AS doc_id, o_custkey, o_orderkey, o_orderstatus, o_orderpriority, lines, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) - 1 AS page FROM orders JOIN li ON l_orderkey = o_orderkey)
      SELECT doc_id, CAST(7 * page + b AS BIGINT) AS block, kind, concat('Customer ', o_custkey, ' > Order ', o_orderkey) AS header_path, CASE kind WHEN 'text' THEN concat('Status ', o_orderstatus) WHEN 'table' THEN lines ELSE concat('- ', o_orderpriority) END AS text
      FROM p, (VALUES (4, 'text'), (6, 'table'), (7, 'list')) AS v(b, kind)""",
    "cells_to_rows": """WITH c AS (SELECT sheet, "row", col, max(text) AS text FROM (SELECT l_orderkey AS sheet, CAST(l_linenumber AS INT) AS "row", CAST(l_linenumber % 3 + 1 AS INT) AS col, l_returnflag AS text FROM lineitem WHERE l_linenumber <= 7 UNION ALL SELECT l_orderkey, CAST(l_linenumber AS INT), 5, CASE WHEN l_linenumber <> 2 THEN l_linestatus ELSE '' END FROM lineitem WHERE l_linenumber <= 7) AS y GROUP BY ALL),
      u AS (SELECT sheet, min(col) AS a, max(col) AS b FROM c GROUP BY sheet), g AS (SELECT sheet, "row", k FROM (SELECT DISTINCT sheet, "row" FROM c) AS x JOIN u USING (sheet), range(1, 6) AS r(k) WHERE k BETWEEN a AND b)
      SELECT g.sheet, g."row", string_agg(coalesce(text, ''), ',' ORDER BY k) AS cells FROM g LEFT JOIN c ON c.sheet = g.sheet AND c."row" = g."row" AND c.col = g.k GROUP BY g.sheet, g."row" """,
    "table_region": f"WITH {REGION} SELECT * FROM region",
    "render_rows": f"""WITH {REGION}, l AS (SELECT r.file_id, row_idx, CASE WHEN row_idx BETWEEN first AND last THEN concat('| ', array_to_string(list_transform(cells, lambda c: trim(replace(c, '|', chr(92) || '|'))), ' | '), ' |', CASE WHEN row_idx = first THEN chr(10) || '| --- | --- | --- | --- |' ELSE '' END)
      ELSE array_to_string(list_filter(cells, lambda c: c <> ''), ' ') END AS t FROM r LEFT JOIN region g ON g.file_id = r.file_id) SELECT file_id, string_agg(t, chr(10) ORDER BY row_idx) AS markdown FROM l GROUP BY file_id""",
    "link_images": _T(f"""MORE {IMG}, b AS (SELECT doc_id, page, chunk_idx AS block, (run - w) / total AS top, run / total AS bottom FROM (SELECT *, sum(w) OVER (PARTITION BY doc_id, page ORDER BY chunk_idx) AS run, sum(w) OVER (PARTITION BY doc_id, page) AS total FROM (SELECT *, greatest(length(content), 20) AS w FROM chunks) AS a) AS c),
      p AS (SELECT image_id, doc_id, y, to_page, row_number() OVER (PARTITION BY image_id ORDER BY abs(i.page - to_page), to_page) AS rn FROM img i JOIN (SELECT DISTINCT doc_id, page AS to_page FROM b) AS q USING (doc_id)),
      x AS (SELECT image_id, block, y BETWEEN top AND bottom AS inside, round(CASE WHEN y BETWEEN top AND bottom THEN 0 ELSE least(abs(y - top), abs(y - bottom)) END, 9) AS gap FROM p JOIN b ON b.doc_id = p.doc_id AND b.page = p.to_page WHERE rn = 1)
      SELECT image_id, block FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY NOT inside, gap, block) AS rn FROM x) AS z WHERE rn = 1""", "chunks"),
    "first_image_by_hash": _T(f"MORE {IMG} SELECT image_id, first_value(path) OVER (PARTITION BY doc_id, hash ORDER BY page, pos) AS shared_path FROM img", "chunks"),
}
