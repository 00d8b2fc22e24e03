"""Registered queries of files, images and sequential merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeline.operators import chunking as ch
from lakeline.operators import files as fl
from lakeline.plans.chunking import TOK, tokens
from lakeline.plans.retrieval import COS
from lakeline.sources import tables as t


def pictured(s, d):
    """Chunks with two image paths each; a path recurs in other chunks."""
    return t.chunks(s, d).select("doc_id", "chunk_id", "chunk_idx", F.array(F.concat(F.lit("p"), F.col("chunk_idx") % 3), F.concat(F.lit("q"), F.length("content") % 5)).alias("paths"))


def hashes(s, d):
    names = ["p0", "p1", "p2", "q0", "q1", "q2", "q3"]
    return t.load(s, d, "region").select(F.explode(F.array(*map(F.lit, names))).alias("path")).distinct().withColumn("hash", F.when(F.col("path") != "p2", F.concat(F.lit("h"), F.substr("path", F.lit(2)))))


def delimited(s, d):
    li = t.load(s, d, "lineitem")
    row = F.concat_ws(";", "l_linenumber", "l_returnflag", F.concat(F.lit('"'), "l_linestatus", F.lit(';a"')))
    return li.groupBy(F.col("l_orderkey").alias("file_id")).agg(F.array_join(F.array_sort(F.collect_list(row)), "\r\n").alias("text"))


def semantic_windows(s, d):
    dist = ch.adjacent_distance(t.vector_chunks(s, d))
    x = t.vector_chunks(s, d).join(dist.select("chunk_id", "distance"), "chunk_id").join(ch.breakpoints(dist), "doc_id", "left")
    before = F.lag("distance").over(Window.partitionBy("doc_id").orderBy("chunk_idx"))
    return x.select("doc_id", F.col("chunk_idx").alias("idx"), (F.col("chunk_id") % 80 + 20).alias("tokens"), before.alias("distance"), "threshold")


QUERIES = {
    "delimited_to_rows": lambda s, d: fl.delimited_to_rows(delimited(s, d)).select("file_id", "row_idx", F.array_join("cells", "~").alias("cells")),
    "delimited_tables": lambda s, d: fl.delimited_tables(delimited(s, d)),
    "attach_captions": lambda s, d: fl.attach_captions(pictured(s, d), hashes(s, d).withColumn("caption", F.col("hash"))).select("chunk_id", F.array_join("captions", "|").alias("captions")),
    "persist_images": lambda s, d: fl.persist_images(pictured(s, d), hashes(s, d))[1],
    "append_exchange": lambda s, d: fl.append_exchange(t.messages(s, d), t.load(s, d, "benchmark").select((F.col("item_id") % 7).alias("session_id"), (F.col("item_id") * 2 + 10_000_000).alias("user_message_id"), F.col("text").alias("question"), F.lit("ok").alias("answer"), F.lit(t.NOW).cast("long").alias("at"))).drop("created"),
    "split_items": lambda s, d: fl.split_items(tokens(s, d).select("doc_id", "chunk_idx", "tokens"), "doc_id", "chunk_idx", "tokens", 150, 10).select("doc_id", "piece", "first", "n", "cost"),
    "merge_same_header": lambda s, d: fl.merge_same_header(tokens(s, d).withColumn("header", F.left("content", F.lit(1))), 120),
    "semantic_breaks": lambda s, d: fl.semantic_breaks(semantic_windows(s, d), most=200),
}
_T = t.with_tables
PIC = "pic AS (SELECT doc_id, chunk_id, chunk_idx, [concat('p', chunk_idx % 3), concat('q', length(content) % 5)] AS paths FROM chunks), h AS (SELECT path, CASE WHEN path <> 'p2' THEN concat('h', substr(path, 2)) END AS hash FROM (SELECT unnest(['p0', 'p1', 'p2', 'q0', 'q1', 'q2', 'q3']) AS path) AS a)"
ORACLE_SQL = {
    "delimited_to_rows": """WITH r AS (SELECT l_orderkey, concat(l_linenumber, ';', l_returnflag, ';"', l_linestatus, ';a"') AS line, concat(l_linenumber, '~', l_returnflag, '~', l_linestatus, ';a') AS cells FROM lineitem)
      SELECT l_orderkey AS file_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY line) - 1 AS INT) AS row_idx, cells FROM r""",
    "delimited_tables": """WITH r AS (SELECT l_orderkey AS file_id, concat(l_linenumber, ' | ', l_returnflag, ' | ', l_linestatus, ';a') AS cells, row_number() OVER (PARTITION BY l_orderkey ORDER BY concat(l_linenumber, ';', l_returnflag, ';"', l_linestatus, ';a"')) AS rn, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
      SELECT file_id, string_agg(CASE WHEN n = 1 THEN replace(cells, ' | ', ' ') ELSE concat('| ', cells, ' |', CASE WHEN rn = 1 THEN chr(10) || '| --- | --- | --- |' ELSE '' END) END, chr(10) ORDER BY rn) AS markdown FROM r GROUP BY file_id""",
    "attach_captions": _T(f"MORE {PIC}, x AS (SELECT chunk_id, k, paths[k] AS path FROM pic, range(1, 3) AS r(k)) SELECT chunk_id, string_agg(coalesce(hash, ''), '|' ORDER BY k) AS captions FROM x LEFT JOIN h USING (path) GROUP BY chunk_id", "chunks"),
    "persist_images": _T(f"""MORE {PIC}, x AS (SELECT doc_id, chunk_id, chunk_idx, k, paths[k] AS path FROM pic, range(1, 3) AS r(k)), y AS (SELECT x.*, coalesce(hash, concat('#', x.path)) AS g FROM x LEFT JOIN h ON h.path = x.path)
      SELECT chunk_id, first_value(path) OVER (PARTITION BY doc_id, g ORDER BY chunk_idx, k) AS path, CAST(k AS INT) AS position FROM y""", "chunks"),
    "append_exchange": _T("""SELECT message_id, session_id, role, content, response_to FROM messages UNION ALL SELECT item_id * 2 + 10000000, item_id % 7, 0, text, NULL FROM benchmark UNION ALL SELECT item_id * 2 + 10000001, item_id % 7, 1, 'ok', item_id * 2 + 10000000 FROM benchmark""", "messages"),
    "split_items": "WITH RECURSIVE " + _T(f"""MORE {TOK}, o AS (SELECT doc_id, chunk_idx, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS rn FROM tok),
      w AS (SELECT doc_id, chunk_idx, rn, tokens, 0 AS piece, CAST(tokens AS BIGINT) AS used FROM o WHERE rn = 1 UNION ALL
        SELECT o.doc_id, o.chunk_idx, o.rn, o.tokens, CASE WHEN w.used > 0 AND w.used + o.tokens > 140 THEN w.piece + 1 ELSE w.piece END, CASE WHEN w.used > 0 AND w.used + o.tokens > 140 THEN o.tokens ELSE w.used + o.tokens END FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
      SELECT doc_id, piece, min(chunk_idx) AS first, count(*) AS n, CAST(sum(tokens) + 10 AS BIGINT) AS cost FROM w GROUP BY doc_id, piece""", "chunks").removeprefix("WITH "),
    "merge_same_header": "WITH RECURSIVE " + _T(f"""MORE {TOK}, o AS (SELECT doc_id, chunk_idx, left(content, 1) AS h, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS rn FROM tok),
      w AS (SELECT doc_id, chunk_idx, rn, h, 0 AS no, CAST(tokens AS BIGINT) AS used FROM o WHERE rn = 1 UNION ALL
        SELECT o.doc_id, o.chunk_idx, o.rn, o.h, CASE WHEN o.h = w.h AND w.used + o.tokens <= 120 THEN w.no ELSE w.no + 1 END, CASE WHEN o.h = w.h AND w.used + o.tokens <= 120 THEN w.used + o.tokens ELSE o.tokens END FROM w JOIN o ON o.doc_id = w.doc_id AND o.rn = w.rn + 1)
      SELECT doc_id, chunk_idx, no AS merged FROM w""", "chunks").removeprefix("WITH "),
    "semantic_breaks": "WITH RECURSIVE " + _T(f"""MORE dist AS (SELECT chunk_id, doc_id, chunk_idx, CASE WHEN nxt IS NOT NULL THEN 1 - {COS.format('embedding', 'nxt')} END AS distance FROM (SELECT *, lead(embedding) OVER (PARTITION BY doc_id ORDER BY chunk_idx) AS nxt FROM vector_chunks) AS a),
      thr AS (SELECT doc_id, percentile_disc(0.85) WITHIN GROUP (ORDER BY distance) AS threshold FROM dist WHERE distance IS NOT NULL GROUP BY doc_id),
      o AS (SELECT doc_id, chunk_idx AS idx, chunk_id % 80 + 20 AS tokens, coalesce(lag(distance) OVER (PARTITION BY doc_id ORDER BY chunk_idx) > threshold + 1e-12, false) AS far FROM dist JOIN thr USING (doc_id)),
      w AS (SELECT doc_id, idx, 0 AS piece, CAST(tokens AS BIGINT) AS used FROM o WHERE idx = 0 UNION ALL
        SELECT o.doc_id, o.idx, CASE WHEN w.used > 0 AND (w.used + o.tokens > 200 OR o.far) THEN w.piece + 1 ELSE w.piece END, CASE WHEN w.used > 0 AND (w.used + o.tokens > 200 OR o.far) THEN o.tokens ELSE w.used + o.tokens END FROM w JOIN o ON o.doc_id = w.doc_id AND o.idx = w.idx + 1)
      SELECT doc_id, idx, piece FROM w""", "vector_chunks").removeprefix("WITH "),
}
