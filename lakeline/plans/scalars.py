"""Registered queries of functions on single values; texts of the tables carry the markers that they look for."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeline.functions import compose as c
from lakeline.functions import text as x
from lakeline.operators import answers as an
from lakeline.operators import files as fl
from lakeline.operators import links as ln
from lakeline.plans.answers import ORACLE_SQL as ANSWERS
from lakeline.plans.answers import imports
from lakeline.sources import tables as t

#: First bytes by the number of a document, and the formats they tell.
HEADS = [("255044462D312E", "Pdf"), ("504B0304", "Ooxml"), ("D0CF11E0A1B11AE1", "Ole"), ("7B5C72746631", "Rtf"), ("EFBBBF20203C21646F63747970652068746D6C", "MarkupText"), ("4D494D452D56657273696F6E3A", "MarkupText"), ("00", "Unknown")]
PICTURES = [("FFD8FFE0", "jpeg"), ("89504E470D0A", "png"), ("474946383961", "gif"), ("524946460000000057454250", "webp"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("00", "png")]


def pick(values, k):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (k % len(values) + 1).cast("int"))


def begun(s, d, heads):
    docs = t.load(s, d, "documents")
    return docs.select("doc_id", F.concat(F.unhex(pick([h for h, _ in heads], F.col("doc_id"))), F.col("text").cast("binary")).alias("bytes"))


def doc_formats(s, d):
    b = begun(s, d, HEADS).withColumn("kind", pick(["Pdf", "Docx", "Doc", "Csv"], F.col("doc_id")))
    fmt = x.doc_format(F.col("bytes"))
    return b.select("doc_id", fmt.alias("format"), x.format_matches(fmt, F.col("kind"), F.octet_length("bytes")).alias("fits"))


def contexts(s, d):
    k = F.col("chunk_idx")
    marked = F.when(k % 3 == 0, F.concat(F.lit(f"{x.CONTEXT_MARK} about "), "doc_id", F.lit("\n\n"), "content")).when(k % 3 == 1, F.concat(F.lit(f"{x.CONTEXT_MARK} "), "content")).otherwise(F.col("content"))
    ctx, body = x.split_context(marked)
    return t.chunks(s, d).select("chunk_id", ctx.alias("ctx"), body.alias("body"))


def img_markers(s, d):
    k, n = F.col("chunk_idx"), F.col("doc_id")
    m = F.concat(F.left("content", F.lit(20)), F.lit(" [IMG:"), k % 3, F.lit("] [IMG:2 — x"), n % 4, F.lit("] end"))
    p = F.concat(F.left("content", F.lit(20)), F.lit(" [IMG_PATH:a"), k % 2, F.lit("] [IMG_PATH: b ] [IMG_PATH:a"), n % 2, F.lit("]"))
    text, paths = x.renumber_img_paths(p)
    return t.chunks(s, d).select("chunk_id", x.strip_img_markers(m).alias("bare"), text.alias("numbered"), F.array_join(paths, ",").alias("paths"), x.shift_img_numbers(m, k).alias("moved"), x.inline_captions(m, F.array(F.lit("one"), F.lit(" "))).alias("told"))


def options(s, d):
    name = F.concat(F.initcap(F.col("source")), F.lit("File_No-"), "doc_id", F.lit(".Pdf"))
    told = F.concat(F.lit("- first option "), "doc_id", F.lit(' | 2) "second '), "source", F.lit('" | short | ends with:'), F.when(F.col("doc_id") % 2 == 0, " | * a third one").otherwise(""))
    return t.load(s, d, "documents").select("doc_id", F.array_join(x.parse_options(told), "|").alias("options"), x.topic_name(name).alias("topic"))


def header_paths(s, d):
    k = F.col("chunk_idx")
    return t.chunks(s, d).select("chunk_id", x.header_path(F.array(F.col("header"), F.concat(F.lit("1. "), F.upper("header")), F.concat(F.lit("part "), k % 3), F.concat(F.lit("Part "), (k + 1) % 3), F.col("header"))).alias("path"))


def sizes_and_dates(s, d):
    n = F.col("doc_id") * F.col("doc_id") * 977 % 5_000_000
    page = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" "), "doc_id", F.lit(" "))).when(F.col("doc_id") % 3 == 1, F.lit("12345")).otherwise(F.lit("p 1"))
    return t.docs(s, d).select("doc_id", x.is_page_number(page).alias("page_number"), x.format_size(n).alias("size"), x.format_date(F.col("created")).alias("date"))


def judged(s, d):
    n = F.col("doc_id")
    flag = F.when(n % 4 == 0, '```json\n{"standalone": true}\n```').when(n % 4 == 1, '{"standalone": false}').when(n % 4 == 2, '{"standalone": "true"}').otherwise("no")
    ctx = F.concat(F.lit('[{"context": "c'), n, F.lit('"}, "{'), n % 7, F.lit('} stays", " "]'))
    return t.load(s, d, "documents").select("doc_id", c.parse_flag(flag, "standalone").alias("flag"), F.array_join(c.parse_contexts(ctx, n % 5), "|").alias("contexts"))


def block_texts(s, d):
    n = F.col("chunk_idx")
    kind = pick(["table", "list", "quote", "code", "math", "rule", "text"], n)
    items, rows = F.array(F.lit("i"), F.col("header")), F.array(F.array(F.lit("1"), F.concat(F.lit("r"), n)))
    shown = c.render_block(kind, F.lit(None).cast("string"), F.left("content", F.lit(9)), items, n % 2 == 0, n % 4, F.when(n % 3 == 0, F.array(F.lit("p"))).otherwise(F.array().cast("array<string>")))
    return t.chunks(s, d).select("chunk_id", c.clean_text(kind, F.left("content", F.lit(9)), items, F.array(F.lit("col1"), F.lit("H")), rows).alias("clean"), F.when(kind != "table", shown).alias("shown"))


def decoded(s, d):
    bom = F.when(F.col("doc_id") % 4 == 0, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(F.col("doc_id") % 4 == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"))).when(F.col("doc_id") % 4 == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE"))).otherwise(F.encode("text", "UTF-8"))
    return t.load(s, d, "documents").select("doc_id", fl.decode_text(bom).alias("text"))


def page_images(s, d):
    md = F.concat("content", F.lit(" [IMG_REF:"), F.col("chunk_idx") % 4, F.lit("] [[EMBED_IMG_"), F.col("chunk_idx") % 3, F.lit("]]"))
    return t.chunks(s, d).select("chunk_id", c.resolve_page_images(md, F.array(F.lit("f0"), F.lit("f1")), F.array(F.lit("e0"))).alias("markdown"))


def pictures(s, d):
    c = t.chunks(s, d)
    return c.select("doc_id", "page", F.concat(F.lit("h"), F.col("chunk_idx") % 7).alias("hash"), (F.col("chunk_idx") % 5 * 30).alias("size"))


def cells(s, d):
    li = t.load(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    return li.select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").cast("int").alias("row"), F.lit(1).alias("col"), F.col("f").alias("text"))


def on_cells(s, d):
    o = t.load(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("sheet"), F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(p).alias("path")) for r, p in ((1, "p1"), (1, "p0"), (99, "q"))))).alias("x"), (F.col("o_custkey") % 100).alias("size")).select("sheet", "x.row", F.lit(1).alias("col"), "x.path", "size")


QUERIES = {
    "mime_types": lambda s, d: t.docs(s, d).select("doc_id", x.mime_to_type(F.when(F.col("doc_id") % 8 < 4, F.col("content_type")).otherwise(pick(["text/csv", "application/vnd.wordprocessingml.x", "application/spreadsheetml", "text/csv; x"], F.col("doc_id")))).alias("type")),
    "doc_formats": doc_formats,
    "image_formats": lambda s, d: begun(s, d, PICTURES).select("doc_id", x.image_format(F.col("bytes")).alias("format")),
    "split_context": contexts,
    "img_markers": img_markers,
    "options_topics": options,
    "header_paths": header_paths,
    "sizes_dates": sizes_and_dates,
    "flags_contexts": judged,
    "block_texts": block_texts,
    "decode_text": decoded,
    "page_images": page_images,
    "import_summary": lambda s, d: ln.import_summary(an.bulk_import_users(t.users(s, d).where("user_id % 2 = 0"), imports(s, d))),
    "new_pictures": lambda s, d: fl.hash_except_same_page(pictures(s, d), pictures(s, d).where("hash IN ('h1', 'h2') AND size > 60")).select("doc_id", "page", "hash", "size"),
    "anchor_images": lambda s, d: fl.anchor_images(cells(s, d), on_cells(s, d)),
    "latest_feedback": lambda s, d: t.feedback(s, d).select((F.col("feedback_id") % 50).alias("user_id"), (F.col("feedback_id") % 30).alias("message_id")).dropDuplicates(["user_id", "message_id"]),
}
_T = t.with_tables
IMPORTED = ANSWERS["bulk_import_users"]


def case(heads, name):
    return f"['{"', '".join(v for _, v in heads)}'][{name} % {len(heads)} + 1]"


ORACLE_SQL = {
    "mime_types": _T("SELECT doc_id, CASE WHEN doc_id % 8 < 4 THEN ['Pdf', 'Doc', NULL, NULL][doc_id % 4 + 1] ELSE ['Csv', 'Docx', 'Xlsx', NULL][doc_id % 4 + 1] END AS type FROM docs", "docs"),
    "doc_formats": f"""WITH f AS (SELECT doc_id, {case(HEADS, 'doc_id')} AS format, ['Pdf', 'Docx', 'Doc', 'Csv'][doc_id % 4 + 1] AS kind, octet_length(encode(text)) + [7, 4, 8, 6, 19, 13, 1][doc_id % 7 + 1] AS size FROM documents)
      SELECT doc_id, format, size < 5 OR CASE kind WHEN 'Pdf' THEN format = 'Pdf' WHEN 'Docx' THEN format = 'Ooxml' WHEN 'Doc' THEN format IN ('Ole', 'Rtf', 'MarkupText') ELSE true END AS fits FROM f""",
    "image_formats": f"SELECT doc_id, {case(PICTURES, 'doc_id')} AS format FROM documents",
    "split_context": _T(f"""MORE m AS (SELECT chunk_id, CASE chunk_idx % 3 WHEN 0 THEN concat('{x.CONTEXT_MARK} about ', doc_id, chr(10), chr(10), content) WHEN 1 THEN concat('{x.CONTEXT_MARK} ', content) ELSE content END AS s FROM chunks), p AS (SELECT *, CASE WHEN starts_with(s, '{x.CONTEXT_MARK}') THEN instr(s, chr(10) || chr(10)) ELSE 0 END AS cut FROM m)
      SELECT chunk_id, CASE WHEN cut > 0 THEN left(s, cut + 1) ELSE '' END AS ctx, CASE WHEN cut > 0 THEN substr(s, cut + 2) ELSE s END AS body FROM p""", "chunks"),
    "img_markers": _T("""MORE m AS (SELECT chunk_id, doc_id % 4 AS n, chunk_idx % 3 AS a, chunk_idx AS k, left(content, 20) AS t, concat('a', chunk_idx % 2) AS p, concat('a', doc_id % 2) AS q FROM chunks)
      SELECT chunk_id, trim(concat(t, '   end')) AS bare, concat(t, ' [IMG:1] [IMG:2] [IMG:', CASE WHEN p = q THEN 1 ELSE 3 END, ']') AS numbered, concat(p, ',b', CASE WHEN p = q THEN '' ELSE ',' || q END) AS paths,
        concat(t, ' [IMG:', a + k, '] [IMG:', 2 + k, ' — x', n, '] end') AS moved, concat(t, ' [IMG:', a, CASE WHEN a = 1 THEN ' — one' ELSE '' END, '] [IMG:2 — x', n, '] end') AS told FROM m""", "chunks"),
    "options_topics": "SELECT doc_id, concat('first option ', doc_id, '|second ', source, CASE WHEN doc_id % 2 = 0 THEN '|a third one' ELSE '' END) AS options, lower(concat(source, 'file no ', doc_id)) AS topic FROM documents",
    "header_paths": _T("MORE p AS (SELECT chunk_id, header, concat('part ', chunk_idx % 3) AS a FROM chunks) SELECT chunk_id, concat(header, ' > ', a, ' > ', header) AS path FROM p", "chunks"),
    "sizes_dates": _T("""MORE s AS (SELECT *, doc_id * doc_id * 977 % 5000000 AS n FROM docs) SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id < 10000 ELSE false END AS page_number,
      CASE WHEN n < 1024 THEN concat(n, ' B') WHEN n < 1048576 THEN concat(CAST(round(n / 1024, 1) AS DOUBLE), ' KB') ELSE concat(CAST(round(n / 1048576, 1) AS DOUBLE), ' MB') END AS size,
      concat(day(to_timestamp(created) AT TIME ZONE 'UTC'), ' ', ['Ocak', 'Şubat', 'Mart', 'Nisan', 'Mayıs', 'Haziran', 'Temmuz', 'Ağustos', 'Eylül', 'Ekim', 'Kasım', 'Aralık'][month(to_timestamp(created) AT TIME ZONE 'UTC')], ' ', year(to_timestamp(created) AT TIME ZONE 'UTC')) AS date FROM s""", "docs"),
    "flags_contexts": "SELECT doc_id, doc_id % 4 = 0 AS flag, array_to_string(([concat('c', doc_id), concat('{', doc_id % 7, '} stays'), '', ''])[1:doc_id % 5], '|') AS contexts FROM documents",
    "block_texts": _T("""MORE b AS (SELECT chunk_id, chunk_idx AS n, header, left(content, 9) AS t, CASE WHEN chunk_idx % 3 = 0 THEN '[IMG_PATH:p]' || chr(10) ELSE '' END AS m, ['table', 'list', 'quote', 'code', 'math', 'rule', 'text'][chunk_idx % 7 + 1] AS kind FROM chunks),
      c AS (SELECT *, CASE WHEN m <> '' THEN CASE WHEN t = '' THEN m ELSE t || chr(10) || m END ELSE t END AS plain FROM b)
      SELECT chunk_id, CASE kind WHEN 'table' THEN concat('H 1 r', n) WHEN 'list' THEN concat('i ', header) WHEN 'rule' THEN '' ELSE t END AS clean, CASE kind
        WHEN 'list' THEN rtrim(concat(CASE WHEN n % 2 = 0 THEN concat(n % 4 + 1, '. ') ELSE '- ' END, 'i', chr(10), CASE WHEN n % 2 = 0 THEN concat(n % 4 + 2, '. ') ELSE '- ' END, header, chr(10), m), ' ' || chr(10)) WHEN 'quote' THEN rtrim(concat('> ', t, chr(10), m), ' ' || chr(10))
        WHEN 'code' THEN concat('```', chr(10), t, chr(10), '```', CASE WHEN m <> '' THEN chr(10) || m ELSE '' END) WHEN 'math' THEN concat('$$', chr(10), t, chr(10), '$$', CASE WHEN m <> '' THEN chr(10) || m ELSE '' END) WHEN 'rule' THEN concat('---', CASE WHEN m <> '' THEN chr(10) || m ELSE '' END) WHEN 'text' THEN plain END AS shown FROM c""", "chunks"),
    "decode_text": "SELECT doc_id, text FROM documents",
    "page_images": _T("""MORE m AS (SELECT chunk_id, content, chunk_idx % 4 AS r, chunk_idx % 3 AS e FROM chunks), s AS (SELECT *, concat(content, CASE WHEN r < 2 THEN concat(' [IMG_PATH:f', r, '] ') ELSE concat(' [IMG_REF:', r, '] ') END, CASE WHEN e = 0 THEN '[IMG_PATH:e0]' ELSE '' END) AS s FROM m)
      SELECT chunk_id, concat(s, CASE WHEN r <> 0 THEN chr(10) || '[IMG_PATH:f0]' ELSE '' END, CASE WHEN r <> 1 THEN chr(10) || '[IMG_PATH:f1]' ELSE '' END) AS markdown FROM s""", "chunks"),
    "import_summary": f"SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'ok') AS success, count(*) FILTER (WHERE outcome <> 'ok') AS skipped FROM ({IMPORTED}) AS i",
    "new_pictures": _T("""MORE p AS (SELECT doc_id, page, concat('h', chunk_idx % 7) AS hash, chunk_idx % 5 * 30 AS size FROM chunks) SELECT * FROM p WHERE size >= 64 AND NOT EXISTS (SELECT 1 FROM p q WHERE q.hash IN ('h1', 'h2') AND q.size > 60 AND q.doc_id = p.doc_id AND q.page = p.page AND q.hash = p.hash)""", "chunks"),
    "anchor_images": """WITH c AS (SELECT l_orderkey AS sheet, CAST(l_linenumber AS INT) AS "row", min(l_returnflag) AS text FROM lineitem GROUP BY ALL), g AS (SELECT o_orderkey AS sheet FROM orders WHERE o_custkey % 100 >= 64), u AS (SELECT sheet, max("row") AS last, bool_or("row" = 1) AS has FROM c GROUP BY sheet)
      SELECT c.sheet, "row", 1 AS col, concat(text, CASE WHEN g.sheet IS NOT NULL AND "row" = 1 THEN ' [IMG_PATH:p0] [IMG_PATH:p1]' ELSE '' END) AS text FROM c LEFT JOIN g USING (sheet)
      UNION ALL SELECT u.sheet, last + 1, 1, CASE WHEN has THEN '[IMG_PATH:q]' ELSE '[IMG_PATH:p0] [IMG_PATH:p1] [IMG_PATH:q]' END FROM u JOIN g USING (sheet)""",
    "latest_feedback": "SELECT DISTINCT vec_id % 50 AS user_id, vec_id % 30 AS message_id FROM embeddings",
}
