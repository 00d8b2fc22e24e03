"""The logical tables of the engine, derived from the given Parquet tables.

Every adapter exists twice: as a DataFrame and, for checks, as a SQL text for DuckDB. Times are seconds since 1970.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START = 1704067200  # 2024-01-01 00:00:00 UTC
NOW = 1706745600  # 2024-02-01 00:00:00 UTC
DAY = 86400


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_pages(pages: DataFrame) -> DataFrame:
    """``doc_id, page_no, place, markdown`` of ``(doc_id, page_index, markdown)``: the number that readers see counts from
    1, ``place`` is the page's rank within its document, whatever gaps the indexes have."""
    at = Window.partitionBy("doc_id").orderBy("page_index", "markdown")
    return pages.select("doc_id", (F.col("page_index") + 1).alias("page_no"), F.row_number().over(at).alias("place"), "markdown")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        (F.col("doc_id") % 7).alias("user_id"),
        F.concat("source", F.lit("-"), F.col("doc_id"), F.lit(".pdf")).alias("file_name"),
        F.concat(F.lit("application/"), F.element_at(F.array(*map(F.lit, ("pdf", "msword", "zip", "csv"))), (F.col("doc_id") % 4 + 1).cast("int"))).alias("content_type"),
        (F.col("doc_id") % 5).cast("int").alias("status"),
        F.upper(F.sha2("text", 256)).alias("content_hash"),
        (F.lit(START) + F.col("doc_id") * 60).alias("created"),
        "n_chars",
        "lang",
        "source",
        "text",
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk for each line of a document."""
    d = load(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(F.split("text", "\n"))).select(
        F.concat_ws("-", "doc_id", "pos").alias("chunk_id"), "doc_id", F.col("pos").alias("chunk_idx"), F.col("source").alias("header"), (1 + F.floor(F.col("pos") / 5)).cast("int").alias("page"), F.col("col").alias("content")
    )


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunks; the label is the document, neighbours follow from the order of ids."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"),
        F.col("label").cast("long").alias("doc_id"),
        (F.row_number().over(w) - 1).alias("chunk_idx"),
        F.lag("vec_id").over(w).alias("prev_id"),
        F.lead("vec_id").over(w).alias("next_id"),
        "embedding",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every twentieth vector asks; its text is the benchmark item of that number."""
    e = load(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("vec"), F.floor(F.col("vec_id") / 20).alias("item_id"))
    b = load(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"))
    return e.join(b, "item_id", "left").select("q_id", "vec", "question")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"),
        F.col("conv_id").alias("session_id"),
        F.col("turn"),
        F.element_at(F.create_map(F.lit("user"), F.lit(0), F.lit("assistant"), F.lit(1), F.lit("system"), F.lit(2)), F.col("role")).alias("role"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.col("conv_id") * 1000 + F.col("turn") - 1).alias("response_to"),
        (F.lit(START) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("created"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "conversations")
    first = m.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "user", F.struct("turn", "text"))).alias("f"), F.max("turn").alias("last"))
    pinned, archived = F.col("conv_id") % 5 == 0, F.col("conv_id") % 7 == 0
    made = F.lit(START) + F.col("conv_id") * 3600
    return first.select(
        F.col("conv_id").alias("session_id"),
        (F.col("conv_id") % 7).alias("user_id"),
        F.left(F.coalesce("f.text", F.lit("")), F.lit(60)).alias("title"),
        archived.alias("is_archived"),
        pinned.alias("is_pinned"),
        F.when(pinned, made + 7200).alias("pinned_at"),
        made.alias("created"),
        F.when(F.col("last") > 0, made + F.col("last") * 60).alias("updated"),
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rated questions of five users; a rating of 1 is a like, -1 a dislike."""
    labels = F.array(*map(F.lit, ("wrong", "incomplete", "outdated", "irrelevant", "format")))
    return load(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("feedback_id"),
        (F.col("vec_id") % 5).alias("user_id"),
        F.col("vec_id").alias("message_id"),
        F.col("embedding").alias("question_vec"),
        F.when(F.col("vec_id") % 3 == 0, 1).otherwise(-1).alias("rating"),
        F.array(F.element_at(labels, (F.col("label") % 5 + 1).cast("int")), F.element_at(labels, (F.col("vec_id") % 5 + 1).cast("int"))).alias("categories"),
        (F.lit(START) - F.col("vec_id") * DAY).alias("created"),
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as cached answers; the question is the text of the document of that number."""
    e = load(spark, sf_dir, "embeddings")
    d = load(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("question"))
    hits = (F.col("vec_id") % 11).cast("int")
    return e.join(d, "vec_id", "left").select(
        F.col("vec_id").alias("cache_id"),
        F.coalesce("question", F.concat(F.lit("q"), F.col("vec_id"))).alias("question"),
        F.col("embedding").alias("question_vec"),
        F.concat(F.lit("answer "), F.col("vec_id")).alias("answer"),
        hits.alias("hit_count"),
        F.when(hits > 0, F.lit(NOW) - (F.col("vec_id") % 50) * DAY).alias("last_hit"),
        F.when(F.col("vec_id") % 13 != 0, F.concat(F.col("label"), F.lit(","), F.col("label") + 1)).alias("source_doc_ids"),
        (F.lit(NOW) - (F.col("vec_id") % 60) * DAY).alias("created"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("full_name"),
        F.concat(F.lower("c_name"), F.lit("@x.test")).alias("email"),
        F.concat(F.lit("EMP"), F.col("c_custkey")).alias("personnel_code"),
        F.when(F.col("c_custkey") % 50 == 0, "Admin").otherwise("User").alias("role"),
    )


#: The same tables for DuckDB, as common table expressions in order of dependence.
SQL = {
    "docs": f"""SELECT doc_id, doc_id % 7 AS user_id, concat(source, '-', doc_id, '.pdf') AS file_name, concat('application/', ['pdf', 'msword', 'zip', 'csv'][doc_id % 4 + 1]) AS content_type,
      CAST(doc_id % 5 AS INT) AS status, upper(sha256(text)) AS content_hash, {START} + doc_id * 60 AS created, n_chars, lang, source, text FROM documents""",
    "chunks": """SELECT concat(doc_id, '-', pos - 1) AS chunk_id, doc_id, CAST(pos - 1 AS INT) AS chunk_idx, source AS header, CAST(1 + (pos - 1) // 5 AS INT) AS page, lines[pos] AS content
      FROM (SELECT doc_id, source, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents) AS t""",
    "vector_chunks": """SELECT vec_id AS chunk_id, CAST(label AS BIGINT) AS doc_id, CAST(row_number() OVER w - 1 AS INT) AS chunk_idx, lag(vec_id) OVER w AS prev_id, lead(vec_id) OVER w AS next_id, embedding
      FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)""",
    "questions": """SELECT vec_id AS q_id, embedding AS vec, text AS question FROM embeddings LEFT JOIN benchmark ON item_id = vec_id // 20 WHERE vec_id % 20 = 0""",
    "messages": f"""SELECT conv_id * 1000 + turn AS message_id, conv_id AS session_id, turn, CAST(CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 WHEN 'system' THEN 2 END AS INT) AS role, text AS content,
      CASE WHEN role = 'assistant' THEN conv_id * 1000 + turn - 1 END AS response_to, {START} + conv_id * 3600 + turn * 60 AS created FROM conversations""",
    "sessions": f"""SELECT conv_id AS session_id, conv_id % 7 AS user_id, left(coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), ''), 60) AS title, conv_id % 7 = 0 AS is_archived, conv_id % 5 = 0 AS is_pinned,
      CASE WHEN conv_id % 5 = 0 THEN {START} + conv_id * 3600 + 7200 END AS pinned_at, {START} + conv_id * 3600 AS created, CASE WHEN max(turn) > 0 THEN {START} + conv_id * 3600 + max(turn) * 60 END AS updated
      FROM conversations GROUP BY conv_id""",
    "feedback": f"""SELECT vec_id AS feedback_id, vec_id % 5 AS user_id, vec_id AS message_id, embedding AS question_vec, CASE WHEN vec_id % 3 = 0 THEN 1 ELSE -1 END AS rating,
      [['wrong', 'incomplete', 'outdated', 'irrelevant', 'format'][label % 5 + 1], ['wrong', 'incomplete', 'outdated', 'irrelevant', 'format'][vec_id % 5 + 1]] AS categories, {START} - vec_id * {DAY} AS created FROM embeddings""",
    "cache": f"""SELECT vec_id AS cache_id, coalesce(text, concat('q', vec_id)) AS question, embedding AS question_vec, concat('answer ', vec_id) AS answer, CAST(vec_id % 11 AS INT) AS hit_count,
      CASE WHEN vec_id % 11 > 0 THEN {NOW} - (vec_id % 50) * {DAY} END AS last_hit, CASE WHEN vec_id % 13 <> 0 THEN concat(label, ',', label + 1) END AS source_doc_ids, {NOW} - (vec_id % 60) * {DAY} AS created
      FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
    "users": """SELECT c_custkey AS user_id, c_name AS full_name, concat(lower(c_name), '@x.test') AS email, concat('EMP', c_custkey) AS personnel_code, CASE WHEN c_custkey % 50 = 0 THEN 'Admin' ELSE 'User' END AS role FROM customer""",
}


def with_tables(sql: str, *names: str) -> str:
    """``sql`` behind the definitions of the logical tables it names."""
    own = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {own}{', ' if sql.lstrip().upper().startswith('MORE ') else ' '}{sql.lstrip().removeprefix('MORE ')}"
