"""Ordered passes over chunks and rows of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeline.functions.vector import cosine


def link_chunks(chunks: DataFrame, vector: str = "embedding", carry: list[str] | None = None) -> DataFrame:
    """Drop chunks without a vector, number the others from 0 and link each to its neighbours; with the columns named by
    ``carry``."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx")
    return chunks.where(F.col(vector).isNotNull()).select("chunk_id", "doc_id", (F.row_number().over(w) - 1).alias("chunk_idx"), F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"), *(carry or []))


def section_runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Adds ``section``: consecutive rows with an equal value share a number; a value seen again later starts anew."""
    w = Window.partitionBy(key).orderBy(order)
    change = (~F.col(value).eqNullSafe(F.lag(value).over(w))) & (F.row_number().over(w) > 1)
    return df.withColumn("_c", change.cast("int")).withColumn("section", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def longest_run(df: DataFrame, key: str, order: str, good: Column) -> DataFrame:
    """``key, first, last, n``: the longest run of two or more consecutive rows that are ``good``; the earliest of equals."""
    w = Window.partitionBy(key).orderBy(order)
    runs = df.withColumn("_g", good).withColumn("_r", F.row_number().over(w)).where("_g")
    island = runs.withColumn("_i", F.col("_r") - F.row_number().over(w)).groupBy(key, "_i").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))
    best = island.withColumn("_b", F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first")))
    return best.where("_b = 1 AND n >= 2").select(key, "first", "last", "n")


def dedup_chunks(chunks: DataFrame, least: int = 50) -> DataFrame:
    """Of chunks of a document with equal text the first stays; texts below ``least`` signs all stay."""
    short = F.length("content") < least
    key = F.when(short, F.concat(F.lit("#"), F.col("chunk_idx"))).otherwise(F.sha2("content", 256))
    first = F.row_number().over(Window.partitionBy("doc_id", key).orderBy("chunk_idx"))
    return chunks.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def page_layout(blocks: DataFrame, weight: str = "weight") -> DataFrame:
    """Adds ``top`` and ``bottom``: the share of the page's weight before and up to the block."""
    p = Window.partitionBy("doc_id", "page")
    run = F.sum(weight).over(p.orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("_t", F.sum(weight).over(p)).withColumn("bottom", run / F.col("_t")).withColumn("top", (run - F.col(weight)) / F.col("_t")).drop("_t")


def adjacent_distance(chunks: DataFrame) -> DataFrame:
    """``chunk_id, distance``: one less the cosine of a chunk's vector and the next one's; null for the last chunk."""
    nxt = F.lead("embedding").over(Window.partitionBy("doc_id").orderBy("chunk_idx"))
    return chunks.withColumn("_n", nxt).select("chunk_id", "doc_id", F.when(F.col("_n").isNotNull(), 1 - cosine(F.col("embedding"), F.col("_n"))).alias("distance"))


def breakpoints(distances: DataFrame, p: float = 0.85) -> DataFrame:
    """The nearest-rank percentile of the distances of each document."""
    return distances.where("distance IS NOT NULL").groupBy("doc_id").agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY distance)").alias("threshold"))


def adaptive_budget(blocks: DataFrame, tokens: str = "tokens", default: int = 400, factor: float = 2.5, low: int = 400, high: int = 1024) -> DataFrame:
    """``doc_id, budget``: the upper median of paragraph lengths above five tokens times ``factor``, within bounds;
    ``default`` for documents with fewer than three such paragraphs."""
    per = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(F.col(tokens) > 5, F.col(tokens)))).alias("t"))
    mid = F.get("t", F.floor(F.size("t") / 2).cast("int"))
    return per.select("doc_id", F.when(F.size("t") < 3, default).otherwise(F.least(F.greatest(F.floor(mid * factor).cast("int"), F.lit(low)), F.lit(high))).alias("budget"))


def header_skeleton(chunks: DataFrame, most: int = 40) -> DataFrame:
    """``doc_id, skeleton``: distinct headers ignoring case in first-seen order as a dashed list."""
    h = chunks.select("doc_id", "chunk_idx", F.trim("header").alias("h")).where("h <> ''")
    first = h.groupBy("doc_id", F.lower("h").alias("k")).agg(F.min(F.struct("chunk_idx", "h")).alias("f"))
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("f"))).where(F.col("rn") <= most)
    return ranked.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: F.concat(F.lit("- "), x.h)), "\n").alias("skeleton"))


def even_sample(chunks: DataFrame, cut: int = 300) -> DataFrame:
    """``doc_id, sample``: 6 to 24 evenly spaced chunks (all of a short document), each cut, joined by newlines."""
    per = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_idx", F.left("content", F.lit(cut)).alias("c")))).alias("a"))
    count = F.size("a")
    n = F.least(F.greatest(F.floor(count / 40), F.lit(6)), F.lit(24)).cast("int")
    picked = F.when(count <= n, F.col("a")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("a", F.floor(i * count / n).cast("int"))))
    return per.select("doc_id", F.array_join(F.transform(picked, lambda x: x.c), "\n").alias("sample"))


def carry_heading(pieces: DataFrame, heading: Column) -> DataFrame:
    """Adds ``heading``: that of the piece, else the last one before it in the document."""
    w = Window.partitionBy("doc_id").orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    return pieces.withColumn("heading", F.last(heading, ignorenulls=True).over(w))


def build_history(messages: DataFrame, budget: int, raw: int = 6) -> DataFrame:
    """Adds ``kept``: whether a message is among the last ``raw`` of its session and within ``budget`` counted from the
    newest; the newest always is. ``messages`` needs session_id, turn, cost."""
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    back, used = F.row_number().over(w), F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return messages.withColumn("kept", (back == 1) | ((back <= raw) & (used <= budget)))


def history_plan(messages: DataFrame, budget: int, summary_cost: int = 0, raw: int = 6, most: int = 20) -> DataFrame:
    """``session_id, message_id, part`` of the last ``most`` messages of each session: ``raw`` for those ``build_history``
    keeps when the summary's tokens are taken off the budget, else ``summary``: what a summary has to tell."""
    w = Window.partitionBy("session_id").orderBy(F.col("turn").desc())
    recent = messages.withColumn("_back", F.row_number().over(w)).where(F.col("_back") <= most).drop("_back")
    kept = build_history(recent, budget - summary_cost, raw)
    return kept.select("session_id", "message_id", F.when(F.col("kept"), "raw").otherwise("summary").alias("part"))


def block_weight(kind: Column, text: Column) -> Column:
    """The share of a page's height that a block of a kind is taken to need."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(kind == "table", F.greatest(n, F.lit(200))).when(kind == "code", F.greatest(n, F.lit(100))).when(kind == "figure", 100).when(kind == "rule", 10).otherwise(F.greatest(n, F.lit(20)))


def sniff_delimiter(lines: DataFrame, most: int = 30) -> DataFrame:
    """``file_id, delimiter``: the candidate whose count in the first lines is the most regular; a comma if none is found.

    ``lines`` needs file_id, line_no, line. The score is ten times the share of lines with the most frequent count, plus
    that count; equal scores go to the first of ``; , tab |``.
    """
    first = lines.where(F.trim("line") != "").withColumn("_r", F.row_number().over(Window.partitionBy("file_id").orderBy("line_no"))).where(F.col("_r") <= most)
    total = first.groupBy("file_id").agg(F.count("*").alias("total"))
    bare = F.regexp_replace("line", r'"[^"]*"', "")
    cand = F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate((";", ",", "\t", "|")))))
    hits = first.select("file_id", bare.alias("b"), cand.alias("d")).select("file_id", "d", (F.length("b") - F.length(F.replace("b", F.col("d.c"), F.lit("")))).alias("n")).where("n > 0")
    mode = hits.groupBy("file_id", "d", "n").agg(F.count("*").alias("f")).groupBy("file_id", "d").agg(F.max(F.struct("f", "n")).alias("m"))
    scored = mode.join(total, "file_id").withColumn("score", 10.0 * F.col("m.f") / F.col("total") + F.col("m.n"))
    best = scored.withColumn("_b", F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("score").desc(), "d.o"))).where("_b = 1")
    return total.join(best.select("file_id", F.col("d.c").alias("delimiter")), "file_id", "left").select("file_id", F.coalesce("delimiter", F.lit(",")).alias("delimiter"))
