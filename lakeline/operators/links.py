"""Joins between documents, chunks, images, messages and cache entries, and small aggregates over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.functions.compose import blank

from lakeline.functions.text import json_string_array


def ordered_paths(links: DataFrame, key: str) -> DataFrame:
    """``key, paths`` of ``(key, position, path)`` in order of position."""
    return links.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "path"))), lambda x: x.path).alias("paths"))


def enrich_candidates(candidates: DataFrame, chunks: DataFrame, docs: DataFrame, links: DataFrame) -> DataFrame:
    """Ranked candidates with their chunk's text, the file name and the image paths; candidates without a chunk go."""
    x = candidates.join(chunks.select("chunk_id", "doc_id", "content"), "chunk_id").join(docs.select("doc_id", "file_name"), "doc_id")
    return x.join(ordered_paths(links, "chunk_id"), "chunk_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def document_chunks_with_images(chunks: DataFrame, links: DataFrame) -> DataFrame:
    return chunks.join(ordered_paths(links, "chunk_id"), "chunk_id", "left").withColumn("paths", F.coalesce("paths", F.array().cast("array<string>")))


def cache_entries_of_documents(cache: DataFrame, docs: DataFrame, untracked: bool = False) -> DataFrame:
    """Entries that name one of ``docs`` as source, and those without sources if ``untracked``."""
    named = cache.select("cache_id", F.explode(F.split("source_doc_ids", ",")).alias("doc")).join(docs.select(F.col("doc_id").cast("string").alias("doc")), "doc", "left_semi").select("cache_id").distinct()
    hit = cache.join(named, "cache_id", "left_semi")
    return hit.unionByName(cache.where("source_doc_ids IS NULL")) if untracked else hit


def messages_with_dead_images(messages: DataFrame, gone: DataFrame) -> DataFrame:
    """Messages ``(message_id, images_json)`` that show one of the deleted paths, ignoring case."""
    x = messages.select("message_id", F.explode(json_string_array(F.col("images_json"))).alias("path"))
    dead = x.join(gone.select(F.lower("path").alias("p")), F.lower(x.path) == F.col("p"), "left_semi").select("message_id").distinct()
    return messages.join(dead, "message_id", "left_semi")


def source_ids(results: DataFrame) -> DataFrame:
    """``q_id, sources``: the distinct document ids of a question's results in order, joined by commas."""
    return results.groupBy("q_id").agg(F.array_join(F.array_sort(F.collect_set("doc_id")), ",").alias("sources"))


def docs_in_result(results: DataFrame) -> DataFrame:
    return results.groupBy("q_id", "doc_id").agg(F.count("*").alias("chunks"))


def image_count(chunks: DataFrame) -> DataFrame:
    """``doc_id, images``: lengths of the JSON image lists of a document summed; text that is no list counts nothing."""
    return chunks.groupBy("doc_id").agg(F.sum(F.size(json_string_array(F.col("images_json")))).alias("images"))


def chunk_stats(docs: DataFrame, parsed: DataFrame, embedded: DataFrame) -> DataFrame:
    """``doc_id, chunks, skipped``: how many chunks have a vector, and how many parsed ones have none."""
    p, e = parsed.groupBy("doc_id").agg(F.count("*").alias("p")), embedded.groupBy("doc_id").agg(F.count("*").alias("e"))
    zero = F.lit(0).cast("long")
    return docs.select("doc_id").join(p, "doc_id", "left").join(e, "doc_id", "left").select("doc_id", F.coalesce("e", zero).alias("chunks"), (F.coalesce("p", zero) - F.coalesce("e", zero)).alias("skipped"))


def processing_notes(stats: DataFrame, notes: DataFrame) -> DataFrame:
    """``chunk_stats`` with ``notes``: those of ``(doc_id, pos, note)`` that are not blank, in order, divided by `` | ``;
    null where there are none."""
    told = notes.where(~blank(F.col("note"))).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.trim("note").alias("n")))), lambda x: x.n), " | ").alias("notes"))
    return stats.join(told, "doc_id", "left")


def neighbor_ids(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """``q_id, chunk_id`` of the neighbours of a question's matches that are no matches themselves."""
    m = matches.select("q_id", "chunk_id").join(chunks.select("chunk_id", "prev_id", "next_id"), "chunk_id")
    n = m.select("q_id", F.explode(F.array("prev_id", "next_id")).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct()
    return n.join(matches.select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_anti")


def caption_work(images: DataFrame) -> DataFrame:
    """``path`` of the images to describe: one for each hash, and every image without a hash."""
    hashed = images.where("hash IS NOT NULL").groupBy("hash").agg(F.min("path").alias("path")).select("path")
    return hashed.unionByName(images.where("hash IS NULL").select("path"))


def import_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "ok").alias("success"), F.count_if(F.col("outcome") != "ok").alias("skipped"))


def suggested_questions(cache: DataFrame, messages: DataFrame, n: int = 5) -> DataFrame:
    """The most-hit cached questions; popular user questions where the cache is empty."""
    from lakeline.operators.listing import popular_questions

    if cache.isEmpty():
        return popular_questions(messages, n).select("question")
    return cache.orderBy(F.col("hit_count").desc(), "cache_id").limit(n).select("question")
