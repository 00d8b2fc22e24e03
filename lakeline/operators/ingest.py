"""Pages to linked, embedded chunks: the whole chain, and its staged form that can be started again after any failure."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeline.functions.compose import chunk_text, embed_text
from lakeline.functions.text import renumber_img_paths, strip_img_markers
from lakeline.operators import chunking, files, markdown, sections
from lakeline.operators.answers import embed
from lakeline.sources import store as st
from lakeline.sources.shared import settle


def parsed_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of ``pages(doc_id, page_index, markdown)`` with tables taken apart and split tables joined."""
    b = markdown.blocks(pages, by_page=True)
    headers, rows = markdown.parse_table(F.col("text"))
    table = F.col("kind") == "table"
    return markdown.join_split_tables(b.withColumns({"headers": F.when(table, headers), "rows": F.when(table, rows)}))


def cut_chunks(blocks: DataFrame, mode: str = "semantic", small: int = 400) -> DataFrame:
    """``doc_id, chunk_idx, header, page, kind, content`` of parsed blocks: cut by section within each document's own
    budget, small neighbours under one header merged, repeated chunks left out."""
    units = sections.block_units(blocks)
    lengths = units.groupBy("doc_id", "block").agg(F.sum("tokens").alias("tokens"))
    budget = chunking.adaptive_budget(lengths)
    units = units.join(budget, "doc_id")
    cut = settle(sections.section_chunks(units, "budget", mode).withColumnRenamed("chunk", "chunk_idx"))
    merged = files.merge_same_header(cut.select("doc_id", "chunk_idx", "header", "tokens"), small)
    part = F.array_sort(F.collect_list(F.struct("chunk_idx", "header", "page", "kind", "content")))
    one = cut.join(merged, ["doc_id", "chunk_idx"]).groupBy("doc_id", "merged").agg(part.alias("p"))
    out = one.select("doc_id", F.col("merged").alias("chunk_idx"), F.col("p")[0]["header"].alias("header"), F.col("p")[0]["page"].alias("page"), F.col("p")[0]["kind"].alias("kind"), F.array_join(F.transform("p", lambda x: x.content), "\n\n").alias("content"))
    return chunking.dedup_chunks(out)


def linked_chunks(chunks: DataFrame, model: Callable[..., DataFrame] = embed) -> DataFrame:
    """``doc_id, chunk_id, chunk_idx, prev_id, next_id, header, page, content, paths, embedding``: image paths become
    numbers, the header stands in front, the clean text is embedded, chunks without a vector go and the others are
    numbered from 0 and linked. ``model(table, column)`` adds ``embedding`` to a table of texts."""

    def told(x: DataFrame) -> DataFrame:
        numbered, paths = renumber_img_paths(F.col("content"))
        x = x.withColumns({"md": numbered, "paths": paths})
        content, clean = chunk_text(F.col("header"), F.col("md"), strip_img_markers(F.col("md")))
        return x.withColumns({"shown": content, "clean": clean})

    x = told(chunks.select("doc_id", F.concat_ws("-", "doc_id", "chunk_idx").alias("chunk_id"), "chunk_idx", "header", "page", "content"))
    text = embed_text(F.lit(""), F.col("clean"), F.col("shown"), F.array().cast("array<string>"))
    x = model(x.withColumn("to_embed", text).drop("md", "paths", "shown", "clean"), "to_embed").drop("to_embed")
    linked = told(chunking.link_chunks(x, carry=["header", "page", "content", "embedding"])).withColumn("content", F.col("shown"))  # shuffled without its other forms
    return linked.select("doc_id", "chunk_id", "chunk_idx", "prev_id", "next_id", "header", "page", "content", "clean", "paths", "embedding")


def process_documents(pages: DataFrame, mode: str = "semantic", model: Callable[..., DataFrame] = embed) -> DataFrame:
    """The chunks of all documents of ``pages(doc_id, page_index, markdown)``.

    Null or blank pages give nothing, and a document of such pages no chunk; pages of equal index are taken in the order
    of their lines; other columns are not read.
    """
    return linked_chunks(settle(cut_chunks(parsed_blocks(pages), mode)), model)


def ingest_documents(pages: DataFrame, store: str, run: int, hashes: DataFrame | None = None, mode: str = "semantic", model: Callable[..., DataFrame] = embed) -> DataFrame:
    """``process_documents`` in stages kept in ``store``, committed at the end for all documents at once.

    Each stage is a table of the run; a run that is started again goes on behind its last finished stage, and changes
    nothing once it was committed. Tables: ``blocks``, ``pieces``, ``chunks``, ``images`` and ``image_links`` (the
    documents' pictures, first by path and then by ``hashes(path, hash)``), ``documents`` (doc_id, status, n_chunks):
    Ready with chunks; without, Stale if an earlier run has some, which stay, and Failed otherwise. Returns the run's
    ``documents``; ``store.latest_rows`` gives those of all runs.
    """
    spark = pages.sparkSession
    if st.committed(spark, store, run):
        return spark.read.parquet(st.path_of(store, "documents", run))
    blocks = st.stage(spark, store, "blocks", run, lambda: parsed_blocks(pages))
    pieces = st.stage(spark, store, "pieces", run, lambda: cut_chunks(blocks, mode))
    chunks = st.stage(spark, store, "chunks", run, lambda: linked_chunks(pieces, model))
    known = hashes if hashes is not None else spark.createDataFrame([], "path string, hash string")
    images, links = files.persist_images(chunks.select("doc_id", "chunk_id", "chunk_idx", "paths"), known)
    st.stage(spark, store, "images", run, lambda: images)
    st.stage(spark, store, "image_links", run, lambda: links.join(chunks.select("chunk_id", "doc_id"), "chunk_id"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    before = st.latest(spark, store)
    had = (before if before is not None else spark.createDataFrame([], pages.select("doc_id").schema)).select("doc_id", F.lit(True).alias("had"))
    status = F.when(F.col("n_chunks") > 0, "Ready").when(F.col("had"), "Stale").otherwise("Failed")
    state = pages.select("doc_id").distinct().join(counts, "doc_id", "left").join(had, "doc_id", "left").select("doc_id", status.alias("status"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    documents = st.stage(spark, store, "documents", run, lambda: state)
    st.commit(documents.where("status = 'Ready'"), store, run)
    return documents
