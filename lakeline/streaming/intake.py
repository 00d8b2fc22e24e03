"""A folder of documents taken in as a stream, a bounded number at a time, with a status for each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeline.operators.files import decode_text
from lakeline.operators.ingest import ingest_documents
from lakeline.sources import store as st
from lakeline.streaming.jobs import FILE_SCHEMA, read_stream

BEGUN, ENDED = 0, 1


def file_document(path):
    """The document of a file: its name up to the first dot; what follows may tell versions apart."""
    return F.element_at(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1)


def file_pages(files: DataFrame) -> DataFrame:
    """``doc_id, page_index, markdown`` of files ``(path, modificationTime, content)``: form feeds divide pages. Of files
    of one document the newest counts (by path where equally old); a file with a zero byte is no text and gives a null
    page."""
    newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("modificationTime"), F.desc("path")))
    text = decode_text(F.col("content"))
    one = files.withColumn("doc_id", file_document(F.col("path"))).withColumn("_n", newest).where("_n = 1")
    one = one.select("doc_id", F.when(~F.coalesce(F.contains(text, F.lit("\0")), F.lit(True)), text).alias("text"))
    return one.select("doc_id", F.posexplode_outer(F.split("text", "\f"))).select("doc_id", F.coalesce("pos", F.lit(0)).alias("page_index"), F.col("col").alias("markdown"))


def mark(rows: DataFrame, store: str, batch: int, phase: int) -> None:
    """Write the statuses of a batch; a batch that is run again writes its own anew."""
    rows.select("doc_id", "status").write.mode("overwrite").parquet(f"{store}/status/batch={batch}/phase={phase}")


def stream_ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, most_files: int = 100):
    """Take in the files of ``folder``, at most ``most_files`` at a time, until none is left; returns the query.

    Each batch is a run of ``ingest_documents``: its documents are Processing until the run is committed, then Ready,
    Failed, or Stale where an earlier version stays. If the job stops in between, the next call gets the same batch from
    the checkpoint, goes on behind the last finished stage and moves the statuses on, so nothing stays Processing. A
    file that can't be read stops nothing: its document is Failed or Stale.
    """

    def take(batch: DataFrame, number: int) -> None:
        pages = st.stage(spark, store, "pages", number, lambda: file_pages(batch))
        mark(pages.select("doc_id", F.lit("Processing").alias("status")).distinct(), store, number, BEGUN)
        mark(ingest_documents(pages, store, number), store, number, ENDED)

    files = read_stream(spark, folder, FILE_SCHEMA, most_files, "binaryFile")
    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def document_states(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """``doc_id, status`` of every document with a file in ``folder``: its last status, Pending if none was admitted."""
    there = spark.read.format("binaryFile").load(folder).select(file_document(F.col("path")).alias("doc_id")).distinct()
    if not st.exists(spark, f"{store}/status"):
        return there.withColumn("status", F.lit("Pending"))
    log = spark.read.schema("doc_id string, status string, batch long, phase int").parquet(f"{store}/status")
    last = log.groupBy("doc_id").agg(F.max_by("status", F.struct("batch", "phase")).alias("status"))
    return there.join(last, "doc_id", "left").withColumn("status", F.coalesce("status", F.lit("Pending")))
