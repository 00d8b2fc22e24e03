"""Structured Streaming jobs, each with the same result as its batch operator over the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def read_stream(spark: SparkSession, path: str, schema: StructType | str, most_files: int = 100, fmt: str = "parquet") -> DataFrame:
    """Files of a folder as a stream; ``most_files`` a trigger keeps a backlog from becoming one batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).format(fmt).load(path)


def timed(events: DataFrame, late: str, column: str = "ts") -> DataFrame:
    """Event time as a zoned timestamp with a watermark."""
    return events.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, late)


def activity_windows(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Events of each type by tumbling or sliding windows; rows later than ``late`` behind the newest are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed(events, late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def session_windows(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def rate_counts(events: DataFrame, permits: int, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests of each client and window, and how many of them exceed the permits."""
    c = timed(events, late).groupBy(F.window("ts", window).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return c.withColumn("rejected", F.greatest(F.col("n") - permits, F.lit(0)))


def dedupe_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return timed(events, late).dropDuplicatesWithinWatermark(keys)


def unanswered(questions: DataFrame, answers: DataFrame, within: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Questions ``(message_id, ts)`` without an answer ``(response_to, ats)`` within a time: a left outer stream join."""
    q, a = timed(questions, late), timed(answers, late, "ats")
    joined = q.join(a, F.expr(f"message_id = response_to AND ats >= ts AND ats <= ts + INTERVAL {within}"), "left_outer")
    return joined.where("response_to IS NULL").select("message_id", "ts")


def status_step(key, rows, state):
    """Follow a document's events: upload, start, finish, fail, delete. Impossible changes are passed over."""
    import pandas as pd

    now, chunks = state.get if state.exists else ("", False)
    for part in rows:
        for _, kind in sorted(zip(part["event_id"], part["kind"])):
            if kind == "upload" and now in ("", "Ready", "Failed", "Stale"):
                now = "Pending"
            elif kind == "start" and now == "Pending":
                now = "Processing"
            elif kind == "finish" and now == "Processing":
                now, chunks = "Ready", True
            elif kind == "fail" and now == "Processing":
                now = "Stale" if chunks else "Failed"
            elif kind == "delete" and now not in ("", "Processing"):
                now, chunks = "", False
    state.update((now, chunks))
    yield pd.DataFrame({"doc_id": [key[0]], "status": [now or "Deleted"]})


def document_status(events: DataFrame) -> DataFrame:
    """Status of each document after every batch of events ``(doc_id, event_id, kind)``."""
    return events.groupBy("doc_id").applyInPandasWithState(status_step, "doc_id long, status string", "now string, chunks boolean", "update", "NoTimeout")


def run_once(df: DataFrame, checkpoint: str, mode: str, name: str):
    """Process what is there and stop; the checkpoint folder lets the next call go on behind it."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def ingest(files: DataFrame, checkpoint: str, table_path: str, error_path: str):
    """Streamed files ``(path, content)`` become rows of lines; a file that can't be read is written with its error and
    stops nothing. A batch that is run again after a failure replaces its own rows (``batch`` is a partition)."""

    def write(batch: DataFrame, number: int) -> None:
        text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
        rows = batch.select("path", text.alias("text")).withColumn("batch", F.lit(number))
        good = rows.where("text IS NOT NULL").select("path", F.posexplode(F.split("text", "\n")).alias("line_no", "line"), "batch")
        good.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table_path)
        rows.where("text IS NULL").select("path", F.lit("not UTF-8").alias("error"), "batch").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(error_path)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
