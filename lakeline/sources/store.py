"""A store of tables by document that readers never see half written.

Every table is a folder with one sub-folder for each run. A run writes its tables and the list of its documents first and
then, as one file of one row, its commit. Readers take each document from its latest committed run; what a failed run
has left behind is invisible, and is written anew or taken up when the run is started again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS, MANIFEST = "commits", "manifest"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file is there, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def path_of(store: str, table: str, run: int) -> str:
    return f"{store}/{table}/run={run}"


def stage(spark: SparkSession, store: str, table: str, run: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a run: read if the run has finished it before, else made and written as a whole."""
    path = path_of(store, table, run)
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    return spark.read.parquet(path)


def committed(spark: SparkSession, store: str, run: int) -> bool:
    return exists(spark, f"{path_of(store, COMMITS, run)}/_SUCCESS")


def commit(documents: DataFrame, store: str, run: int) -> None:
    """Make a run visible for ``documents(doc_id, …)``, also those that have no rows in it any more. Runs are numbered in
    order; a run that was committed before stays as it is."""
    spark = documents.sparkSession
    if committed(spark, store, run):
        return
    stage(spark, store, MANIFEST, run, lambda: documents.select("doc_id").distinct())
    spark.range(1).select(F.lit(run).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(path_of(store, COMMITS, run))


def latest(spark: SparkSession, store: str) -> DataFrame | None:
    """``doc_id, run``: the latest committed run of each document; None where nothing was committed."""
    if not exists(spark, f"{store}/{COMMITS}"):
        return None
    runs = [r.number for r in spark.read.parquet(f"{store}/{COMMITS}/run=*").distinct().collect()]  # one number a run
    if not runs:
        return None
    listed = spark.read.option("basePath", f"{store}/{MANIFEST}").parquet(*(path_of(store, MANIFEST, r) for r in runs))
    return listed.groupBy("doc_id").agg(F.max(F.col("run").cast("long")).alias("run"))


def read_table(spark: SparkSession, store: str, table: str) -> DataFrame:
    """The rows of each document's latest committed run; an error where no run was committed."""
    now = latest(spark, store)
    if now is None:
        raise ValueError(f"nothing was committed to {store}")
    runs = [r.run for r in now.select("run").distinct().collect()]
    rows = spark.read.option("basePath", f"{store}/{table}").parquet(*(path_of(store, table, r) for r in runs))
    return rows.withColumn("run", F.col("run").cast("long")).join(now, ["doc_id", "run"]).drop("run")


def latest_rows(spark: SparkSession, store: str, table: str) -> DataFrame:
    """The rows of each document's last appearance in a table of any committed run, replaced documents or not."""
    runs = [r.number for r in spark.read.parquet(f"{store}/{COMMITS}/run=*").distinct().collect()]
    rows = spark.read.option("basePath", f"{store}/{table}").parquet(*(path_of(store, table, r) for r in runs)).withColumn("run", F.col("run").cast("long"))
    return rows.join(rows.groupBy("doc_id").agg(F.max("run").alias("run")), ["doc_id", "run"]).drop("run")


def write_chunks(chunks: DataFrame, store: str, run: int, documents: DataFrame | None = None) -> None:
    """Replace the chunks of all documents in ``chunks``, all or nothing. ``documents(doc_id)`` names more documents that
    the run stands for, whose chunks go. A null doc_id is a document like others, but never found again by readers."""
    spark = chunks.sparkSession
    kept = stage(spark, store, "chunks", run, lambda: chunks)
    ids = kept.select("doc_id") if documents is None else kept.select("doc_id").union(documents.select("doc_id"))
    commit(ids, store, run)


def vacuum(spark: SparkSession, store: str, tables: list[str]) -> list[int]:
    """Delete the folders of committed runs that no document is read from any more; returns their numbers. To be run
    while no reader has planned a query on them."""
    now = latest(spark, store)
    if now is None:
        return []
    used = {r.run for r in now.select("run").distinct().collect()}
    old = [r.number for r in spark.read.parquet(f"{store}/{COMMITS}/run=*").collect() if r.number not in used]
    for run in old:
        for table in [COMMITS, MANIFEST, *tables]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path_of(store, table, run))
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return old
