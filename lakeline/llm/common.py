"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at the same bytes.
SPACE = b" \t\n\r\x0b\x0c"
#: Bytes of text handled at once inside a task, so that numpy's temporaries stay small whatever the batch.
CHUNK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a notebook on one machine) a folder of this machine is made and the setting
    is filled in; on a cluster an absent setting is an error, since a local folder would lose data with an executor.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lakeline-")
    shared_dir.own = own
    return f"file://{own}"


def settle(df: DataFrame, *partition_by: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts the lineage and survives lost executors.

    With ``free`` the shuffle files behind it go as soon as it is written, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakeline/{uuid.uuid4().hex}"
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true" if free else before)
    try:
        df.write.partitionBy(*partition_by).parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Rows here hold whole texts, so the session's Arrow batches are bounded by bytes and not by rows alone."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not (now.isdigit() and 0 < int(now) <= CHUNK_BYTES):
        spark.conf.set(key, str(CHUNK_BYTES))


def release() -> None:
    """Give memory that a task has freed back to the system: its worker lives on, and so do workers of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        release()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column; nulls stay None."""
    return column.cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows holding about ``most`` bytes of text; one longer text makes a run of its own."""
    sizes = np.array([len(x) if x is not None else 0 for x in text_bytes(batch.column(text))], dtype=np.int64)
    group = np.cumsum(sizes) // most
    cuts = np.flatnonzero(np.diff(group)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        if b > a:
            yield batch.slice(a, b - a)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def ascii_lower(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


M64 = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply), the same on every machine."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(u, v)`` by alternating large-star and small-star rounds.

    Returns ``(node, component)`` for every node that has an edge; the component is its smallest node. Each round is
    two shuffles of the remaining edges and is settled in the shared folder; the number of rounds is logarithmic.
    Null ends and self-loops are dropped.
    """
    spark = edges.sparkSession
    now = settle(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = mark(now)
    if before[0] == 0:
        return spark.createDataFrame([], edges.select(F.col("u").alias("node"), F.col("v").alias("component")).schema)
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v")
        # small-star on u < v: every v links its smaller neighbours to the smallest of them
        large = settle(large.where("u <> v").distinct())
        low = settle(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(low, "v").select("m", F.when(F.col("u") == F.col("m"), F.col("v")).otherwise(F.col("u")).alias("w"))
        now = settle(small.where("m <> w").select(F.col("m").alias("u"), F.col("w").alias("v")).distinct())
        after = mark(now)
        if after == before:
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select("u", "u").distinct())
        before = after
    raise RuntimeError("components did not settle")
