"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; on one machine a folder of its own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared_dir.own = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="lakeline-")
    return f"file://{shared_dir.own}"


def settle(df: DataFrame) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/lakeline/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
