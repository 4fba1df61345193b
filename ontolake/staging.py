"""Lineage cuts for loops: tables in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset and the session has one machine a temporary folder of it, which then
    becomes it. A cluster without one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"ontolake-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored_rows(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """stored, and the number of rows, which the write itself counts."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read back: later steps don't depend on the executors that made it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
