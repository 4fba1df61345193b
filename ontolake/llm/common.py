"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or, where that is unset and the session has
    one machine (tests), a new temporary folder that is then set for the session. A cluster without one is an error: what
    an executor wrote to its own disk, others could not read."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), f"ontolake-{uuid.uuid4().hex}")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_STAGED: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables that `staged` wrote. Only when what was made of them is written elsewhere."""
    while _STAGED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: df written as Parquet in the shared folder, and read back. It outlives lost executors."""
    path = shared_path(df.sparkSession, name)
    _STAGED.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare_driver(spark: SparkSession, share: float) -> None:
    """Has the driver's JVM collect all garbage if its heap has grown beyond a share of its limit. Plans are garbage soon, and a
    row of large ones makes the heap grow towards its limit, however little is alive in it; only a full collection makes it
    small again, and lets Spark drop shuffles and broadcasts that no plan refers to. Nothing that is in use goes."""
    runtime = spark._jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > share * runtime.maxMemory():
        spark._jvm.java.lang.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions as the session has them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def per_worker(name: str, spec: str, make):
    """make(spec), once in each Python worker and not again for every task; another spec of the name takes its place."""
    kept = sys.modules.setdefault("ontolake_worker", types.ModuleType("ontolake_worker")).__dict__
    if kept.get(name, ("",))[0] != spec:
        kept[name] = spec, make(spec)
    return kept[name][1]


def code_points(raw: bytes, places) -> dict[int, int]:
    """Code-point offset of each byte offset in UTF-8 text."""
    out, seen, chars = {}, 0, 0
    for x in sorted(set(places)):
        chars += len(raw[seen:x].decode("utf-8", "surrogatepass"))
        out[x] = chars
        seen = x
    return out
