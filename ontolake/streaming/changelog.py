"""The change log as a stream: the last change of each axiom, kept as streaming state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import LOG
from ..staging import shared_folder


def log_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_a_batch: int = 16) -> DataFrame:
    """Change files under a folder as a stream of (seq, ts, op, axiom_key)."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    op = F.when(F.col("event_id") % 3 == 0, "remove").otherwise("add")
    return rows.select(F.col("event_id").alias("seq"), "ts", op.alias("op"), F.expr(LOG).alias("axiom_key"))


def last_changes(log: DataFrame) -> DataFrame:
    """One row of state for each axiom: its last change so far, whatever order the log comes in."""
    return log.groupBy("axiom_key").agg(F.max_by("op", F.struct("ts", "seq")).alias("op"))


def replay(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """axiom_key of the state after all that is there now. Each batch publishes its changed rows with the batch's number;
    a restarted query writes the same batch to the same place."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def publish(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/state/batch={number:08d}")

    q = last_changes(log_stream(spark, folder, pattern)).writeStream.outputMode("update").foreachBatch(publish).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("axiom_key string, op string, batch int").parquet(f"{root}/state")
    return out.groupBy("axiom_key").agg(F.max_by("op", "batch").alias("op")).where("op = 'add'").select("axiom_key")
