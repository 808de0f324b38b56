"""Cutting lineage in the shared folder of spark.checkpoint.dir, and the bound for Arrow batches."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Fixed value: bytes of an Arrow batch of whole texts.
BATCH_BYTES = 8 << 20


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint; a temporary folder only where no folder is set and all runs in one process (tests)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or "file://" + tempfile.mkdtemp(prefix="factloom-"))
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's bound for Arrow batches: whole texts are long, and a batch is held several times on its way."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(name, str(BATCH_BYTES))
