"""Structured Streaming around the folds, and windowed event counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Parts of a state; a micro-batch rewrites those that its keys fall into.
BUCKETS = 64


def upsert_stream(arrivals: DataFrame, folder: str, checkpoint: str, fold: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame, key: list[str], buckets: int = BUCKETS):
    """Folds each micro-batch into a state kept in buckets of its key.

    Batch n reads the newest files of the buckets that it touches, folds, and writes them as data/version=n/state_bucket=k; the cost
    follows the touched buckets, not the state. index/batch=n says which version of each bucket counts after batch n, and is
    written last: a batch that is repeated starts from the index before it and repeats its result. Versions that neither this
    index nor the one before names are deleted.
    """
    spark = arrivals.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")

    def step(batch: DataFrame, n: int) -> None:
        index = _index(spark, folder, n - 1)
        touched = [r[0] for r in batch.select(bucket).distinct().collect()]  # a number for each bucket at most
        if touched:
            before = _files(spark, folder, {b: index[b] for b in touched if b in index}, empty)
            fold(before, batch).withColumn("state_bucket", bucket).repartition("state_bucket").write.mode("overwrite").partitionBy("state_bucket").parquet(f"{folder}/data/version={n}")
        now = index | dict.fromkeys(touched, n)
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/index/batch={n}")
        for b, v in (_index(spark, folder, n - 2) if n > 1 else {}).items():
            if v not in (index.get(b), now.get(b)):
                _delete(spark, f"{folder}/data/version={v}/state_bucket={b}")

    return arrivals.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _index(spark: SparkSession, folder: str, n: int) -> dict[int, int]:
    return {r.bucket: r.version for r in spark.read.schema("bucket int, version long").parquet(f"{folder}/index/batch={n}").collect()} if n >= 0 else {}


def _files(spark: SparkSession, folder: str, versions: dict[int, int], empty: DataFrame) -> DataFrame:
    paths = [f"{folder}/data/version={v}/state_bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def read_state(spark: SparkSession, folder: str, batch: int, empty: DataFrame) -> DataFrame:
    """The state after a batch (the newest or the one before it)."""
    return _files(spark, folder, _index(spark, folder, batch), empty)


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts by event type and event-time window; rows later than the watermark don't change closed windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def labelled_late(events: DataFrame, days: int = 60) -> DataFrame:
    """Late rows are kept and marked, never dropped."""
    return events.withColumn("late", F.date_diff("created", "published") > days)


def once(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
