"""Ranking and neighbour operators over column roles. An explicit order makes every tie definite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.sources.scratch import checkpointed


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The place (from 1) of every row in a total order, without a task that sees all rows.

    Rows are dealt by ranges of the order and sorted there; a place is the row's number in its partition plus the rows of the
    partitions before. The driver sees one number for each partition.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt).withColumn("_part", F.shiftrightunsigned("_at", 33))
    at, before = 0, []
    for part, n in sorted(tuple(r) for r in dealt.groupBy("_part").count().collect()):
        before.append((part, at))
        at += n
    starts = df.sparkSession.createDataFrame(before, "_part long, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_at", "_before")


def _cols(c):
    return c if isinstance(c, list) else [c]


def best_of_group(df: DataFrame, key, order: list[Column]) -> DataFrame:
    """The first row of each key in order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*_cols(key)).orderBy(*order))).where("_rn = 1").drop("_rn")


def beyond_first(df: DataFrame, key, order: list[Column]) -> DataFrame:
    """The rows that best_of_group leaves out."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*_cols(key)).orderBy(*order))).where("_rn > 1").drop("_rn")


def top_n(df: DataFrame, key, order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*_cols(key)).orderBy(*order))).where(F.col("rank") <= n)


def round_robin(df: DataFrame, lane: str, order: list[Column]) -> DataFrame:
    """Rows with their turn: first of each lane, second of each lane, and so on; sort by turn and lane."""
    return df.withColumn("turn", F.row_number().over(W.partitionBy(lane).orderBy(*order)))


def rolling_baseline(df: DataFrame, key: str, order: str, value: str, back: int = 20, least: int = 3, drop: float = 0.3) -> DataFrame:
    """baseline: median of up to so many values before; anomaly: the value is under drop times a baseline of enough points."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(-back, -1)
    past = F.array_sort(F.collect_list(value).over(w))  # a median takes no frame; the frame bounds the array
    n = F.size("_past")
    middle = (F.get("_past", ((n - 1) / 2).cast("int")) + F.get("_past", (n / 2).cast("int"))) / 2
    out = df.withColumn("_past", past).withColumn("baseline", F.when(n > 0, middle)).drop("_past")
    out = out.withColumn("history", F.count(value).over(w))
    return out.withColumn("anomaly", (F.col("history") >= least) & (F.col("baseline") >= least) & (F.col(value) < F.col("baseline") * drop))


def covering_selection(df: DataFrame, group: str, family: str, score: str, ident: str, quota: int, most: int) -> DataFrame:
    """Ranked passes: one of each (group, family), then up to quota of each group, then by score, most rows in all."""
    best = F.row_number().over(W.partitionBy(group, family).orderBy(F.desc(score), ident))
    one = df.withColumn("_in_family", best)
    of_group = F.row_number().over(W.partitionBy(group).orderBy(F.when(F.col("_in_family") == 1, 0).otherwise(1), F.desc(score), ident))
    passed = one.withColumn("_in_group", of_group)
    which = F.when(F.col("_in_family") == 1, 1).when(F.col("_in_group") <= quota, 2).otherwise(3)
    return passed.withColumn("pass", which).drop("_in_family", "_in_group").orderBy("pass", F.desc(score), ident).limit(most)
