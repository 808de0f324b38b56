"""Upserts as pure folds: state and arrivals in, new state out, the same in batch and in foreachBatch.

Every column has a policy. Rows are folded in order of arrival, the state before all arrivals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of maturity: facts move up only.
BUCKET_RANK = {"existing": 2, "radar": 1, "pending": 0, "rejected": -1}


def rank_of(c: Column, ranks: dict[str, int] = BUCKET_RANK, default: int = -2) -> Column:
    out = F.lit(default)
    for k, v in ranks.items():
        out = F.when(c == k, v).otherwise(out)
    return out


def replace(c: str) -> Column:
    """The last value that isn't null."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at")))


def keep(c: str) -> Column:
    """The first value that isn't null."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_at")))


def least(c: str) -> Column:
    return F.min(c)


def most(c: str) -> Column:
    return F.max(c)


def total(c: str) -> Column:
    return F.sum(c)


def union(c: str) -> Column:
    """Sorted distinct elements of all arrays."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))


def highest(ranks: dict[str, int] = BUCKET_RANK) -> Callable[[str], Column]:
    """The value of highest rank."""
    return lambda c: F.max_by(c, F.struct(rank_of(F.col(c), ranks), F.col(c)))


def best_by(by: str) -> Callable[[str], Column]:
    """The value of the row where another column is greatest; of equal ones, the first row."""
    return lambda c: F.min_by(c, F.struct((-F.coalesce(F.col(by).cast("double"), F.lit(-1.0))).alias("r"), F.col("_at")))


def fold(state: DataFrame, arrivals: DataFrame, key: list[str], policies: dict[str, Callable[[str], Column]], arrival: list[str], frozen: str | None = None) -> DataFrame:
    """The new state: a row for each key.

    arrival: columns that order rows; frozen: a boolean column, true on state rows that a person has decided, which no
    arrival changes.
    """
    stamp = F.struct(*[F.col(c) for c in arrival])
    old = state.withColumn("_at", F.struct(F.lit(0).alias("n"), stamp.alias("s")))
    new = arrivals.withColumn("_at", F.struct(F.lit(1).alias("n"), stamp.alias("s")))
    done = None
    if frozen:
        done = state.where(frozen)
        new = new.join(done.select(key), key, "left_anti").select(new.columns)
    out = old.unionByName(new, allowMissingColumns=True)
    out = out.where(~F.col(frozen)) if frozen else out
    folded = out.groupBy(*key).agg(*[p(c).alias(c) for c, p in policies.items()])
    return folded.unionByName(done.select(folded.columns)) if done is not None else folded


def insert_missing(state: DataFrame, arrivals: DataFrame, key: list[str]) -> DataFrame:
    """State and the arrivals of unknown keys."""
    return state.unionByName(arrivals.join(state.select(key), key, "left_anti").select(state.columns))


def transition(df: DataFrame, column: str, moves: dict[str, str], guard: Column) -> DataFrame:
    """Moves a status where the guard holds and the current status allows it."""
    out = F.col(column)
    for a, b in moves.items():
        out = F.when(guard & (F.col(column) == a), b).otherwise(out)
    return df.withColumn(column, out)


def transitions(before: DataFrame, after: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, before, after): the log of a fold, a row for each known key whose value moved."""
    j = before.select(*key, F.col(column).alias("before")).join(after.select(*key, F.col(column).alias("after")), key)
    return j.where(F.col("before") != F.col("after"))
