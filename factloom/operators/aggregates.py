"""Aggregate operators over column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row of conditional counts from one pass; 0 where nothing is counted."""
    return df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, counts): a map from each value to its count."""
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "_n")))).alias("counts"))


def top_share(df: DataFrame, key: str, part: float = 0.1) -> DataFrame:
    """One row: the share of rows that the most frequent tenth of the keys (one key at least) holds."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    keys = n.agg(F.count(F.lit(1)).alias("_k"), F.sum("_n").alias("_all"))
    # the counts of equal size are ranked together, so no single task ranks all keys
    sizes = n.groupBy("_n").agg(F.count(F.lit(1)).alias("_same"))
    above = F.coalesce(F.sum("_same").over(W.orderBy(F.desc("_n")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("_above", above).join(F.broadcast(keys))
    most = F.greatest(F.lit(1), F.bround(F.col("_k") * part).cast("bigint"))
    taken = F.greatest(F.lit(0), F.least(F.col("_same"), most - F.col("_above")))
    return ranked.agg(F.round(F.sum(taken * F.col("_n")) / F.max("_all"), 4).alias("share"))


def most_common(df: DataFrame, value: str, arrival: str, n: int) -> DataFrame:
    """(value, n) of the most frequent values; of equal counts, the one met first."""
    c = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(arrival).alias("_first"))
    return c.orderBy(F.desc("n"), "_first", value).limit(n).drop("_first")


def all_or_nothing(value: Column) -> Column:
    """The sum of a group, null if any part is missing."""
    return F.when(F.count(F.lit(1)) == F.count(value), F.sum(value))


def facet_options(df: DataFrame, groups: dict[str, Column], active: dict[str, list[str]], ident: str) -> DataFrame:
    """(facet, value, n): options of every facet, each counted under the selections of the other facets only.

    groups: facet -> array of a row's values. Options without matching rows stay, with 0. One pass marks for each facet whether
    a row meets its selection; a row counts for a facet if it meets all others.
    """
    marked = df.select(ident, *[c.alias(f"_v_{g}") for g, c in groups.items()])
    met = {g: F.arrays_overlap(f"_v_{g}", F.array(*map(F.lit, active[g]))) if active.get(g) else F.lit(True) for g in groups}
    parts = []
    for g in groups:
        others = F.lit(True)
        for o in groups:
            if o != g:
                others = others & F.coalesce(met[o], F.lit(False))
        parts.append(F.struct(F.lit(g).alias("facet"), F.col(f"_v_{g}").alias("values"), others.alias("counts")))
    each = marked.select(F.explode(F.array(*parts)).alias("x")).select("x.facet", "x.counts", F.explode("x.values").alias("value"))
    return each.groupBy("facet", "value").agg(F.count_if("counts").alias("n"))


def facet_filter(df: DataFrame, groups: dict[str, Column], active: dict[str, list[str]], haystack: Column | None = None, query: str = "") -> DataFrame:
    """Rows that meet every facet's selection (any of its values) and hold the query."""
    for g, c in groups.items():
        if active.get(g):
            df = df.where(F.arrays_overlap(c, F.array(*map(F.lit, active[g]))))
    if haystack is not None and query:
        df = df.where(F.lower(haystack).contains(query.lower()))
    return df
