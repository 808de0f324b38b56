"""Join operators over column roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: A side is broadcast only if so many rows at most are in it; beyond, Spark plans a shuffle join.
SMALL_ROWS = 100_000


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df with a broadcast hint if a bounded count shows that it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def count_children(parents: DataFrame, children: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """Left outer star: aggregates of each parent's children, a childless parent being one row of nulls."""
    return parents.join(children, key, "left").groupBy(*parents.columns).agg(*[a.alias(n) for n, a in aggs.items()])


def correlated_count(parents: DataFrame, children: DataFrame, key: str, name: str, agg: Column) -> DataFrame:
    """Scalar subquery form: children are aggregated alone, so a childless parent gets 0."""
    return parents.join(children.groupBy(key).agg(agg.alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def top_one(parents: DataFrame, children: DataFrame, key: str, value: str, order: str, default) -> DataFrame:
    """Value of the first child in order, or a default."""
    first = children.groupBy(key).agg(F.min_by(value, order).alias("_top"))
    return parents.join(first, key, "left").withColumn(value, F.coalesce("_top", F.lit(default))).drop("_top")


def unique_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of left with exactly one match in right."""
    once = right.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(key))).where("_n = 1").drop("_n")
    return left.join(once, key)


def first_match(left: DataFrame, right: DataFrame, first_key: str, second_key: str, value: str, order: str) -> DataFrame:
    """Value by the first key, else by the second; the least by order where a key repeats."""
    pick = lambda k: right.where(F.col(k).isNotNull()).groupBy(k).agg(F.min_by(value, order).alias(f"_{k}"))
    out = left.join(pick(first_key), first_key, "left").join(pick(second_key), second_key, "left")
    return out.withColumn(value, F.coalesce(f"_{first_key}", f"_{second_key}")).drop(f"_{first_key}", f"_{second_key}")


def phrase_pairs(texts: DataFrame, aliases: DataFrame, id_col: str, text_col: str, alias_id: str, alias_col: str) -> DataFrame:
    """(id, alias id) where a text holds an alias as whole words.

    Aliases and texts meet on the alias's first word, an equi-join that scales in both; the whole phrase is verified after.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    tokens = texts.select(id_col, F.explode(F.array_distinct(words(F.col(text_col)))).alias("_w"))
    phrases = aliases.select(alias_id, F.array_join(words(F.col(alias_col)), " ").alias("_p")).where("_p <> ''").withColumn("_w", F.split("_p", " ")[0])
    # texts don't travel with their words: only candidate pairs are joined with them again
    candidates = tokens.join(phrases, "_w").select(id_col, alias_id, "_p").distinct()
    whole = texts.select(id_col, F.concat(F.lit(" "), F.array_join(words(F.col(text_col)), " "), F.lit(" ")).alias("_t"))
    hit = candidates.join(whole, id_col).where(F.col("_t").contains(F.concat(F.lit(" "), F.col("_p"), F.lit(" "))))
    return hit.select(id_col, alias_id).distinct()


def reasoned_pairs(df: DataFrame, id_col: str, reasons: dict[str, Column]) -> DataFrame:
    """(a, b, reasons): b shares any of the named keys with a, the least id of the key's rows.

    Rows that agree on a key are a class, given by its representative and its members, so a large class gives no pairs of
    members: two of them agree if their representatives do.
    """
    keyed = df.select(id_col, F.explode(F.array(*[F.struct(F.lit(n).alias("reason"), c.cast("string").alias("key")) for n, c in reasons.items()])).alias("r")).select(id_col, "r.*").where("key IS NOT NULL")
    classes = keyed.groupBy("reason", "key").agg(F.min(id_col).alias("a"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    pairs = keyed.withColumnRenamed(id_col, "b").join(classes, ["reason", "key"]).where("a < b")
    return pairs.groupBy("a", "b").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def contained(texts: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """(id, item): items that a text holds as they stand, at any place.

    An item of three words or more has an inner one, which the text then holds as a whole word: an equi-join on the first inner
    word. Shorter items meet the texts on their first characters, if there are such items. Candidates are verified on the text.
    """
    words = lambda c: F.filter(F.split(c, r"\s+"), lambda w: w != "")
    keyed = items.select(item_col, F.when(F.size(words(F.col(item_col))) > 2, F.try_element_at(words(F.trim(item_col)), F.lit(2))).alias("_w"))
    inner = keyed.where("_w IS NOT NULL")
    near = texts.select(id_col, F.explode(F.array_distinct(words(F.col(text_col)))).alias("_w")).join(small(inner), "_w").select(id_col, item_col)
    short = keyed.where("_w IS NULL").where(F.length(item_col) > 0).select(item_col)
    if not short.isEmpty():
        sizes = (1, 2, 3, 8)
        least = F.lit(sizes[0])
        for k in sizes[1:]:
            least = F.when(F.length(item_col) >= k, k).otherwise(least)
        short = short.withColumn("_k", least).withColumn("_w", F.substr(item_col, F.lit(1), F.col("_k")))
        ks = [r[0] for r in short.select("_k").distinct().collect()]  # four at most
        each = F.array(*[F.struct(F.lit(k).alias("k"), F.sequence(F.lit(1), F.greatest(F.length(text_col) - (k - 1), F.lit(1))).alias("at")) for k in ks])
        grams = F.array_distinct(F.flatten(F.transform(each, lambda e: F.transform(e["at"], lambda i: F.substr(F.col(text_col), i, e["k"])))))
        near = near.unionByName(texts.select(id_col, F.explode(grams).alias("_w")).join(small(short.select(item_col, "_w")), "_w").select(id_col, item_col))
    return near.distinct().join(texts.select(id_col, text_col), id_col).where(F.contains(F.col(text_col), F.col(item_col))).select(id_col, item_col)


def neighbours(df: DataFrame, group: str, order: str, value: str, radius: int) -> DataFrame:
    """Values within so many places in the same group, itself included."""
    return df.withColumn("near", F.collect_list(value).over(W.partitionBy(group).orderBy(order).rowsBetween(-radius, radius)))


def first_of_roster(df: DataFrame, id_col: str, array: str, roster: DataFrame, key: str) -> DataFrame:
    """(id, matched): the first element of an array that the roster knows; null if it knows none."""
    each = df.select(id_col, F.posexplode_outer(array).alias("pos", key))
    known = each.join(roster.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    return known.groupBy(id_col).agg(F.min_by(F.when(F.col("_known"), F.col(key)), F.when(F.col("_known"), F.col("pos"))).alias("matched"))
