"""Benchmark decontamination by size-partitioned MinHash containment, in DataFrame functions only.

Items are partitioned by the size of their shingle set (powers of two). An item is represented by its minimum hashes: the k
least of its n distinct shingle hashes. A document that holds 75 % of the item lacks n - ceil(0.75 n) of its shingles at most,
so it holds k minus that many of the k least ones. Each partition sets how many of them a document must hold (``NEEDED``: more
for larger items, so that chance hits don't suffice), and k follows from it: about a quarter of the item. The choice by least
hashes can't lose a pair, whatever it is, and cuts what is looked up to a quarter or a third.

One pass over the texts: a document's shingle hashes are looked up in a bit table of the signatures' hashes (a Bloom filter of
one function: BITS_EACH bits for a hash, at most 2**MOST_BITS in all, handed over as a scalar subquery), and only documents with a
hit go on, with their text; no text is shuffled. Their hits are joined with the signatures, pairs with enough of them are
verified on the full sets of shingle strings, and those are what is reported.

A shingle is five consecutive lower-cased words, or all words of a text with fewer; words are maximal runs outside
``\\x20 \\x09-\\x0D``. A pair is reported if the document holds at least 75 % of the item's distinct shingles. Where
there are items of fewer than five words, documents are also read in runs of as many words as those items have.

Defined cases: null or blank texts and items match nothing; a short item matches a document that holds its words in a
row; repeated rows of one id count as separate texts of which the best counts; other columns are ignored; an empty
table gives an empty result. A passage in very many documents gives one row for each, never pairs of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

WIDTH = 5
THRESHOLD_PCT = 75
#: Least hashes that a document must hold, by the size partition (power of two) of the item; 1 below the first.
NEEDED = ((3, 2), (4, 3), (5, 4), (6, 6), (7, 8), (8, 12), (9, 16))
#: Bits of the table for each signature hash (a document has hundreds of shingles, and few should hit by chance), and the exponent of
#: the largest table (8 MB); a fuller one lets more documents through to the joins, with the same result.
BITS_EACH = 1 << 13
MOST_BITS = 26

_BLANK = r"[ \t\n\x0B\f\r]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _BLANK), lambda w: w != "")


def _starts(words: Column) -> Column:
    """First positions (from 1) of the shingles: one for a text of fewer words, none for a blank one."""
    return F.when(F.size(words) > 0, F.sequence(F.lit(1), F.greatest(F.size(words) - (WIDTH - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once: a lambda's variable isn't inlined into the places that read it."""
    return F.transform(F.array(value), use)[0]


def _starts_of(words: Column, k: int) -> Column:
    """First positions (from 1) of the runs of k words."""
    return F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))


def _each(words: Column, use, short: list[int]) -> Column:
    """use(slice) of every shingle, and of every run of k words for each k in short."""

    def runs(starts: Column, k: int) -> Column:
        return F.transform(starts, lambda i: use(F.slice(words, i, F.lit(k))))

    shingles = runs(_starts(words), WIDTH)
    return F.concat(shingles, *[runs(_starts_of(words, k), k) for k in short]) if short else shingles


def _strings(text: Column, short: list[int] = []) -> Column:  # noqa: B006
    return _let(_words(text), lambda w: F.array_distinct(_each(w, lambda s: F.array_join(s, " "), short)))


def _hashes(text: Column, short: list[int] = []) -> Column:  # noqa: B006
    return _let(_words(text), lambda w: _each(w, F.xxhash64, short))


def signatures(items: DataFrame) -> DataFrame:
    """(item_row, item_id, n, part, needed, h): the least hashes of each item (item_row, item_id, t), one row each."""
    sets = items.select("item_row", "item_id", F.array_sort(F.array_distinct(_hashes(F.col("t")))).alias("hs")).where(F.size("hs") > 0)
    sets = sets.withColumn("n", F.size("hs")).withColumn("part", F.floor(F.log2("n")).cast("int"))
    may_lack = F.col("n") - F.ceil(F.col("n") * THRESHOLD_PCT / 100).cast("int")
    at_least = F.lit(1)
    for part, needed in NEEDED:
        at_least = F.when(F.col("part") >= part, needed).otherwise(at_least)
    # what is needed can't be more than what a document at the threshold holds
    sets = sets.withColumn("needed", F.least(at_least, F.col("n") - may_lack)).withColumn("k", may_lack + F.col("needed"))
    return sets.select("item_row", "item_id", "n", "part", "needed", F.explode(F.slice("hs", 1, F.col("k"))).alias("h"))


def bit_table(hashes: DataFrame, bits: int) -> DataFrame:
    """One row: an array of 2**(bits - 6) longs in which the bit of each hash h is set."""
    bit = F.expr("shiftleft(1L, cast(h & 63 as int))")
    words = hashes.groupBy(F.expr(f"cast(shiftrightunsigned(h, {64 - bits + 6}) as int)").alias("word")).agg(F.bit_or(bit).alias("bits"))
    every = hashes.sparkSession.range(1 << (bits - 6)).select(F.col("id").cast("int").alias("word"))
    held = every.join(words, "word", "left").select(F.struct("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits")).alias("w"))
    return held.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("table"))  # 2**(bits - 6) entries


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of each item found in each document."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    items = benchmark.select("item_id", F.col("text").alias("t")).where(F.col("t").isNotNull())
    items = items.select("item_id", F.xxhash64("t").alias("item_row"), "t")
    length = F.size(_words(F.col("t"))).alias("k")
    short = sorted(r.k for r in items.select(length).where(F.col("k").between(1, WIDTH - 1)).distinct().collect())  # WIDTH - 1 rows at most
    held, n = C.counted(signatures(items))
    # documents with a hit, and their hits
    kept = _candidates(d, held, n, short, most_bits)
    hits = kept.select("doc_id", "row", F.explode("hs").alias("h")).join(C.sized(held, n), "h")
    pairs = hits.groupBy("doc_id", "row", "item_row", "item_id").agg(F.count(F.lit(1)).alias("k"), F.first("needed").alias("needed"))
    pairs, m = C.counted(pairs.where("k >= needed").select("doc_id", "row", "item_row", "item_id"))
    # verified on the strings
    sets = items.select(F.col("item_row").alias("of_row"), F.col("item_id").alias("of_item"), _strings(F.col("t")).alias("item_set")).dropDuplicates(["of_row", "of_item"])
    texts = kept.select(F.col("doc_id").alias("text_id"), F.col("row").alias("text_row"), "text")
    both = texts.join(C.sized(pairs, m), F.col("row").eqNullSafe(F.col("text_row")) & F.col("doc_id").eqNullSafe(F.col("text_id")))
    both = both.join(C.sized(sets, n), (F.col("item_row") == F.col("of_row")) & F.col("item_id").eqNullSafe(F.col("of_item")))
    shared = F.size(F.array_intersect("item_set", _strings(F.col("text"), short)))
    checked = both.select("doc_id", "item_id", F.size("item_set").cast("long").alias("n_item_shingles"), shared.cast("long").alias("n_shared"))
    checked = checked.where(F.col("n_shared") * 100 >= F.col("n_item_shingles") * THRESHOLD_PCT)
    best = checked.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item_shingles")).alias("containment"), "n_item_shingles", "n_shared")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_shared", "b.containment")


def _candidates(d: DataFrame, held: DataFrame, n: int, short: list[int], most_bits: int) -> DataFrame:
    """(doc_id, row, text, hs) of documents with a shingle whose bit is set, and those shingles' hashes: a checkpoint."""
    bits = max(8, min(most_bits, (n * BITS_EACH).bit_length()))
    table = bit_table(held.select("h").distinct(), bits).scalar()
    there = lambda h: F.getbit(F.element_at("table", F.shiftrightunsigned(h, 64 - bits + 6).cast("int") + 1), h.bitwiseAND(F.lit(63)).cast("int")) == 1
    # exploded rather than filtered: a filter would be pushed below and work the hashes out a second time
    hs = F.array_distinct(F.filter(_hashes(F.col("text"), short), there))
    found = d.withColumn("table", table).select("doc_id", F.xxhash64("text").alias("row"), "text", F.explode(F.filter(F.array(hs), lambda x: F.size(x) > 0)).alias("hs"))
    return C.cut(found)


def op9_minhash_containment(spark, sf_dir: str) -> DataFrame:
    return contained_items(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SETS = """SELECT {id} AS id, text, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE
    list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM (SELECT {id}, text, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL)"""
ORACLE = {
    "op9_minhash_containment": f"""
WITH d AS ({_SETS.format(id="doc_id", table="documents")}), b AS ({_SETS.format(id="item_id", table="benchmark")}),
ds AS (SELECT DISTINCT id, text, unnest(s) AS g FROM d), bs AS (SELECT DISTINCT id, text, len(s) AS n, unnest(s) AS g FROM b),
c AS (SELECT ds.id AS doc_id, bs.id AS item_id, ds.text, bs.text AS item, any_value(n) AS n_item_shingles, count(*) AS n_shared
  FROM ds JOIN bs USING (g) GROUP BY ALL)
SELECT doc_id, item_id, any_value(n_item_shingles)::BIGINT AS n_item_shingles, max(n_shared)::BIGINT AS n_shared,
  max(n_shared / n_item_shingles) AS containment
FROM c WHERE n_shared * 100 >= n_item_shingles * 75 GROUP BY doc_id, item_id"""
}
QUERIES = {"op9_minhash_containment": op9_minhash_containment}
