"""Sharding along a Hilbert curve.

Source, language and size of a document are quantised to BITS bits each; the cell's index on the Hilbert curve orders the
rows, and runs of equal row count are cut from that order. Neighbours in all three dimensions thus lie in the same or
neighbouring shards, and the ranges of cells in a shard's manifest row let a reader skip shards in any of them.

Law ``rows``: the counts of two shards differ by one at most. The order is (curve index, doc_id, text crc32, size), so it is
the same in every run; rows equal in all of these are interchangeable. The global rank is the row's place in its sorted
partition plus the rows of the partitions before: no task sees more than its partition, and the driver only counts a number per
partition. Defined cases: a null text has size 8 and crc32 0, a null source or language a cell of its own, a null doc_id sorts
first; an empty table gives no rows; columns that share a name with an output column are kept apart in the struct ``row``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SHARDS = 24
BITS = 5
DIMENSIONS = 3


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points (rows of cells), by Gray-code exchange and inversion of the axes."""
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ t)
            x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def cell_of_name(name: Column) -> Column:
    """A name's cell; null has one of its own."""
    return F.when(name.isNull(), F.lit(0)).otherwise(F.crc32(name) % ((1 << BITS) - 1) + 1).cast("int")


def cell_of_size(size: Column) -> Column:
    return F.least(F.floor(F.log2(size) * 2) - 6, F.lit((1 << BITS) - 1)).cast("int")


def _curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(hilbert_index(np.column_stack([a, b, c]), BITS))


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", carry: bool = True) -> DataFrame:
    """(row struct, size, text_crc32, c_source, c_lang, c_size, curve, shard, slot) of every input row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 8
    name = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry else [id_col])])
    cells = docs.select(row.alias("row"), F.col(id_col).alias("id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), cell_of_name(name("source")).alias("c_source"), cell_of_name(name("lang")).alias("c_lang"))
    cells = cells.withColumn("c_size", cell_of_size(F.col("size")))
    curve = F.pandas_udf(_curve, "long")
    keyed = cells.withColumn("curve", curve("c_source", "c_lang", "c_size"))
    order = ["curve", "id", "text_crc32", "size"]
    ordered = C.cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("place", 33)
    counts = sorted((r.part, r.n) for r in ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    total = sum(n for _, n in counts)
    before, at = [], 0
    for p, n in counts:
        before.append((p, at))
        at += n
    starts = docs.sparkSession.createDataFrame(before, "part long, before long")
    ranked = ordered.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"(rank * {shards}L) div {max(total, 1)}L")
    # the first rank of shard s is ceil(s * total / shards)
    first = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    out = ranked.withColumn("shard", shard).withColumn("slot", F.col("rank") - first)
    return out.select("row", "size", "text_crc32", "c_source", "c_lang", "c_size", "curve", F.col("shard").cast("int").alias("shard"), "slot")


def manifest(assigned: DataFrame) -> DataFrame:
    """A row for each shard: rows, bytes, and the range of cells in each dimension."""
    bounds = [f(c).alias(f"{n}_{c}") for c in ("c_source", "c_lang", "c_size", "curve") for n, f in (("min", F.min), ("max", F.max))]
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"), *bounds)


def shards_for(listing: DataFrame, source: str | None = None, lang: str | None = None) -> DataFrame:
    """Manifest rows that can hold documents of a source or language."""
    for column, value in (("c_source", source), ("c_lang", lang)):
        if value is not None:
            listing = listing.where(cell_of_name(F.lit(value)).between(F.col(f"min_{column}"), F.col(f"max_{column}")))
    return listing


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Writes each shard's rows in slot order below folder/shard=N; returns the manifest."""
    assigned = assign(docs, shards)
    assigned.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("overwrite").parquet(folder)
    return manifest(assigned)


def op3_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    a = assign(C.documents(spark, sf_dir), carry=False)
    return a.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op3_hilbert_shards": op3_hilbert_shards}
ORACLE = {}
