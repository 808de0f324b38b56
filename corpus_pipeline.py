"""From raw documents to token ids: toxicity, near-dedup, substring dedup, decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
docs. A stage reads its input more than once, so run() writes each stage as Parquet in the shared folder and reads it again.

Defined cases: an empty table passes through all stages; a null text is never toxic, a duplicate or contaminated, has nothing
to cut and gives no ids; rows that share a doc_id stand for themselves, as near duplicates only if their texts are; further columns are carried along, and
n_chars follows a text that was cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, common, decontaminate, neardup, substring, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose score for label 1 is below one half."""
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("score < 0.5").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id of each group of near duplicates; rows that share a doc_id are told apart by a hash of the text."""
    named = docs.where("doc_id IS NOT NULL")
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():
        return _near_dedup_by_text(docs)
    keep = neardup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return named.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def _near_dedup_by_text(docs: DataFrame) -> DataFrame:
    """near_dedup where ids repeat: texts are numbered in the order of doc_id and hash; of equal rows one of least hash stays."""
    named = docs.where("doc_id IS NOT NULL").withColumn("_h", F.xxhash64("text"))
    one = named.groupBy("doc_id", "_h").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row"))
    numbered = common.cut(one.select("doc_id", "_h").orderBy("doc_id", "_h").withColumn("_n", F.monotonically_increasing_id()))
    texts = one.join(numbered, ["doc_id", "_h"]).select(F.col("_n").alias("doc_id"), F.col("_row.text").alias("text"))
    keep = neardup.near_duplicates(common.cut(texts)).where("kept").select(F.col("doc_id").alias("_n"))
    kept = one.join(numbered.join(keep, "_n", "left_semi"), ["doc_id", "_h"], "left_semi").select("_row.*")
    return kept.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; words inside repeated windows are gone from their texts."""
    done = substring.substring_dedup(docs)
    cut = F.col("n_removed") > 0
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return done.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    keyed = docs.withColumn("_id", F.struct("doc_id", F.xxhash64("text").alias("h")))  # rows may share a doc_id
    found = decontaminate.contained_items(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "_id").select(F.col("doc_id").alias("_found")).distinct()
    return keyed.join(found, F.col("_id") == F.col("_found"), "left_anti").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontaminate_benchmark),
    ("bpe", encode),
]
#: The learned score and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = common.scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        common.free_shuffles(spark)
    return docs
