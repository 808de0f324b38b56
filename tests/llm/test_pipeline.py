"""The pipeline against its stages done by brute force."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import bpe

from .test_operators import corpus, near_brute, substring_brute, words


def test_pipeline(spark, tmp_path):
    rows = corpus(80, seed=11)
    rows += [(500, rows[6][1] + " moron moron"), (501, None)]
    r = random.Random(1)
    labelled = [(i, 1, int(i % 4 == 0)) for i in range(1000, 1300)]
    rows += [(i, " ".join(r.choice(["stone", "house", "river", "bread", "field"]) for _ in range(12)) + f" u{i} " + ("moron" if bad else "")) for i, _, bad in labelled]
    item = " ".join(f"b{i}" for i in range(30))
    rows.append((600, "before " + item + " after"))
    folder = f"{tmp_path}/in"
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}

    left = [(i, t) for i, t in rows if "moron" not in words(t)]
    near = near_brute(left)
    left = [(i, t) for i, t in left if near[i][2]]
    text = {i: t for i, t in left}
    for i, _, n_removed, kept in substring_brute(left):
        if n_removed:
            text[i] = kept
    del text[600]
    coder = bpe.ByteBPE(*bpe._default_vocabulary())
    assert set(got) == set(text)
    for i, t in text.items():
        assert got[i].ids == coder.encode_batch([t or ""])[0].tolist() and got[i].n_tokens == len(got[i].ids)


def test_rows_that_share_an_id(spark, tmp_path):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, a), (2, a + " more"), (2, c), (3, c), (None, a), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(((r.doc_id or 0, r.text or "-") for r in got)) == sorted([(1, a), (1, b), (2, c), (0, a), (4, "-"), (4, "-")])
    spark.createDataFrame([(0, b)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path)).collect()
    assert sorted(((r.doc_id or 0, r.text or "-") for r in got)) == sorted((i or 0, t or "-") for i, t in rows if t != b)


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 5, "extra")], "doc_id long, text string, lang string, source string, n_chars long, score string").limit(0)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() == 0
    assert F.col("x") is not None


def test_stages_with_rows_and_clashing_columns(spark, tmp_path):
    """Every stage over rows with nulls in every column and columns named like those that operators make."""
    a = " ".join(f"a{i}" for i in range(60))
    rows = [(1, a, "en", None, 5, "s", 7, "k"), (2, a + " more", None, "src", None, None, None, None), (3, None, "fr", "src", 0, "s", 1, "k"), (None, a, "de", "src", 3, "s", 2, "k"), (4, "", None, None, None, None, None, None), (5, a, "en", "x", 1, "s", 3, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, id long, row string")
    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (4, 1, 0), (5, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of this"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert got.columns == docs.columns, name
        out[name] = sorted(str(r.doc_id) for r in got.collect())
    everyone = ["1", "2", "3", "4", "5", "None"]
    assert out["toxicity"] == everyone and out["substring_dedup"] == everyone and out["decontamination"] == everyone and out["bpe"] == everyone
    assert out["near_dedup"] == ["1", "3", "4", "None"]
