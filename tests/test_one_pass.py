"""Labels are found in one pass over the texts: no text, term or sentence is shuffled, and batches of texts stay small."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import rules as R
from factloom.operators import vocabulary as V
from factloom.plans import registry

from .oracle import SF
from .test_rules_state import RULES, check_all

QUERIES = registry.queries()
ODD = ["a\0b-c,d", "E – ﬁ STRASSE straße", "", "  ", "x_y-z…w", "ｌａｓｅｒ ｗｅｌｄ", "été ; (a)", "١٢ ½ Ⅷ ǅ", "\0", "a​b­c"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_as_spark_parts_them(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string")
    want = [r.p.split() for r in df.orderBy("id").select(R.padded(F.col("text")).alias("p")).collect()]
    assert R.words_of(ODD) == want == [R.words_of([x])[0] for x in ODD]


def test_labels_shuffle_nothing(spark):
    df = spark.createDataFrame([(1, "laser weld")], "id long, text string")
    assert "Exchange" not in plan(R.labels(df, R.rule_table(spark, RULES)))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


@pytest.mark.parametrize("name", ["tx04_rule_matches", "tx12_maturity", "tx21_ambiguous_window", "tx25_partial_two_of_three"])
def test_queries_that_shuffle_nothing(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("name", ["tx28_reject_reasons", "tx33_compiled", "tx16_sentence_labels", "tx09_domain_gate", "tx10_on_topic", "tx11_negative_gates", "tx31_career_signal", "tx43_match_terms"])
def test_queries_that_read_texts_once(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan parquet") == 1 and "Join" not in text


@pytest.mark.parametrize("name", ["tx24_relation_cascade", "tx26_confidence_model"])
def test_relations_join_no_window(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("FileScan parquet") == 1 and "Join" not in text


def test_many_terms_are_joined(spark, monkeypatch):
    monkeypatch.setattr(R, "SMALL_ROWS", 3)
    r = random.Random(5)
    pool = ["laser", "weld", "joining", "spot", "cut", "trim", "beam", "glass", "thin", "clear", "steel", "sheet", "of", "-", ","]
    check_all(spark, [(i, " ".join(r.choice(pool) for _ in range(r.randrange(0, 9)))) for i in range(60)], RULES)
    with pytest.raises(ValueError):
        R.labelled(spark.createDataFrame([(1, "x")], "id long, text string"), R.rule_table(spark, RULES))


def test_phrases_among_cues(spark):
    df = spark.createDataFrame([(1, "It is NOT so"), (2, "as long-as it"), (3, None)], "id long, text string")
    got = {r.id: (r.a, r.b) for r in R.labelled(df, R.rule_table(spark, V.vocabulary()), "text", {"a": ("not",), "b": ("long as",)}).collect()}
    assert got == {1: (True, False), 2: (False, True), 3: (None, None)}
