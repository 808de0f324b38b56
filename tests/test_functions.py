"""Scalar functions and scores on the cases that change results."""

from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as T
from factloom.operators import joins as J
from factloom.operators import scores as S
from factloom.operators import windows as N


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_slug_and_default(spark):
    assert one(spark, T.slug(F.col("a")), a="Découpe  Laser!") == "decoupe-laser"
    assert one(spark, T.slug(F.col("a")), a="***") == "unknown"


def test_urls(spark):
    u = "HTTPS://www.Example.com/fr/Page/?x=1#y"
    assert one(spark, T.canonical_url(F.col("a")), a=u) == "https://www.example.com/fr/Page"
    assert one(spark, T.root_domain(F.col("a")), a="https://a.b.example.org/x") == "example.org"
    assert one(spark, T.language_of_url(F.col("a")), a=u) == "fr"
    assert one(spark, T.language_of_url(F.col("a")), a="https://de.example.com/x") == "de"
    assert one(spark, T.language_of_url(F.col("a")), a="https://example.com/french") is None


def test_numbers(spark):
    assert one(spark, T.number(F.col("a")), a="1 234,5") == 1234.5
    assert one(spark, T.number(F.col("a")), a="1,234.5") == 1234.5
    assert one(spark, T.number(F.col("a")), a="n/a") is None


def test_partial_dates_stay_partial(spark):
    key = D.partial_sort_key(F.col("a"))
    assert one(spark, key, a="2027") == "2027-00-00"
    assert one(spark, key, a="2027-4") == "2027-04-00"
    assert one(spark, D.pad_partial(F.col("a")), a="2027-4") == "2027-04"
    assert one(spark, D.pad_partial(F.col("a")), a="2027-4-1") == "2027-04-01"


def test_elapsed_days_are_not_calendar_days(spark):
    x = dict(a="2024-01-02 01:00:00", b="2024-01-01 23:00:00")
    a, b = F.col("a").cast("timestamp"), F.col("b").cast("timestamp")
    assert one(spark, D.whole_days(a, b), **x) == 0
    assert one(spark, F.date_diff(a, b), **x) == 1


def test_late_flag_needs_a_published_date(spark):
    late = D.is_late(F.col("c"), F.col("a").cast("date"), F.col("b").cast("date"))
    assert one(spark, late, c="published", a="2024-04-01", b="2024-01-01") is True
    assert one(spark, late, c="unknown", a="2024-04-01", b="2024-01-01") is None


def test_ratio_and_scores(spark):
    assert one(spark, S.ratio(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, S.review_priority(F.lit("C1"), F.lit(2), F.lit(None).cast("double")), a=1) == 9.0
    assert one(spark, S.threat_score(F.lit("C1"), F.lit(100), F.lit(100), F.lit(True), F.lit(False)), a=1) == 100.0
    assert one(spark, S.threat_score(F.lit("C1"), F.lit(1), F.lit(0), F.lit(True), F.lit(True)), a=1) == 0.0
    assert one(spark, S.freshness(F.lit(None).cast("bigint")), a=1) == 0.3


def test_childless_parent_counts_one_language(spark):
    p = spark.createDataFrame([(1,), (2,)], "k long")
    c = spark.createDataFrame([(1, "en"), (1, None)], "k long, lang string")
    got = {r.k: (r.n, r.languages) for r in J.count_children(p, c.withColumn("id", F.lit(1)), "k", n=F.count("id"), languages=F.countDistinct(F.coalesce("lang", F.lit("unknown")))).collect()}
    assert got == {1: (2, 2), 2: (0, 1)}
    alone = {r.k: r.languages for r in J.correlated_count(p, c, "k", "languages", F.countDistinct(F.coalesce("lang", F.lit("unknown")))).collect()}
    assert alone == {1: 2, 2: 0}


def test_rolling_baseline_flags_a_drop(spark):
    rows = [(1, i, float(v)) for i, v in enumerate([10, 10, 10, 2.9, 3.1])]
    df = spark.createDataFrame(rows, "k long, t long, v double")
    got = {r.t: r.anomaly for r in N.rolling_baseline(df, "k", "t", "v").collect()}
    assert got[3] is True and got[4] is False


def test_sentences(spark):
    got = one(spark, T.sentences(F.col("a")), a="First one is long. Short.\nAnother long line; and a third one! • a point of its own")
    assert got == ["First one is long.", "Another long line", "and a third one!", "a point of its own"]
