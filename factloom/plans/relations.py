"""Relation cascade, compiled labels, and the remaining state plans on the landed tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.operators import state as X

from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query

def n():
    return F.count(F.lit(1))


@q("tx41_context_text", "SELECT conv_id, turn, md5(concat_ws(' | ', lag(role) OVER (PARTITION BY conv_id ORDER BY turn), role, text)) AS context FROM conversations")
def tx41(t):
    before = F.lag("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.table("conversations").select("conv_id", "turn", F.md5(F.concat_ws(" | ", before, "role", "text")).alias("context"))


@q("st02_offer_routing", "SELECT buyer_id, count(DISTINCT offer_id) AS proofs, CASE WHEN count(DISTINCT offer_id) < 10 THEN 'review' ELSE 'accepted' END AS route FROM offers GROUP BY 1", "offers")
def st02(t):
    p = t.offers.groupBy("buyer_id").agg(F.countDistinct("offer_id").alias("proofs"))
    return p.withColumn("route", F.when(F.col("proofs") < 10, "review").otherwise("accepted"))


@q("st05_promotion", "SELECT e.evidence_id, CASE WHEN o.offer_id IS NULL THEN 'queued' ELSE 'corpus' END AS place FROM evidence e LEFT JOIN (SELECT offer_id FROM offers WHERE review_status = 'validated') o USING (offer_id)", "evidence offers")
def st05(t):
    o = t.offers.where("review_status = 'validated'").select("offer_id", F.lit(True).alias("known"))
    return t.evidence.select("evidence_id", "offer_id").join(o, "offer_id", "left").select("evidence_id", F.when(F.col("known"), "corpus").otherwise("queued").alias("place"))


@q("st06_exclusion_cascade", "SELECT count(*) AS n FROM evidence WHERE offer_id NOT IN (SELECT offer_id FROM offers WHERE review_status = 'rejected')", "evidence offers")
def st06(t):
    return t.evidence.select("offer_id").join(t.offers.where("review_status = 'rejected'").select("offer_id"), "offer_id", "left_anti").agg(n().alias("n"))


@q("st11_late_rows_kept", "SELECT CASE WHEN date_diff('day', published, created) > 60 THEN 'late' ELSE 'in_time' END AS kind, count(*) AS n FROM evidence JOIN offers USING (offer_id) GROUP BY 1", "evidence offers")
def st11(t):
    j = t.evidence.select("offer_id", "created").join(t.offers.select("offer_id", "published"), "offer_id")
    return j.groupBy(F.when(D.whole_days(F.col("created"), F.col("published")) > D.LATE_DAYS, "late").otherwise("in_time").alias("kind")).agg(n().alias("n"))


@q("st12_lookback", "SELECT count(*) FILTER (WHERE created >= DATE '2001-11-05' - 60) AS d60, count(*) FILTER (WHERE created >= DATE '2001-11-05' - 365) AS d365, count(*) FILTER (WHERE created >= DATE '2001-11-05' - 730) AS d730 FROM evidence", "evidence")
def st12(t):
    back = lambda d: F.count_if(F.col("created") >= F.date_sub(F.lit("2001-11-05").cast("date"), d))
    return t.evidence.agg(*[back(d).alias(f"d{d}") for d in (60, 365, 730)])


@q("st15_orphan_runs", "SELECT event_id, CASE WHEN event_type = 'error' AND value < 5 THEN 'interrupted' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status FROM runs", "runs")
def st15(t):
    s = t.runs.withColumn("status", F.when(F.col("event_type") == "error", "running").otherwise("done"))
    s = X.transition(s, "status", {"running": "interrupted"}, F.col("value") < 5)
    return X.transition(s, "status", {"running": "failed"}, F.lit(True)).select("event_id", "status")


@q("st17_relation_first", "SELECT actor_id, part_id, min(evidence_id) AS evidence_id FROM evidence GROUP BY 1, 2", "evidence")
def st17(t):
    return t.evidence.groupBy("actor_id", "part_id").agg(F.min("evidence_id").alias("evidence_id"))


@q("st19_column_policies", "SELECT part_id, max(amount) AS amount, min(created) AS first, list_sort(list_distinct(list(status))) AS statuses FROM evidence GROUP BY 1", "evidence")
def st19(t):
    e = t.evidence.select("part_id", "evidence_id", "amount", F.col("created").alias("first"), F.array("status").alias("statuses"))
    return X.fold(e.where("evidence_id % 2 = 0"), e.where("evidence_id % 2 = 1"), ["part_id"], {"amount": X.most, "first": X.least, "statuses": X.union}, ["evidence_id"])


@q("st22_vocabulary_queue", "SELECT w, count(*) AS seen, count(*) >= 150 AS promoted FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY 1")
def st22(t):
    w = F.explode(F.array_distinct(F.split(F.lower("text"), " ")))
    c = t.table("documents").select("doc_id", w.alias("w")).distinct().groupBy("w").agg(n().alias("seen"))
    return c.withColumn("promoted", F.col("seen") >= 150)


@q(
    "st25_release_plan",
    "SELECT offer_id, CASE WHEN precedence = 1 AND price < 50000 THEN 'small_urgent' WHEN precedence <= 2 AND price < 100000 THEN 'moderate' ELSE 'low_risk' END AS rule FROM offers WHERE review_status = 'pending' AND (precedence = 1 AND price < 50000 OR precedence <= 2 AND price < 100000 OR price < 20000)",
    "offers",
)
def st25(t):
    rule = F.when(F.expr("precedence = 1 AND price < 50000"), "small_urgent").when(F.expr("precedence <= 2 AND price < 100000"), "moderate").when(F.expr("price < 20000"), "low_risk")
    return t.offers.where("review_status = 'pending'").select("offer_id", rule.alias("rule")).where("rule IS NOT NULL")


@q("st28_legacy_grouping", "SELECT actor_id || '|' || bucket AS application_key, count(*) AS merged, max(evidence_id) AS kept FROM evidence GROUP BY 1", "evidence")
def st28(t):
    return t.evidence.groupBy(F.concat_ws("|", F.col("actor_id").cast("string"), "bucket").alias("application_key")).agg(n().alias("merged"), F.max("evidence_id").alias("kept"))


@q("st29_maturity_to_bucket", "SELECT evidence_id, CASE date_confidence WHEN 'published' THEN 'existing' WHEN 'observed_only' THEN 'radar' ELSE bucket END AS bucket FROM evidence", "evidence")
def st29(t):
    return t.evidence.select("evidence_id", F.when(F.col("date_confidence") == "published", "existing").when(F.col("date_confidence") == "observed_only", "radar").otherwise(F.col("bucket")).alias("bucket"))


@q("st30_golden_insert", "SELECT count(*) AS n FROM (SELECT DISTINCT actor_id, part_id, bucket, status FROM evidence)", "evidence")
def st30(t):
    k = ["actor_id", "part_id", "bucket", "status"]
    g = t.evidence.select(*k).distinct()
    return X.insert_missing(X.insert_missing(g.limit(0), g, k), g, k).agg(n().alias("n"))


@q("st35_schema_evolution", "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def st35(t):
    old = t.table("documents").select(F.col("doc_id").alias("id"), "lang")
    return old.unionByName(t.table("pages").select(F.col("page_id").alias("id"), "url"), allowMissingColumns=True)


@q("st36_discovery_memo", "SELECT actor_id, CASE WHEN parent IS NULL THEN 'checked_none' WHEN active THEN 'feed' ELSE 'unchecked' END AS memo FROM actors", "actors")
def st36(t):
    return t.actors.select("actor_id", F.when(F.col("parent").isNull(), "checked_none").when(F.col("active"), "feed").otherwise("unchecked").alias("memo"))
