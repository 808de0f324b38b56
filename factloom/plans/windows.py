"""Windows, sorts, top-k, sampling and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factloom.operators import windows as N

from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query

_TIE = ["evidence_id", "part_id", "actor_id", "amount"]
_TIE_SQL = "evidence_id, part_id, actor_id, amount"


@q(
    "wn01_best_of_group",
    f"SELECT actor_id, bucket, evidence_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY actor_id, bucket ORDER BY confidence DESC NULLS LAST, amount DESC, {_TIE_SQL}) AS rn FROM evidence) WHERE rn = 1",
    "evidence",
)
def wn01(t):
    return N.best_of_group(t.evidence, ["actor_id", "bucket"], [F.desc_nulls_last("confidence"), F.desc("amount"), *map(F.col, _TIE)]).select("actor_id", "bucket", "evidence_id", "confidence")


@q("wn02_first_wins", f"SELECT part_id, evidence_id, created FROM (SELECT *, row_number() OVER (PARTITION BY part_id ORDER BY created, {_TIE_SQL}) AS rn FROM evidence) WHERE rn = 1", "evidence")
def wn02(t):
    return N.best_of_group(t.evidence, "part_id", [F.col("created"), *map(F.col, _TIE)]).select("part_id", "evidence_id", "created")


@q(
    "wn03_composite_representative",
    "SELECT actor_id, arg_max(evidence_id, struct_pack(a := CASE bucket WHEN 'existing' THEN 2 WHEN 'radar' THEN 1 ELSE 0 END, b := amount, c := evidence_id)) AS representative FROM evidence GROUP BY 1",
    "evidence",
)
def wn03(t):
    rank = F.when(F.col("bucket") == "existing", 2).when(F.col("bucket") == "radar", 1).otherwise(0)
    return t.evidence.groupBy("actor_id").agg(F.max_by("evidence_id", F.struct(rank, "amount", "evidence_id")).alias("representative"))


@q("wn04_duplicate_rows", f"SELECT evidence_id FROM (SELECT *, row_number() OVER (PARTITION BY actor_id, part_id ORDER BY {_TIE_SQL}) AS rn FROM evidence) WHERE rn > 1", "evidence")
def wn04(t):
    return N.beyond_first(t.evidence, ["actor_id", "part_id"], [F.col(c) for c in _TIE]).select("evidence_id")


@q("wn05_keep_recent", f"SELECT actor_id, evidence_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY created DESC, {_TIE_SQL}) AS rank FROM evidence) WHERE rank <= 5", "evidence")
def wn05(t):
    return N.top_n(t.evidence, "actor_id", [F.desc("created"), *map(F.col, _TIE)], 5).select("actor_id", "evidence_id", F.col("rank").cast("bigint").alias("rank"))


@q("wn06_lag_change", "SELECT event_id, user_id, lag(event_type) OVER w AS before, coalesce(event_type <> lag(event_type) OVER w, true) AS changed FROM runs WINDOW w AS (PARTITION BY user_id ORDER BY event_id)", "runs")
def wn06(t):
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    return t.runs.select("event_id", "user_id", before.alias("before"), F.coalesce(F.col("event_type") != before, F.lit(True)).alias("changed"))


@q(
    "wn07_rolling_baseline",
    """SELECT event_id, baseline, history, history >= 3 AND baseline >= 3 AND value < baseline * 0.3 AS anomaly FROM (SELECT event_id, value, median(value) OVER w AS baseline, count(value) OVER w AS history FROM runs
    WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))""",
    "runs",
)
def wn07(t):
    out = N.rolling_baseline(t.runs, "user_id", "event_id", "value")
    return out.select("event_id", "baseline", "history", (F.coalesce("anomaly", F.when(F.col("history") < 3, F.lit(False)))).alias("anomaly"))


@q("wn08_round_robin", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS turn FROM runs", "runs")
def wn08(t):
    return N.round_robin(t.runs, "event_type", [F.desc("value"), F.col("event_id")]).select("event_id", "event_type", F.col("turn").cast("bigint").alias("turn"))


@q(
    "wn09_covering_selection",
    """WITH a AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS f FROM runs),
    b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN f = 1 THEN 0 ELSE 1 END, value DESC, event_id) AS g FROM a),
    c AS (SELECT *, CASE WHEN f = 1 THEN 1 WHEN g <= 8 THEN 2 ELSE 3 END AS pass FROM b)
    SELECT event_id, user_id, event_type, pass FROM c ORDER BY pass, value DESC, event_id LIMIT 1500""",
    "runs",
)
def wn09(t):
    return N.covering_selection(t.runs, "user_id", "event_type", "value", "event_id", 8, 1500).select("event_id", "user_id", "event_type", "pass")


@q(
    "wn10_bucketed_split",
    f"""SELECT bucket, evidence_id, total FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY created DESC, {_TIE_SQL}) AS rn, count(*) OVER (PARTITION BY bucket) AS total FROM evidence) WHERE rn <= 40""",
    "evidence",
)
def wn10(t):
    totals = t.evidence.groupBy("bucket").agg(F.count(F.lit(1)).alias("total"))
    top = N.top_n(t.evidence, "bucket", [F.desc("created"), *map(F.col, _TIE)], 40)
    return top.join(F.broadcast(totals), "bucket").select("bucket", "evidence_id", "total")


@q("wn11_sentence_pairs", "SELECT conv_id, turn, role || '>' || lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM conversations")
def wn11(t):
    nxt = F.lead("role").over(W.partitionBy("conv_id").orderBy("turn"))
    return t.table("conversations").select("conv_id", "turn", F.concat("role", F.lit(">"), nxt).alias("pair"))


@q("wn12_context", "SELECT conv_id, turn, string_agg(role, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS context FROM conversations")
def wn12(t):
    near = F.collect_list("role").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(-1, 1))
    return t.table("conversations").select("conv_id", "turn", F.concat_ws(" ", near).alias("context"))


@q(
    "wn13_heading_segments",
    """WITH h AS (SELECT conv_id, turn, role, length(text) AS n, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM conversations)
    SELECT conv_id, segment::BIGINT AS segment, count(*) AS blocks, sum(n)::BIGINT AS chars FROM h GROUP BY 1, 2""",
)
def wn13(t):
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    seg = F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)
    return t.table("conversations").select("conv_id", seg.alias("segment"), F.length("text").alias("n")).groupBy("conv_id", "segment").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("chars"))


@q(
    "wn14_ordered_distinct",
    """SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first FROM runs GROUP BY 1, 2) GROUP BY 1""",
    "runs",
)
def wn14(t):
    first = t.runs.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("first", "event_type"))), lambda x: x["event_type"])
    return first.groupBy("user_id").agg(F.array_join(ordered, ",").alias("kinds"))


@q("wn15_first_non_null", f"SELECT part_id, (list(lang ORDER BY {_TIE_SQL}) FILTER (WHERE lang IS NOT NULL))[1] AS lang FROM evidence GROUP BY 1", "evidence")
def wn15(t):
    return t.evidence.groupBy("part_id").agg(F.min_by("lang", F.when(F.col("lang").isNotNull(), F.struct(*_TIE))).alias("lang"))


@q("wn16_latest_period", "SELECT * FROM (SELECT strftime(day, '%Y-%m') AS period, count(*) AS n FROM runs GROUP BY 1) WHERE period = (SELECT max(strftime(day, '%Y-%m')) FROM runs)", "runs")
def wn16(t):
    by = t.runs.groupBy(F.date_format("day", "yyyy-MM").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    last = by.agg(F.max("period").alias("period"))
    return by.join(F.broadcast(last), "period")


@q("so01_multi_key", "SELECT actor_id, row_number() OVER (ORDER BY active DESC, is_reference DESC, name) AS place FROM actors", "actors")
def so01(t):
    return N.global_rank(t.actors, [F.desc("active"), F.desc("is_reference"), F.asc("name")], "place").select("actor_id", "place")


@q("so02_coalesced_order_limit", f"SELECT evidence_id FROM evidence ORDER BY coalesce(confidence, amount / 1000000) DESC, {_TIE_SQL} LIMIT 25", "evidence")
def so02(t):
    return t.evidence.orderBy(F.desc(F.coalesce("confidence", F.col("amount") / 1000000)), *_TIE).limit(25).select("evidence_id")


@q("so03_latest_row", "SELECT * FROM runs ORDER BY event_id DESC LIMIT 1", "runs")
def so03(t):
    return t.runs.orderBy(F.desc("event_id")).limit(1)


@q(
    "so04_partial_date_key",
    """SELECT offer_id, CASE offer_id % 3 WHEN 0 THEN strftime(published, '%Y') || '-00-00' WHEN 1 THEN strftime(published, '%Y-%m') || '-00' ELSE strftime(published, '%Y-%m-%d') END AS sort_key FROM offers""",
    "offers",
)
def so04(t):
    from factloom.functions.dates import partial_sort_key

    partial = F.when(F.col("offer_id") % 3 == 0, F.date_format("published", "yyyy")).when(F.col("offer_id") % 3 == 1, F.date_format("published", "yyyy-M")).otherwise(F.date_format("published", "yyyy-M-d"))
    return t.offers.select("offer_id", partial_sort_key(partial).alias("sort_key"))


@q(
    "so05_priority",
    f"""SELECT evidence_id, round(w * 2 * CASE WHEN confidence IS NULL THEN 1.5 ELSE 1 + (1 - confidence) END, 3) AS priority FROM (SELECT e.*, CASE class WHEN 'C1' THEN 3 WHEN 'C2' THEN 2 WHEN 'A1' THEN 2 ELSE 1 END AS w FROM evidence e JOIN actors USING (actor_id))
    ORDER BY priority DESC, {_TIE_SQL} LIMIT 200""",
    "evidence actors",
)
def so05(t):
    from factloom.operators.scores import review_priority

    e = t.evidence.join(t.actors.select("actor_id", "class"), "actor_id")
    return e.withColumn("priority", review_priority(F.col("class"), F.lit(2), F.col("confidence"))).orderBy(F.desc("priority"), *_TIE).limit(200).select("evidence_id", "priority")


@q("so06_hash_sample", "SELECT offer_id FROM offers WHERE review_status = 'pending' ORDER BY sha256('seed:offers:' || offer_id::VARCHAR), offer_id LIMIT 60", "offers")
def so06(t):
    return t.offers.where("review_status = 'pending'").orderBy(F.sha2(F.concat(F.lit("seed:offers:"), F.col("offer_id").cast("string")), 256), "offer_id").limit(60).select("offer_id")


@q("so07_coverage_rank", "SELECT event_id, value - 10 * (row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) - 1) AS effective FROM runs ORDER BY effective DESC, event_id LIMIT 100", "runs")
def so07(t):
    nth = F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return t.runs.select("event_id", (F.col("value") - 10 * (nth - 1)).alias("effective")).orderBy(F.desc("effective"), "event_id").limit(100)


@q("so08_locale_ties", "SELECT label, row_number() OVER (ORDER BY strip_accents(lower(label)), label) AS place FROM (SELECT DISTINCT label FROM parts)", "parts")
def so08(t):
    labels = t.parts.select("label").distinct()
    return N.global_rank(labels, [F.collate("label", "fr").asc(), F.asc("label")], "place").select("label", "place")


@q(
    "so09_union_top",
    "SELECT * FROM (SELECT 'offer' AS kind, offer_id AS id, price AS amount FROM offers UNION ALL SELECT 'evidence', evidence_id, amount FROM evidence) ORDER BY amount DESC, kind, id LIMIT 20",
    "offers evidence",
)
def so09(t):
    a = t.offers.select(F.lit("offer").alias("kind"), F.col("offer_id").alias("id"), F.col("price").alias("amount"))
    b = t.evidence.select(F.lit("evidence").alias("kind"), F.col("evidence_id").alias("id"), "amount")
    return a.unionByName(b).orderBy(F.desc("amount"), "kind", "id").limit(20)


@q(
    "so10_top_and_others",
    "SELECT CASE WHEN rn <= 3 THEN component ELSE 'others' END AS component, sum(n)::BIGINT AS n FROM (SELECT component, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, component) AS rn FROM parts GROUP BY 1) GROUP BY 1",
    "parts",
)
def so10(t):
    n = t.parts.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), "component").limit(3).select("component", F.lit(True).alias("top"))
    return n.join(F.broadcast(top), "component", "left").groupBy(F.when(F.col("top"), F.col("component")).otherwise("others").alias("component")).agg(F.sum("n").alias("n"))


@q("se01_union_distinct", "SELECT actor_id AS id FROM evidence WHERE bucket = 'radar' UNION SELECT actor_id FROM actors WHERE active", "evidence actors")
def se01(t):
    return t.evidence.where("bucket = 'radar'").select(F.col("actor_id").alias("id")).union(t.actors.where("active").select("actor_id")).distinct()


@q("se02_union_all_counts", "SELECT sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM evidence WHERE verbatim UNION ALL SELECT count(*) FROM offers)", "evidence offers")
def se02(t):
    a = t.evidence.where("verbatim").agg(F.count(F.lit(1)).alias("n"))
    return a.unionAll(t.offers.agg(F.count(F.lit(1)).alias("n"))).agg(F.sum("n").alias("n"))


@q(
    "se03_corpus_union",
    """SELECT 'document' AS kind, doc_id AS id, lang, source, NULL::VARCHAR AS url FROM documents UNION ALL SELECT 'page', page_id, NULL, NULL, url FROM pages""",
)
def se03(t):
    d = t.table("documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "lang", "source")
    p = t.table("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url")
    return d.unionByName(p, allowMissingColumns=True)


@q("se04_set_union", "SELECT user_id, list_sort(list_distinct(list(event_type) FILTER (WHERE value > 20) || list(event_type) FILTER (WHERE value < 5))) AS kinds FROM runs GROUP BY 1 HAVING count(*) FILTER (WHERE value > 20) > 0 AND count(*) FILTER (WHERE value < 5) > 0", "runs")
def se04(t):
    some = lambda c: F.collect_set(F.when(c, F.col("event_type")))
    g = t.runs.groupBy("user_id").agg(some(F.col("value") > 20).alias("a"), some(F.col("value") < 5).alias("b")).where("size(a) > 0 AND size(b) > 0")
    return g.select("user_id", F.array_sort(F.array_union("a", "b")).alias("kinds"))


@q("se05_set_difference", "SELECT user_id, list_sort(list_filter(list(DISTINCT event_type), lambda x: NOT list_contains(coalesce(list(DISTINCT event_type) FILTER (WHERE value < 2), []), x))) AS missing FROM runs GROUP BY 1", "runs")
def se05(t):
    g = t.runs.groupBy("user_id").agg(F.collect_set("event_type").alias("a"), F.collect_set(F.when(F.col("value") < 2, F.col("event_type"))).alias("b"))
    return g.select("user_id", F.array_sort(F.array_except("a", "b")).alias("missing"))


@q(
    "se06_symmetric_tokens",
    "SELECT x.part_id AS a, y.part_id AS b FROM parts x JOIN parts y ON list_sort(string_split(x.label, ' ')) = list_sort(string_split(y.label, ' ')) AND x.part_id < y.part_id AND x.size = y.size AND x.component = y.component",
    "parts",
)
def se06(t):
    p = t.parts.select("part_id", "size", "component", F.array_join(F.array_sort(F.split("label", " ")), " ").alias("k"))
    return p.withColumnRenamed("part_id", "a").join(p.withColumnRenamed("part_id", "b"), ["k", "size", "component"]).where("a < b").select("a", "b")


@q(
    "se07_entry_kinds",
    "SELECT kind, count(*) AS n FROM (SELECT 'offer' AS kind FROM offers UNION ALL SELECT 'part' FROM parts UNION ALL SELECT 'buyer' FROM buyers) GROUP BY 1",
    "offers parts buyers",
)
def se07(t):
    kind = lambda df, k: df.select(F.lit(k).alias("kind"))
    return kind(t.offers, "offer").unionByName(kind(t.parts, "part")).unionByName(kind(t.buyers, "buyer")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
