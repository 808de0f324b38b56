"""Aggregations, facets and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.operators import scores as S

from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query


def one():
    return F.count(F.lit(1))



@q("ag01_global_count", "SELECT count(*) AS n FROM evidence", "evidence")
def ag01(t):
    return t.evidence.agg(one().alias("n"))


@q(
    "ag02_conditional_counters",
    "SELECT count(*) FILTER (WHERE bucket = 'existing') AS existing, count(*) FILTER (WHERE bucket = 'radar' AND verbatim) AS radar, count(*) FILTER (WHERE quantity > 999) AS none FROM evidence",
    "evidence",
)
def ag02(t):
    return A.counters(t.evidence, {"existing": F.expr("bucket = 'existing'"), "radar": F.expr("bucket = 'radar' AND verbatim"), "none": F.expr("quantity > 999")})


@q("ag03_group_count", "SELECT bucket, status, date_confidence, count(*) AS n FROM evidence GROUP BY 1, 2, 3", "evidence")
def ag03(t):
    return t.evidence.groupBy("bucket", "status", "date_confidence").agg(one().alias("n"))


@q("ag04_group_ordinal", "SELECT review_status, precedence, sum(price) AS price FROM offers GROUP BY 1, 2", "offers")
def ag04(t):
    return t.offers.groupBy("review_status", "precedence").agg(F.sum("price").alias("price"))


@q("ag05_distinct_with_null", "SELECT actor_id, count(DISTINCT coalesce(lang, 'unknown')) AS languages, count(DISTINCT lang) AS known FROM evidence GROUP BY 1", "evidence")
def ag05(t):
    return t.evidence.groupBy("actor_id").agg(F.countDistinct(F.coalesce("lang", F.lit("unknown"))).alias("languages"), F.countDistinct("lang").alias("known"))


@q("ag06_having", "SELECT part_id, count(DISTINCT actor_id) AS actors FROM evidence GROUP BY 1 HAVING count(DISTINCT actor_id) >= 30", "evidence")
def ag06(t):
    return t.evidence.groupBy("part_id").agg(F.countDistinct("actor_id").alias("actors")).where("actors >= 30")


@q("ag07_bare_column", "SELECT part_id, arg_min(bucket, struct_pack(a := evidence_id, b := bucket)) AS bucket, count(*) AS n FROM evidence GROUP BY 1", "evidence")
def ag07(t):
    return t.evidence.groupBy("part_id").agg(F.min_by("bucket", F.struct("evidence_id", "bucket")).alias("bucket"), one().alias("n"))


@q("ag08_max_per_key", "SELECT actor_id, max(created) AS last FROM evidence WHERE status = 'validated' GROUP BY 1", "evidence")
def ag08(t):
    return t.evidence.where("status = 'validated'").groupBy("actor_id").agg(F.max("created").alias("last"))


@q("ag09_coalesced_sum", "SELECT coalesce(sum(confidence), 0) AS total, coalesce(sum(confidence) FILTER (WHERE quantity > 999), 0) AS none FROM evidence", "evidence")
def ag09(t):
    return t.evidence.agg(F.coalesce(F.sum("confidence"), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(F.col("quantity") > 999, F.col("confidence"))), F.lit(0.0)).alias("none"))


@q(
    "ag10_null_ratio",
    "SELECT actor_id, CASE WHEN count(*) FILTER (WHERE quantity > 49) <> 0 THEN round(count(*) FILTER (WHERE quantity > 49 AND verbatim) / count(*) FILTER (WHERE quantity > 49), 4) END AS share FROM evidence GROUP BY 1",
    "evidence",
)
def ag10(t):
    return t.evidence.groupBy("actor_id").agg(S.ratio(F.count_if(F.expr("quantity > 49 AND verbatim")), F.count_if(F.expr("quantity > 49"))).alias("share"))


@q("ag11_median", "SELECT event_type, median(value) AS median FROM runs GROUP BY 1", "runs")
def ag11(t):
    return t.runs.groupBy("event_type").agg(F.median("value").alias("median"))


@q(
    "ag12_top_decile",
    "WITH c AS (SELECT part_id, count(*) AS n FROM evidence GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn, count(*) OVER () AS k, sum(n) OVER () AS total FROM c) SELECT round(sum(n) / max(total), 4) AS share FROM r WHERE rn <= greatest(1, round_even(k * 0.1, 0))",
    "evidence",
)
def ag12(t):
    return A.top_share(t.evidence, "part_id")


@q("ag13_distribution_map", "SELECT user_id, string_agg(event_type || '=' || n::VARCHAR, ',' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1", "runs")
def ag13(t):
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return A.distribution(t.runs, "user_id", "event_type").select("user_id", shown.alias("counts"))


@q("ag14_distinct_set_size", "SELECT market, count(DISTINCT actor_id) AS actors FROM evidence JOIN parts USING (part_id) GROUP BY 1", "evidence parts")
def ag14(t):
    return t.evidence.join(t.parts.select("part_id", "market"), "part_id").groupBy("market").agg(F.countDistinct("actor_id").alias("actors"))


@q(
    "ag15_bumped_counters",
    "SELECT actor_id, sum(f)::BIGINT AS facts, sum(v)::BIGINT AS verbatim FROM (SELECT actor_id, count(*) AS f, 0 AS v FROM evidence GROUP BY 1 UNION ALL SELECT actor_id, 0, count(*) FROM evidence WHERE verbatim GROUP BY 1 UNION ALL SELECT actor_id, 0, 0 FROM actors) GROUP BY 1",
    "evidence actors",
)
def ag15(t):
    f = t.evidence.groupBy("actor_id").agg(one().alias("f")).withColumn("v", F.lit(0).cast("bigint"))
    v = t.evidence.where("verbatim").groupBy("actor_id").agg(one().alias("v")).withColumn("f", F.lit(0).cast("bigint"))
    z = t.actors.select("actor_id", F.lit(0).cast("bigint").alias("f"), F.lit(0).cast("bigint").alias("v"))
    return f.unionByName(v).unionByName(z).groupBy("actor_id").agg(F.sum("f").alias("facts"), F.sum("v").alias("verbatim"))


@q("ag16_most_common", "SELECT component, count(*) AS n FROM parts GROUP BY 1 ORDER BY n DESC, min(part_id), component LIMIT 7", "parts")
def ag16(t):
    return A.most_common(t.parts, "component", "part_id", 7)


@q(
    "ag17_positioning",
    """SELECT market, len(list(DISTINCT e.actor_id) FILTER (WHERE bucket = 'existing')) AS confirmed, len(list(DISTINCT e.actor_id)) AS named,
    len(list_filter(list(DISTINCT e.actor_id), lambda x: NOT list_contains(coalesce(list(DISTINCT e.actor_id) FILTER (WHERE bucket = 'existing'), []), x))) AS unconfirmed FROM evidence e JOIN parts USING (part_id) GROUP BY 1""",
    "evidence parts",
)
def ag17(t):
    e = t.evidence.join(t.parts.select("part_id", "market"), "part_id")
    # a pair (market, actor) first, so that no set of actors is gathered
    pair = e.groupBy("market", "actor_id").agg(F.bool_or(F.expr("bucket = 'existing'")).alias("c"))
    return pair.groupBy("market").agg(F.count_if("c").alias("confirmed"), one().alias("named"), F.count_if(~F.col("c")).alias("unconfirmed"))


@q(
    "ag18_demand",
    """SELECT segment, count(*) AS total, count(*) FILTER (WHERE published >= DATE '2000-01-01') AS recent, string_agg(offer_id::VARCHAR, ',' ORDER BY published DESC, offer_id) FILTER (WHERE rn <= 5) AS latest
    FROM (SELECT o.*, segment, row_number() OVER (PARTITION BY segment ORDER BY published DESC, offer_id) AS rn FROM offers o JOIN buyers USING (buyer_id)) GROUP BY 1""",
    "offers buyers",
)
def ag18(t):
    from factloom.operators.windows import top_n

    o = t.offers.join(t.buyers.select("buyer_id", "segment"), "buyer_id")
    n = o.groupBy("segment").agg(one().alias("total"), F.count_if(F.col("published") >= F.lit("2000-01-01").cast("date")).alias("recent"))
    five = top_n(o, "segment", [F.desc("published"), F.col("offer_id")], 5).groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("rank", "offer_id"))).alias("l"))
    return n.join(five, "segment").select("segment", "total", "recent", F.array_join(F.transform("l", lambda x: x["offer_id"].cast("string")), ",").alias("latest"))


@q(
    "ag19_axis_trend",
    "SELECT component, count(*) AS n, count(*) FILTER (WHERE date_confidence = 'published') AS dated, count(*) FILTER (WHERE created >= DATE '2001-01-01') AS recent, count(DISTINCT actor_id) AS cited FROM evidence JOIN parts USING (part_id) GROUP BY 1 HAVING count(*) >= 5",
    "evidence parts",
)
def ag19(t):
    e = t.evidence.join(t.parts.select("part_id", "component"), "part_id")
    return e.groupBy("component").agg(one().alias("n"), F.count_if(F.col("date_confidence") == "published").alias("dated"), F.count_if(F.col("created") >= F.lit("2001-01-01").cast("date")).alias("recent"), F.countDistinct("actor_id").alias("cited")).where("n >= 5")


@q("ag20_movements", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM runs WHERE day >= DATE '2024-01-15' AND event_type <> 'view' GROUP BY 1", "runs")
def ag20(t):
    return t.runs.where("day >= DATE '2024-01-15' AND event_type <> 'view'").groupBy("event_type").agg(one().alias("n"), F.countDistinct("user_id").alias("users"))


@q("ag21_perimeter", "SELECT class, country, count(*) AS n FROM actors WHERE active GROUP BY 1, 2", "actors")
def ag21(t):
    return t.actors.where("active").groupBy("class", "country").agg(one().alias("n"))


@q(
    "ag22_gap_rules",
    "SELECT array_to_string(list_filter([CASE WHEN count(*) FILTER (WHERE verbatim) / count(*) < 0.5 THEN 'verbatim' END, CASE WHEN count(*) FILTER (WHERE date_confidence = 'published') / count(*) < 0.3 THEN 'dates' END, CASE WHEN count(confidence) / count(*) < 0.1 THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS gaps FROM evidence",
    "evidence",
)
def ag22(t):
    share = lambda c: F.count_if(c) / one()
    rules = F.array(F.when(share(F.col("verbatim")) < 0.5, "verbatim"), F.when(share(F.col("date_confidence") == "published") < 0.3, "dates"), F.when(share(F.col("confidence").isNotNull()) < 0.1, "confidence"))
    return t.evidence.agg(F.array_join(F.array_compact(rules), ",").alias("gaps"))


@q(
    "ag23_term_scoreboard",
    "SELECT term, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0) AS rejected FROM (SELECT DISTINCT d.doc_id, l.quality, unnest(string_split(lower(text), ' ')) AS term FROM documents d JOIN labels l USING (doc_id) WHERE quality IN (0, 1)) GROUP BY 1",
)
def ag23(t):
    labels = t.table("labels").where("quality IN (0, 1)").select("doc_id", "quality")
    d = t.table("documents").join(labels, "doc_id").select("doc_id", "quality", F.explode(F.array_distinct(F.split(F.lower("text"), " "))).alias("term")).distinct()
    return d.groupBy("term").agg(F.count_if(F.col("quality") == 1).alias("accepted"), F.count_if(F.col("quality") == 0).alias("rejected"))


@q("ag24_tally", "SELECT coalesce(lang, 'unspecified') AS lang, count(*) AS n FROM evidence GROUP BY 1", "evidence")
def ag24(t):
    return t.evidence.groupBy(F.coalesce("lang", F.lit("unspecified")).alias("lang")).agg(one().alias("n"))


@q("ag25_rejection_rate", "SELECT d.source, count(*) AS reviewed, count(*) FILTER (WHERE quality = 0) AS rejected, round(count(*) FILTER (WHERE quality = 0) / count(*), 4) AS rate FROM labels JOIN documents d USING (doc_id) GROUP BY 1")
def ag25(t):
    j = t.table("labels").join(t.table("documents").select("doc_id", "source"), "doc_id")
    n = F.count_if(F.col("quality") == 0)
    return j.groupBy("source").agg(one().alias("reviewed"), n.alias("rejected"), S.ratio(n, one()).alias("rate"))


@q(
    "ag26_white_space",
    """WITH c AS (SELECT m.market, k.component FROM (SELECT DISTINCT market FROM parts WHERE market IS NOT NULL) m, (SELECT DISTINCT component FROM parts) k), f AS (SELECT DISTINCT market, component FROM parts WHERE size > 45)
    SELECT count(*) AS cells, count(f.market) AS covered, round(count(f.market) / count(*), 4) AS rate FROM c LEFT JOIN f USING (market, component)""",
    "parts",
)
def ag26(t):
    p = t.parts
    cells = p.select("market").where("market IS NOT NULL").distinct().withColumn("j", F.lit(1)).join(p.select("component").distinct().withColumn("j", F.lit(1)), "j").drop("j")
    f = p.where("size > 45").select("market", "component").distinct().withColumn("hit", F.lit(1))
    return cells.join(f, ["market", "component"], "left").agg(one().alias("cells"), F.count("hit").alias("covered"), S.ratio(F.count("hit"), one()).alias("rate"))


@q(
    "ag27_funnel",
    "SELECT count(DISTINCT part_id) AS seen, count(DISTINCT part_id) FILTER (WHERE verbatim) AS quoted, count(DISTINCT part_id) FILTER (WHERE verbatim AND status = 'validated' AND quantity > 40) AS kept FROM evidence",
    "evidence",
)
def ag27(t):
    d = lambda c: F.countDistinct(F.when(F.expr(c), F.col("part_id")))
    return t.evidence.agg(F.countDistinct("part_id").alias("seen"), d("verbatim").alias("quoted"), d("verbatim AND status = 'validated' AND quantity > 40").alias("kept"))


@q(
    "ag28_health",
    """WITH e AS (SELECT user_id, json_extract(props, '$.k')::BIGINT % 5 AS code, count(*) AS n FROM runs WHERE event_type = 'error' GROUP BY 1, 2), t AS (SELECT user_id, arg_max(code, struct_pack(a := n, b := -code)) AS top_code FROM e GROUP BY 1)
    SELECT r.user_id, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 4) AS error_rate, any_value(top_code) AS top_code FROM runs r LEFT JOIN t USING (user_id) GROUP BY 1""",
    "runs",
)
def ag28(t):
    code = F.get_json_object("props", "$.k").cast("bigint") % 5
    e = t.runs.where("event_type = 'error'").groupBy("user_id", code.alias("code")).agg(one().alias("n"))
    top = e.groupBy("user_id").agg(F.max_by("code", F.struct("n", -F.col("code"))).alias("top_code"))
    rate = t.runs.groupBy("user_id").agg(S.ratio(F.count_if(F.col("event_type") == "error"), one()).alias("error_rate"))
    return rate.join(top, "user_id", "left")


@q(
    "ag29_merge_group",
    """SELECT buyer_id, arg_min(offer_id, struct_pack(a := precedence, b := offer_id)) AS representative, max(CASE WHEN review_status = 'validated' THEN 1 ELSE 0 END) = 1 AS any_validated,
    list_sort(list(DISTINCT review_status)) AS statuses, count(*) AS merged FROM offers GROUP BY 1""",
    "offers",
)
def ag29(t):
    return t.offers.groupBy("buyer_id").agg(F.min_by("offer_id", F.struct("precedence", "offer_id")).alias("representative"), F.bool_or(F.col("review_status") == "validated").alias("any_validated"), F.array_sort(F.collect_set("review_status")).alias("statuses"), one().alias("merged"))


@q("ag30_union_cardinality", "SELECT o.buyer_id, count(DISTINCT e.part_id) AS proofs FROM offers o JOIN evidence e USING (offer_id) GROUP BY 1", "offers evidence")
def ag30(t):
    return t.offers.select("offer_id", "buyer_id").join(t.evidence.select("offer_id", "part_id"), "offer_id").groupBy("buyer_id").agg(F.countDistinct("part_id").alias("proofs"))


_FACETS = {"market": ["ECONOMY", "LARGE"], "component": ["Brand#2", "Brand#7", "Brand#17"], "size": []}


def _groups():
    return {"market": F.array_compact(F.array("market")), "component": F.array("component"), "size": F.array(F.when(F.col("size") > 25, "big").otherwise("small"))}


@q(
    "ag31_disjunctive_facets",
    """WITH p AS (SELECT part_id, market, component, CASE WHEN size > 25 THEN 'big' ELSE 'small' END AS size, coalesce(market IN ('ECONOMY', 'LARGE'), false) AS m, component IN ('Brand#2', 'Brand#7', 'Brand#17') AS c FROM parts)
    SELECT 'market' AS facet, market AS value, count(*) FILTER (WHERE c) AS n FROM p WHERE market IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'component', component, count(*) FILTER (WHERE m) FROM p GROUP BY 2 UNION ALL SELECT 'size', size, count(*) FILTER (WHERE m AND c) FROM p GROUP BY 2""",
    "parts",
)
def ag31(t):
    return A.facet_options(t.parts, _groups(), _FACETS, "part_id")


@q("flt11_facet_filter", "SELECT part_id FROM parts WHERE market IN ('ECONOMY', 'LARGE') AND component IN ('Brand#2', 'Brand#7', 'Brand#17') AND contains(lower(label), 'ring')", "parts")
def flt11(t):
    return A.facet_filter(t.parts, _groups(), _FACETS, F.col("label"), "RING").select("part_id")


@q("ag32_two_level_groups", "SELECT market, component, count(*) AS n, count(*) FILTER (WHERE size < 5) AS orphans FROM parts WHERE market IS NOT NULL GROUP BY 1, 2", "parts")
def ag32(t):
    return t.parts.where("market IS NOT NULL").groupBy("market", "component").agg(one().alias("n"), F.count_if(F.col("size") < 5).alias("orphans"))


@q("ag33_buyer_map", "SELECT segment, count(*) AS offers, count(DISTINCT buyer_id) AS buyers, list_sort(list(DISTINCT review_status)) AS statuses FROM offers JOIN buyers USING (buyer_id) GROUP BY 1", "offers buyers")
def ag33(t):
    return t.offers.join(t.buyers.select("buyer_id", "segment"), "buyer_id").groupBy("segment").agg(one().alias("offers"), F.countDistinct("buyer_id").alias("buyers"), F.array_sort(F.collect_set("review_status")).alias("statuses"))


@q(
    "ag34_offer_trends",
    "WITH v AS (SELECT actor_id, count(*) AS n FROM evidence WHERE bucket = 'existing' GROUP BY 1) SELECT (SELECT sum(n) FROM (SELECT n FROM v ORDER BY n DESC, actor_id LIMIT 3))::BIGINT AS top3, sum(n)::BIGINT AS total, count(*) AS actors FROM v",
    "evidence",
)
def ag34(t):
    v = t.evidence.where("bucket = 'existing'").groupBy("actor_id").agg(one().alias("n"))
    top = v.orderBy(F.desc("n"), "actor_id").limit(3).agg(F.sum("n").alias("top3"))
    return v.agg(F.sum("n").alias("total"), one().alias("actors")).join(F.broadcast(top)).select("top3", "total", "actors")


@q(
    "ag35_acceleration",
    "SELECT component, round(count(*) FILTER (WHERE year(created) >= 1999) / count(*), 4) AS acceleration, count(*) AS n FROM evidence JOIN parts USING (part_id) GROUP BY 1 HAVING count(*) >= 8",
    "evidence parts",
)
def ag35(t):
    e = t.evidence.join(t.parts.select("part_id", "component"), "part_id")
    return e.groupBy("component").agg(S.ratio(F.count_if(F.year("created") >= 1999), one()).alias("acceleration"), one().alias("n")).where("n >= 8")


@q(
    "ag36_exclusive_labels",
    "SELECT actor_id || '-' || part_id AS label, count(*) AS n, count(*) FILTER (WHERE status = 'review') = 0 AS validated_only FROM evidence GROUP BY 1 HAVING count(*) >= 2 AND (count(*) FILTER (WHERE status = 'validated') = 0 OR count(*) FILTER (WHERE status = 'review') = 0)",
    "evidence",
)
def ag36(t):
    label = F.concat_ws("-", F.col("actor_id").cast("string"), F.col("part_id").cast("string"))
    g = t.evidence.groupBy(label.alias("label")).agg(one().alias("n"), F.count_if(F.col("status") == "validated").alias("a"), F.count_if(F.col("status") == "review").alias("b"))
    return g.where("n >= 2 AND (a = 0 OR b = 0)").select("label", "n", (F.col("b") == 0).alias("validated_only"))


@q(
    "ag37_dominant_currency",
    "WITH s AS (SELECT segment, review_status AS currency, sum(price) AS total, count(*) AS n FROM offers JOIN buyers USING (buyer_id) GROUP BY 1, 2) SELECT segment, arg_max(currency, struct_pack(a := n, b := currency)) AS currency, arg_max(round(total, 2), struct_pack(a := n, b := currency)) AS total FROM s GROUP BY 1",
    "offers buyers",
)
def ag37(t):
    s = t.offers.join(t.buyers.select("buyer_id", "segment"), "buyer_id").groupBy("segment", F.col("review_status").alias("currency")).agg(F.sum("price").alias("total"), one().alias("n"))
    top = F.max_by(F.struct("currency", F.round("total", 2).alias("total")), F.struct("n", "currency"))
    return s.groupBy("segment").agg(top.alias("x")).select("segment", "x.currency", "x.total")


@q("ag38_year_histogram", "SELECT year(published)::INT AS year, count(*) AS n FROM offers GROUP BY 1", "offers")
def ag38(t):
    return t.offers.groupBy(F.year("published").alias("year")).agg(one().alias("n"))


@q("ag39_coverage_reason", "SELECT CASE WHEN NOT active THEN 'inactive' WHEN parent IS NULL THEN 'no_parent' WHEN class = '' THEN 'no_class' ELSE 'covered' END AS reason, count(*) AS n FROM actors GROUP BY 1", "actors")
def ag39(t):
    reason = F.when(~F.col("active"), "inactive").when(F.col("parent").isNull(), "no_parent").when(F.col("class") == "", "no_class").otherwise("covered")
    return t.actors.groupBy(reason.alias("reason")).agg(one().alias("n"))


@q("ag40_singleton_cells", "SELECT part_id, bucket, strftime(created, '%Y-%m') AS period, min(actor_id) AS actor_id FROM evidence GROUP BY 1, 2, 3 HAVING count(DISTINCT actor_id) = 1", "evidence")
def ag40(t):
    return t.evidence.groupBy("part_id", "bucket", F.date_format("created", "yyyy-MM").alias("period")).agg(F.countDistinct("actor_id").alias("k"), F.min("actor_id").alias("actor_id")).where("k = 1").drop("k")


@q("ag41_activity_ranking", "SELECT a.actor_id, a.name, count(*) AS n FROM evidence JOIN actors a USING (actor_id) WHERE class <> 'T1' AND bucket <> 'pending' GROUP BY 1, 2 ORDER BY n DESC, a.actor_id LIMIT 5", "evidence actors")
def ag41(t):
    a = t.actors.where("class <> 'T1'").select("actor_id", "name")
    return t.evidence.where("bucket <> 'pending'").join(a, "actor_id").groupBy("actor_id", "name").agg(one().alias("n")).orderBy(F.desc("n"), "actor_id").limit(5)


@q("ag42_facet_coverage", "SELECT avg(CASE WHEN market IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.2 AS market, avg(CASE WHEN size > 45 THEN 1.0 ELSE 0.0 END) >= 0.2 AS large FROM parts", "parts")
def ag42(t):
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0)) >= 0.2
    return t.parts.agg(share(F.col("market").isNotNull()).alias("market"), share(F.col("size") > 45).alias("large"))


@q("ag43_row_deduped", "SELECT w, count(*) AS n FROM (SELECT DISTINCT part_id, unnest(string_split(label, ' ')) AS w FROM parts) GROUP BY 1", "parts")
def ag43(t):
    return t.parts.select(F.explode(F.array_distinct(F.split("label", " "))).alias("w")).groupBy("w").agg(one().alias("n"))


@q("ag44_extremes", "SELECT event_type, max(value) AS best, arg_max(event_id, struct_pack(a := value, b := event_id)) AS source, arg_min(event_id, struct_pack(a := value, b := event_id)) AS least_source FROM runs GROUP BY 1", "runs")
def ag44(t):
    return t.runs.groupBy("event_type").agg(F.max("value").alias("best"), F.max_by("event_id", F.struct("value", "event_id")).alias("source"), F.min_by("event_id", F.struct("value", "event_id")).alias("least_source"))


@q("ag45_all_or_nothing", "SELECT offer_id, CASE WHEN count(*) = count(confidence) THEN round(sum(confidence), 6) END AS total FROM evidence GROUP BY 1", "evidence")
def ag45(t):
    return t.evidence.groupBy("offer_id").agg(F.round(A.all_or_nothing(F.col("confidence")), 6).alias("total"))


@q("ag46_earliest", "SELECT user_id, min(day) AS first_day FROM runs WHERE event_type = 'purchase' GROUP BY 1", "runs")
def ag46(t):
    return t.runs.where("event_type = 'purchase'").groupBy("user_id").agg(F.array_min(F.collect_set("day")).alias("first_day"))


@q("ag47_independence", "SELECT part_id, count(DISTINCT date_confidence) AS score FROM evidence GROUP BY 1", "evidence")
def ag47(t):
    return t.evidence.groupBy("part_id").agg(F.countDistinct("date_confidence").alias("score"))


@q(
    "ag48_page_coverage",
    """WITH k AS (SELECT unnest(['click', 'view', 'refund']) AS kind), u AS (SELECT DISTINCT user_id FROM runs), g AS (SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value > 30) AS ok FROM runs GROUP BY 1, 2)
    SELECT u.user_id, k.kind, CASE WHEN g.n IS NULL THEN 'missing' WHEN g.ok > 0 THEN 'ready' ELSE 'pending' END AS status FROM u, k LEFT JOIN g ON g.user_id = u.user_id AND g.event_type = k.kind""",
    "runs",
)
def ag48(t):
    want = t.runs.select("user_id").distinct().withColumn("kind", F.explode(F.array(*map(F.lit, ("click", "view", "refund")))))
    g = t.runs.groupBy("user_id", F.col("event_type").alias("kind")).agg(one().alias("n"), F.count_if(F.col("value") > 30).alias("ok"))
    return want.join(g, ["user_id", "kind"], "left").select("user_id", "kind", F.when(F.col("n").isNull(), "missing").when(F.col("ok") > 0, "ready").otherwise("pending").alias("status"))


@q("ag49_offers_coverage", "SELECT a.actor_id, count(e.evidence_id) FILTER (WHERE bucket = 'existing') AS existing, count(DISTINCT e.part_id) AS parts FROM actors a LEFT JOIN evidence e ON e.actor_id = a.actor_id GROUP BY 1", "actors evidence")
def ag49(t):
    e = t.evidence.select("actor_id", "evidence_id", "bucket", "part_id")
    return t.actors.select("actor_id").join(e, "actor_id", "left").groupBy("actor_id").agg(F.count(F.when(F.col("bucket") == "existing", F.col("evidence_id"))).alias("existing"), F.countDistinct("part_id").alias("parts"))


@q("ag50_source_counters", "SELECT source, count(*) AS documents, count(*) FILTER (WHERE lang = 'en') AS english, count(*) FILTER (WHERE n_chars > 5000) AS long FROM documents GROUP BY 1")
def ag50(t):
    return t.table("documents").groupBy("source").agg(one().alias("documents"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 5000).alias("long"))


@q(
    "ag51_nested_collection",
    "SELECT b.buyer_id, coalesce(string_agg(o.offer_id::VARCHAR || ':' || o.review_status, ',' ORDER BY o.offer_id), '') AS offers FROM buyers b LEFT JOIN offers o USING (buyer_id) GROUP BY 1",
    "buyers offers",
)
def ag51(t):
    o = t.offers.groupBy("buyer_id").agg(F.array_sort(F.collect_list(F.struct("offer_id", "review_status"))).alias("l"))
    shown = F.array_join(F.transform("l", lambda x: F.concat(x["offer_id"].cast("string"), F.lit(":"), x["review_status"])), ",")
    return t.buyers.select("buyer_id").join(o, "buyer_id", "left").select("buyer_id", F.coalesce(shown, F.lit("")).alias("offers"))


@q("ag52_families", "SELECT family, CASE family WHEN 'small' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS place, count(*) AS n FROM (SELECT CASE WHEN size < 10 THEN 'small' WHEN size < 30 THEN 'medium' ELSE 'large' END AS family FROM parts) GROUP BY 1", "parts")
def ag52(t):
    family = F.when(F.col("size") < 10, "small").when(F.col("size") < 30, "medium").otherwise("large")
    return t.parts.groupBy(family.alias("family")).agg(one().alias("n")).withColumn("place", S.lookup(F.col("family"), {"small": 0, "medium": 1}, 2))


@q("ag53_by_class", "SELECT CASE WHEN class = '' THEN 'other' ELSE class END AS grp, count(*) AS n FROM actors GROUP BY 1", "actors")
def ag53(t):
    return t.actors.groupBy(F.when(F.col("class") == "", "other").otherwise(F.col("class")).alias("grp")).agg(one().alias("n"))


@q(
    "ag54_queue_tally",
    "SELECT source, count(*) AS n, count(l.doc_id) AS audited, CASE WHEN count(l.doc_id) > 0 THEN round(count(*) FILTER (WHERE quality = 1) / count(l.doc_id), 4) END AS precision FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1",
)
def ag54(t):
    labels = t.table("labels").select("doc_id", "quality")
    j = t.table("documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return j.groupBy("source").agg(one().alias("n"), F.count("quality").alias("audited"), S.ratio(F.count_if(F.col("quality") == 1), F.count("quality")).alias("precision"))


@q("ag55_keywise_sum", "SELECT k, sum(v)::BIGINT AS v FROM (SELECT 'existing' AS k, count(*) FILTER (WHERE bucket = 'existing') AS v FROM evidence UNION ALL SELECT 'existing', count(*) FROM parts UNION ALL SELECT 'offers', count(*) FROM offers) GROUP BY 1", "evidence parts offers")
def ag55(t):
    row = lambda df, k: df.agg(one().alias("v")).select(F.lit(k).alias("k"), "v")
    return row(t.evidence.where("bucket = 'existing'"), "existing").unionByName(row(t.parts, "existing")).unionByName(row(t.offers, "offers")).groupBy("k").agg(F.sum("v").alias("v"))


@q("ag56_decisions", "SELECT d.lang AS queue, l.toxic, l.quality AS decision, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2, 3")
def ag56(t):
    return t.table("labels").join(t.table("documents").select("doc_id", F.col("lang").alias("queue")), "doc_id").groupBy("queue", "toxic", F.col("quality").alias("decision")).agg(one().alias("n"))
