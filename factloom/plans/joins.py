"""Joins of the engine on the landed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import joins as J

from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query


@q("jn01_inner_proofs", "SELECT a.class, count(*) AS n, count(DISTINCT e.actor_id) AS actors FROM evidence e JOIN actors a USING (actor_id) GROUP BY a.class", "evidence actors")
def jn01(t):
    return t.evidence.join(t.actors, "actor_id").groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("actor_id").alias("actors"))


@q(
    "jn02_left_star",
    """SELECT b.buyer_id, b.segment, n.n_name AS nation, r.r_name AS region, o.offers FROM buyers b
    LEFT JOIN nation n ON n.n_nationkey = b.nation_id LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
    LEFT JOIN (SELECT o_custkey, count(*) AS offers FROM orders GROUP BY 1) o ON o.o_custkey = b.buyer_id""",
    "buyers",
)
def jn02(t):
    b, n, r = t.buyers, t.table("nation"), t.table("region")
    o = t.offers.groupBy("buyer_id").agg(F.count(F.lit(1)).alias("offers"))
    return b.join(n, b.nation_id == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").join(o, "buyer_id", "left").select("buyer_id", "segment", F.col("n_name").alias("nation"), F.col("r_name").alias("region"), "offers")


@q(
    "jn03_market_matrix",
    """SELECT o.offer_id, o.review_status, count(e.evidence_id) AS proofs, count(DISTINCT coalesce(e.lang, 'unknown')) AS languages
    FROM offers o LEFT JOIN evidence e ON e.offer_id = o.offer_id GROUP BY o.offer_id, o.review_status""",
    "offers evidence",
)
def jn03(t):
    return J.count_children(t.offers.select("offer_id", "review_status"), t.evidence.select("offer_id", "evidence_id", "lang"), "offer_id", proofs=F.count("evidence_id"), languages=F.countDistinct(F.coalesce("lang", F.lit("unknown"))))


@q(
    "jn04_left_on_predicate",
    "SELECT o.offer_id, count(e.evidence_id) AS existing FROM offers o LEFT JOIN evidence e ON e.offer_id = o.offer_id AND e.bucket = 'existing' AND e.verbatim GROUP BY o.offer_id",
    "offers evidence",
)
def jn04(t):
    e = t.evidence.where("bucket = 'existing' AND verbatim").select("offer_id", "evidence_id")
    return t.offers.select("offer_id").join(e, "offer_id", "left").groupBy("offer_id").agg(F.count("evidence_id").alias("existing"))


@q(
    "jn05_left_aggregated",
    "SELECT a.actor_id, m.last AS last_seen, coalesce(m.last < DATE '2001-06-01', true) AS stale FROM actors a LEFT JOIN (SELECT actor_id, max(created) AS last FROM evidence WHERE status = 'validated' GROUP BY 1) m USING (actor_id)",
    "actors evidence",
)
def jn05(t):
    last = t.evidence.where("status = 'validated'").groupBy("actor_id").agg(F.max("created").alias("last_seen"))
    return t.actors.select("actor_id").join(last, "actor_id", "left").withColumn("stale", F.coalesce(F.col("last_seen") < F.lit("2001-06-01").cast("date"), F.lit(True)))


@q(
    "jn06_self_join",
    """SELECT x.evidence_id, count(*) AS siblings, max(y.amount) AS most FROM evidence x JOIN evidence y ON x.actor_id = y.actor_id AND x.part_id = y.part_id
    WHERE x.quantity >= 45 AND x.status = 'review' GROUP BY x.evidence_id""",
    "evidence",
)
def jn06(t):
    e = t.evidence
    y = e.select("actor_id", "part_id", F.col("amount").alias("other"))
    return e.where("quantity >= 45 AND status = 'review'").select("evidence_id", "actor_id", "part_id").join(y, ["actor_id", "part_id"]).groupBy("evidence_id").agg(F.count(F.lit(1)).alias("siblings"), F.max("other").alias("most"))


@q(
    "jn07_normalised_key",
    """WITH x AS (SELECT actor_id, CASE actor_id % 3 WHEN 0 THEN 'https://doi.org/10.1/A' WHEN 1 THEN 'http://dx.doi.org/10.1/a' ELSE '10.1/A' END || actor_id::VARCHAR AS doi FROM actors),
    y AS (SELECT actor_id AS doc_id, '10.1/a' || actor_id::VARCHAR AS doi FROM actors)
    SELECT x.actor_id, y.doc_id FROM x JOIN y ON lower(regexp_replace(x.doi, '^https?://(dx\\.)?doi\\.org/', '', 'i')) = lower(regexp_replace(y.doi, '^https?://(dx\\.)?doi\\.org/', '', 'i'))""",
    "actors",
)
def jn07(t):
    from factloom.functions.text import doi

    k = F.col("actor_id").cast("string")
    x = t.actors.select("actor_id", F.concat(F.when(F.col("actor_id") % 3 == 0, "https://doi.org/10.1/A").when(F.col("actor_id") % 3 == 1, "http://dx.doi.org/10.1/a").otherwise("10.1/A"), k).alias("d"))
    y = t.actors.select(F.col("actor_id").alias("doc_id"), doi(F.concat(F.lit("10.1/a"), k)).alias("d"))
    return x.withColumn("d", doi(F.col("d"))).join(y, "d").select("actor_id", "doc_id")


@q(
    "jn08_correlated_counts",
    """SELECT o.offer_id, (SELECT count(*) FROM evidence e WHERE e.offer_id = o.offer_id) AS proofs,
    (SELECT count(DISTINCT coalesce(e.lang, 'unknown')) FROM evidence e WHERE e.offer_id = o.offer_id) AS languages FROM offers o""",
    "offers evidence",
)
def jn08(t):
    e = t.evidence.groupBy("offer_id").agg(F.count(F.lit(1)).alias("proofs"), F.countDistinct(F.coalesce("lang", F.lit("unknown"))).alias("languages"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.offers.select("offer_id").join(e, "offer_id", "left").select("offer_id", zero("proofs"), zero("languages"))


@q(
    "jn09_top_one_default",
    """SELECT o.offer_id, coalesce((SELECT e.date_confidence FROM evidence e WHERE e.offer_id = o.offer_id ORDER BY e.evidence_id, e.date_confidence LIMIT 1), 'unknown') AS date_confidence FROM offers o""",
    "offers evidence",
)
def jn09(t):
    return J.top_one(t.offers.select("offer_id"), t.evidence.select("offer_id", "date_confidence", F.struct("evidence_id", "date_confidence").alias("k")), "offer_id", "date_confidence", "k", "unknown")


@q("jn10_semi_probe", "SELECT p.part_id, p.market FROM parts p WHERE EXISTS (SELECT 1 FROM evidence e WHERE e.part_id = p.part_id AND e.bucket = 'radar')", "parts evidence")
def jn10(t):
    return t.parts.select("part_id", "market").join(t.evidence.where("bucket = 'radar'").select("part_id"), "part_id", "left_semi")


@q("jn11_anti_probe", "SELECT offer_id, price FROM offers o WHERE NOT EXISTS (SELECT 1 FROM evidence e WHERE e.offer_id = o.offer_id)", "offers evidence")
def jn11(t):
    return t.offers.select("offer_id", "price").join(t.evidence.select("offer_id"), "offer_id", "left_anti")


@q(
    "jn12_membership_flags",
    """SELECT actor_id, actor_id IN (SELECT actor_id FROM evidence WHERE amount > 100000) AS confirmed, actor_id IN (SELECT actor_id FROM evidence WHERE quantity < 2 AND bucket = 'pending') AS watched FROM actors""",
    "actors evidence",
)
def jn12(t):
    flag = lambda cond, name: t.evidence.where(cond).select("actor_id").distinct().withColumn(name, F.lit(True))
    out = t.actors.select("actor_id").join(flag("amount > 100000", "confirmed"), "actor_id", "left").join(flag("quantity < 2 AND bucket = 'pending'", "watched"), "actor_id", "left")
    return out.na.fill(False)


@q("jn13_orphans", "SELECT e.evidence_id, e.offer_id FROM evidence e ANTI JOIN (SELECT * FROM offers WHERE review_status <> 'rejected') o ON o.offer_id = e.offer_id", "evidence offers")
def jn13(t):
    return t.evidence.select("evidence_id", "offer_id").join(t.offers.where("review_status <> 'rejected'").select("offer_id"), "offer_id", "left_anti").select("evidence_id", "offer_id")


@q("jn14_lookup", "SELECT a.class, e.bucket, count(*) AS n FROM evidence e LEFT JOIN actors a USING (actor_id) GROUP BY 1, 2", "evidence actors")
def jn14(t):
    return t.evidence.join(J.small(t.actors.select("actor_id", "class")), "actor_id", "left").groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))


_CELLS = "cells AS (SELECT DISTINCT m.market, c.component, b.bucket FROM (SELECT DISTINCT market FROM parts WHERE market IS NOT NULL) m, (SELECT DISTINCT component FROM parts) c, (SELECT 'existing' AS bucket UNION ALL SELECT 'radar') b)"


@q(
    "jn15_reference_matrix",
    f"""WITH {_CELLS}, f AS (SELECT p.market, p.component, e.bucket, count(*) AS n FROM evidence e JOIN parts p USING (part_id) WHERE e.status = 'validated' GROUP BY ALL)
    SELECT c.market, c.component, c.bucket, coalesce(f.n, 0) AS n, f.n IS NOT NULL AS covered FROM cells c LEFT JOIN f USING (market, component, bucket)""",
    "parts evidence",
)
def jn15(t):
    p = t.parts.select("part_id", "market", "component")
    markets, components = p.select("market").where("market IS NOT NULL").distinct(), p.select("component").distinct()
    # the declared matrix: a product of two short vocabularies, not of facts
    cells = markets.withColumn("j", F.lit(1)).join(components.withColumn("j", F.lit(1)), "j").drop("j").withColumn("bucket", F.explode(F.array(F.lit("existing"), F.lit("radar"))))
    f = t.evidence.where("status = 'validated'").join(p, "part_id").groupBy("market", "component", "bucket").agg(F.count(F.lit(1)).alias("n"))
    out = cells.join(f, ["market", "component", "bucket"], "left")
    return out.select("market", "component", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("covered"))


_WORDS = "' ' || array_to_string(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' '"


@q(
    "jn16_phrase_theta",
    f"""WITH a AS (SELECT min(item_id) AS alias_id, w AS alias FROM (SELECT item_id, unnest(list_slice(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), 3, 5)) AS w FROM benchmark) WHERE length(w) >= 5 GROUP BY w)
    SELECT a.alias_id, count(DISTINCT d.doc_id) AS documents FROM documents d JOIN a ON contains({_WORDS.format("d.text")}, ' ' || a.alias || ' ') GROUP BY a.alias_id""",
)
def jn16(t):
    words = F.slice(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), 3, 3)
    aliases = t.table("benchmark").select("item_id", F.explode(words).alias("alias")).where("length(alias) >= 5").groupBy("alias").agg(F.min("item_id").alias("alias_id"))
    return J.phrase_pairs(t.table("documents"), aliases, "doc_id", "text", "alias_id", "alias").groupBy("alias_id").agg(F.countDistinct("doc_id").alias("documents"))


@q(
    "jn17_alias_whole_word",
    f"""WITH a AS (SELECT item_id, array_to_string(list_slice(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), 1, 4), ' ') AS alias FROM benchmark)
    SELECT DISTINCT d.doc_id, a.item_id FROM documents d JOIN a ON contains({_WORDS.format("d.text")}, ' ' || a.alias || ' ') WHERE a.alias <> ''""",
)
def jn17(t):
    first = F.slice(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), 1, 4)
    return J.phrase_pairs(t.table("documents"), t.table("benchmark").select("item_id", F.array_join(first, " ").alias("alias")), "doc_id", "text", "item_id", "alias")


@q(
    "jn18_duplicate_candidates",
    """WITH k AS (SELECT actor_id, 'balance' AS reason, CAST(CAST(floor(balance / 50) AS BIGINT) AS VARCHAR) AS key FROM actors UNION ALL SELECT actor_id, 'country_parent', country || '|' || parent FROM actors WHERE parent IS NOT NULL),
    c AS (SELECT reason, key, min(actor_id) AS a FROM k GROUP BY 1, 2 HAVING count(*) > 1)
    SELECT a, actor_id AS b, list_sort(list(DISTINCT reason)) AS reasons FROM k JOIN c USING (reason, key) WHERE a < actor_id GROUP BY 1, 2""",
    "actors",
)
def jn18(t):
    return J.reasoned_pairs(t.actors, "actor_id", {"balance": F.floor(F.col("balance") / 50).cast("bigint"), "country_parent": F.concat("country", F.lit("|"), "parent")})


@q(
    "jn19_first_of_two_keys",
    """WITH r AS (SELECT part_id, label, component FROM parts WHERE size < 10), x AS (SELECT part_id AS id, label, component FROM parts WHERE size >= 10)
    SELECT x.id, coalesce((SELECT min(part_id) FROM r WHERE r.label = x.label), (SELECT min(part_id) FROM r WHERE r.component = x.component)) AS part_id FROM x""",
    "parts",
)
def jn19(t):
    p = t.parts.select("part_id", "label", "component", "size")
    return J.first_match(p.where("size >= 10").select(F.col("part_id").alias("id"), "label", "component"), p.where("size < 10"), "label", "component", "part_id", "part_id").select("id", "part_id")


@q(
    "jn20_unique_match",
    "SELECT b.buyer_id, x.actor_id FROM buyers b JOIN (SELECT n_nationkey, min(s_suppkey) AS actor_id FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000 GROUP BY 1 HAVING count(*) = 1) x ON x.n_nationkey = b.nation_id",
    "buyers",
)
def jn20(t):
    s = t.table("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation_id"), F.col("s_suppkey").alias("actor_id"))
    return J.unique_match(t.buyers.select("buyer_id", "nation_id"), s, "nation_id").select("buyer_id", "actor_id")


@q(
    "jn21_two_pass_semi",
    "SELECT e.offer_id, sum(e.quantity) AS quantity FROM evidence e WHERE e.offer_id IN (SELECT offer_id FROM offers WHERE price > 490000) GROUP BY 1",
    "evidence offers",
)
def jn21(t):
    return t.evidence.select("offer_id", "quantity").join(t.offers.where("price > 490000").select("offer_id"), "offer_id", "left_semi").groupBy("offer_id").agg(F.sum("quantity").alias("quantity"))


@q(
    "jn22_keyed_promotion",
    """WITH u AS (SELECT evidence_id, offer_id, actor_id FROM evidence ), k AS (SELECT offer_id, review_status FROM offers WHERE price > 250000)
    SELECT u.evidence_id, coalesce(k.review_status, 'unlinked') AS state, k.offer_id IS NOT NULL AND a.actor_id IS NOT NULL AS promoted
    FROM u LEFT JOIN k ON k.offer_id = u.offer_id LEFT JOIN (SELECT actor_id FROM actors WHERE active) a ON a.actor_id = u.actor_id""",
    "evidence offers actors",
)
def jn22(t):
    k = t.offers.where("price > 250000").select("offer_id", "review_status")
    a = t.actors.where("active").select("actor_id", F.lit(True).alias("known"))
    out = t.evidence.select("evidence_id", "offer_id", "actor_id").join(k, "offer_id", "left").join(a, "actor_id", "left")
    return out.select("evidence_id", F.coalesce("review_status", F.lit("unlinked")).alias("state"), (F.col("review_status").isNotNull() & F.col("known").isNotNull()).alias("promoted"))


@q(
    "jn23_provenance",
    "SELECT l.doc_id, l.quality, d.source, d.doc_id IS NOT NULL AS row_still_exists FROM labels l LEFT JOIN (SELECT doc_id, source FROM documents WHERE lang <> 'de') d ON d.doc_id = l.doc_id",
)
def jn23(t):
    d = t.table("documents").where("lang <> 'de'").select("doc_id", "source", F.lit(True).alias("there"))
    return t.table("labels").select("doc_id", "quality").join(d, "doc_id", "left").select("doc_id", "quality", "source", F.col("there").isNotNull().alias("row_still_exists"))


@q(
    "jn24_miss_cascade",
    """WITH g AS (SELECT DISTINCT actor_id, part_id, bucket FROM evidence), f AS (SELECT actor_id, part_id, bucket FROM evidence WHERE status = 'validated' AND confidence > 0.05)
    SELECT g.*, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.actor_id = g.actor_id AND f.part_id = g.part_id AND f.bucket = g.bucket) THEN 'found'
      WHEN EXISTS (SELECT 1 FROM f WHERE f.part_id = g.part_id) THEN 'same_part' ELSE 'missed' END AS verdict FROM g""",
    "evidence",
)
def jn24(t):
    e = t.evidence
    g = e.select("actor_id", "part_id", "bucket").distinct()
    f = e.where("status = 'validated' AND confidence > 0.05").select("actor_id", "part_id", "bucket").distinct()
    exact = f.withColumn("exact", F.lit(True))
    near = f.select("part_id").distinct().withColumn("near", F.lit(True))
    out = g.join(exact, ["actor_id", "part_id", "bucket"], "left").join(near, "part_id", "left")
    return out.select("actor_id", "part_id", "bucket", F.when(F.col("exact"), "found").when(F.col("near"), "same_part").otherwise("missed").alias("verdict"))


@q(
    "jn25_recall",
    """WITH w AS (SELECT doc_id, lower(text) AS t FROM documents) SELECT count(*) AS golden, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM w WHERE contains(w.t, lower(b.text)))) AS found,
    round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM w WHERE contains(w.t, lower(b.text)))) / count(*), 4) AS recall FROM benchmark b""",
)
def jn25(t):
    b = t.table("benchmark").select("item_id", F.lower("text").alias("item"))
    hit = J.contained(t.table("documents").select("doc_id", F.lower("text").alias("t")), b.select("item").distinct(), "doc_id", "t", "item").select("item").distinct().withColumn("hit", F.lit(True))
    out = b.join(hit, "item", "left").agg(F.count(F.lit(1)).alias("golden"), F.count("hit").alias("found"))
    return out.withColumn("recall", F.round(F.col("found") / F.col("golden"), 4))


@q(
    "jn26_neighbour_window",
    """SELECT conv_id, turn, list(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM conversations""",
)
def jn26(t):
    c = t.table("conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return J.neighbours(c, "conv_id", "turn", "n", 2).drop("n")


@q("jn27_thresholds", "SELECT e.actor_id, th.level FROM (SELECT actor_id, avg(quantity) AS m FROM evidence GROUP BY 1) e JOIN (VALUES ('low', 0.0, 25.0), ('mid', 25.0, 26.0), ('high', 26.0, 99.0)) th(level, lo, hi) ON e.m >= th.lo AND e.m < th.hi", "evidence")
def jn27(t):
    th = t.spark.createDataFrame([("low", 0.0, 25.0), ("mid", 25.0, 26.0), ("high", 26.0, 99.0)], "level string, lo double, hi double")
    m = t.evidence.groupBy("actor_id").agg(F.avg("quantity").alias("m"))
    return m.join(F.broadcast(th), (F.col("m") >= F.col("lo")) & (F.col("m") < F.col("hi"))).select("actor_id", "level")


@q("jn28_glossary", "SELECT d.source, g.title, count(*) AS n FROM documents d LEFT JOIN (VALUES ('src0', 'Registry'), ('src1', 'Press')) g(source, title) USING (source) GROUP BY 1, 2")
def jn28(t):
    g = t.spark.createDataFrame([("src0", "Registry"), ("src1", "Press")], "source string, title string")
    return t.table("documents").join(F.broadcast(g), "source", "left").groupBy("source", "title").agg(F.count(F.lit(1)).alias("n"))


@q(
    "jn29_label_ownership",
    "SELECT p.part_id, coalesce(o.dimension, 'component') AS dimension FROM parts p LEFT JOIN (VALUES ('ECONOMY', 'market'), ('LARGE', 'operation')) o(market, dimension) USING (market)",
    "parts",
)
def jn29(t):
    o = t.spark.createDataFrame([("ECONOMY", "market"), ("LARGE", "operation")], "market string, dimension string")
    return t.parts.join(F.broadcast(o), "market", "left").select("part_id", F.coalesce("dimension", F.lit("component")).alias("dimension"))


@q(
    "jn30_roster_first",
    """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
    x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w)
    SELECT w.doc_id, (SELECT arg_min(word, pos) FROM x WHERE x.doc_id = w.doc_id AND word IN ('the', 'der', 'les', 'que', 'of', 'un')) AS matched FROM w""",
)
def jn30(t):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))  # keeps the order of first places
    roster = t.spark.createDataFrame([(x,) for x in ("the", "der", "les", "que", "of", "un")], "word string")
    return J.first_of_roster(t.table("documents").select("doc_id", words.alias("w")), "doc_id", "w", F.broadcast(roster), "word")


@q(
    "jn31_verified_match",
    "SELECT o.offer_id, a.actor_id FROM (SELECT DISTINCT offer_id, actor_id FROM evidence WHERE bucket = 'radar') e JOIN offers o USING (offer_id) JOIN actors a USING (actor_id) WHERE o.review_status = 'validated' AND a.active AND NOT a.is_reference AND o.price > 300000",
    "offers evidence actors",
)
def jn31(t):
    e = t.evidence.where("bucket = 'radar'").select("offer_id", "actor_id").distinct()
    o = t.offers.where("review_status = 'validated' AND price > 300000").select("offer_id")
    return e.join(o, "offer_id").join(t.actors.where("active AND NOT is_reference").select("actor_id"), "actor_id").select("offer_id", "actor_id")


@q(
    "jn32_gated_partners",
    "SELECT o.offer_id, count(DISTINCT a.actor_id) AS partners FROM offers o JOIN evidence e USING (offer_id) JOIN actors a USING (actor_id) WHERE o.precedence IN (1, 2) AND a.class IN ('C1', 'T1') GROUP BY 1",
    "offers evidence actors",
)
def jn32(t):
    o = t.offers.where(F.col("precedence").isin(1, 2)).select("offer_id")
    a = t.actors.where(F.col("class").isin("C1", "T1")).select("actor_id")
    return t.evidence.select("offer_id", "actor_id").join(o, "offer_id").join(a, "actor_id").groupBy("offer_id").agg(F.countDistinct("actor_id").alias("partners"))
