"""State folds, maintenance plans and rule matching on the landed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import state as X

from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query
CUT = "1999-01-01"
_RANK = "CASE bucket WHEN 'existing' THEN 2 WHEN 'radar' THEN 1 ELSE 0 END"

def _split(t):
    e = t.evidence.select("evidence_id", "actor_id", "part_id", "bucket", "confidence", "lang", "created", "amount")
    return e.where(F.col("created") < CUT), e.where(F.col("created") >= CUT)


_AT = ["evidence_id", "amount"]


@q(
    "st01_evidence_fold",
    f"""SELECT actor_id, part_id, arg_max(bucket, {_RANK}) AS bucket, max(confidence) AS confidence, arg_min(amount, struct_pack(a := -coalesce(confidence, -1.0), b := (created >= DATE '{CUT}')::INT, c := evidence_id, d := amount)) AS amount,
    arg_min(lang, struct_pack(b := (created >= DATE '{CUT}')::INT, c := evidence_id, d := amount)) FILTER (WHERE lang IS NOT NULL) AS lang, min(created) AS first_seen, max(created) AS last_seen FROM evidence GROUP BY 1, 2""",
    "evidence",
)
def st01(t):
    old, new = (df.withColumn("first_seen", F.col("created")).withColumn("last_seen", F.col("created")) for df in _split(t))
    return X.fold(old, new, ["actor_id", "part_id"], {"bucket": X.highest(), "amount": X.best_by("confidence"), "lang": X.keep, "first_seen": X.least, "last_seen": X.most, "confidence": X.most}, _AT)


@q(
    "st03_late_attribution",
    f"""SELECT part_id, arg_min(lang, struct_pack(b := (created >= DATE '{CUT}')::INT, c := evidence_id, d := amount)) FILTER (WHERE lang IS NOT NULL) AS lang FROM evidence GROUP BY 1""",
    "evidence",
)
def st03(t):
    return X.fold(*_split(t), ["part_id"], {"lang": X.keep}, _AT)


@q("st04_counter_fold", "SELECT part_id, count(*)::BIGINT AS times_seen FROM evidence GROUP BY 1", "evidence")
def st04(t):
    return X.fold(*(df.withColumn("times_seen", F.lit(1)) for df in _split(t)), ["part_id"], {"times_seen": X.total}, _AT)


@q("st07_union_fill", "SELECT part_id, list_sort(list_distinct(list(bucket))) AS buckets FROM evidence GROUP BY 1", "evidence")
def st07(t):
    return X.fold(*(df.withColumn("buckets", F.array("bucket")) for df in _split(t)), ["part_id"], {"buckets": X.union}, _AT)


@q(
    "st08_proof_insert",
    f"SELECT count(*) AS proofs FROM (SELECT DISTINCT actor_id, part_id FROM evidence)",
    "evidence",
)
def st08(t):
    old, new = (df.select("actor_id", "part_id").distinct() for df in _split(t))
    return X.insert_missing(old, new, ["actor_id", "part_id"]).agg(F.count(F.lit(1)).alias("proofs"))


@q(
    "st09_replace_fold",
    f"SELECT part_id, arg_max(bucket, struct_pack(b := (created >= DATE '{CUT}')::INT, c := evidence_id, d := amount)) AS bucket FROM evidence GROUP BY 1",
    "evidence",
)
def st09(t):
    return X.fold(*_split(t), ["part_id"], {"bucket": X.replace}, _AT)


@q("st10_first_appearance", "SELECT user_id, min(event_id) AS first_event FROM runs WHERE event_type = 'purchase' AND value > 30 GROUP BY 1", "runs")
def st10(t):
    return t.runs.groupBy("user_id").agg(F.min(F.when(F.expr("event_type = 'purchase' AND value > 30"), F.col("event_id"))).alias("first_event")).where("first_event IS NOT NULL")


@q("st13_change_detection", "SELECT x.part_id FROM (SELECT part_id, md5(concat_ws('|', market, size::VARCHAR)) AS h, md5(concat_ws('|', market, (size - size % 2)::VARCHAR)) AS last FROM parts) x WHERE h <> last", "parts")
def st13(t):
    h = lambda s: F.md5(F.concat_ws("|", "market", s.cast("string")))
    return t.parts.select("part_id", h(F.col("size")).alias("h"), h(F.col("size") - F.col("size") % 2).alias("last")).where("h <> last").select("part_id")


@q("st14_stale_backlog", "SELECT offer_id, CASE WHEN review_status = 'pending' AND published < DATE '2001-08-01' - 90 THEN 'inactive' ELSE review_status END AS state FROM offers", "offers")
def st14(t):
    old = F.col("published") < F.date_sub(F.lit("2001-08-01").cast("date"), 90)
    return X.transition(t.offers.withColumnRenamed("review_status", "state"), "state", {"pending": "inactive"}, old).select("offer_id", "state")


@q("st16_candidates", "SELECT buyer_id, count(*) AS sightings, count(DISTINCT review_status) AS independence FROM offers GROUP BY 1 HAVING count(DISTINCT review_status) >= 2", "offers")
def st16(t):
    return t.offers.groupBy("buyer_id").agg(F.count(F.lit(1)).alias("sightings"), F.countDistinct("review_status").alias("independence")).where("independence >= 2")


@q("st18_substring_dedupe", "SELECT x.label FROM (SELECT DISTINCT label FROM parts) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT label FROM parts) y WHERE y.label <> x.label AND contains(y.label, x.label))", "parts")
def st18(t):
    # a text that holds another holds its first three characters: an equi-join on those, then the exact test
    x = t.parts.select("label").distinct()
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("longer")), lambda i: F.array(*[F.substring("longer", i, F.lit(n)) for n in (1, 2, 3)])))
    y = x.withColumnRenamed("label", "longer").withColumn("w", F.explode(F.array_distinct(grams)))
    hit = x.withColumn("w", F.substring("label", 1, 3)).join(y, "w").where("longer <> label AND contains(longer, label)").select("label").distinct()
    return x.join(hit, "label", "left_anti")


@q("st23_decisions_final", "SELECT doc_id, CASE WHEN l.quality IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 'accepted' ELSE 'rejected' END ELSE 'collected' END AS state FROM documents LEFT JOIN labels l USING (doc_id)")
def st23(t):
    decided = t.table("labels").select("doc_id", F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("state"), F.lit(True).alias("reviewed"), F.lit(0).alias("n"))
    found = t.table("documents").select("doc_id", F.lit("collected").alias("state"), F.lit(False).alias("reviewed"), F.lit(1).alias("n"))
    return X.fold(decided, found, ["doc_id"], {"state": X.replace, "reviewed": X.keep}, ["n"], "reviewed").select("doc_id", "state")


@q("st24_journal_seed", "SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def st24(t):
    return t.table("documents").select("doc_id").join(t.table("labels").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("n"))


@q("st26_pruning", "SELECT e.evidence_id FROM evidence e WHERE e.status <> 'validated' AND e.quantity > 48 AND NOT EXISTS (SELECT 1 FROM offers o WHERE o.offer_id = e.offer_id AND o.review_status = 'validated')", "evidence offers")
def st26(t):
    return t.evidence.where("status <> 'validated' AND quantity > 48").join(t.offers.where("review_status = 'validated'").select("offer_id"), "offer_id", "left_anti").select("evidence_id")


@q("st27_canonical_merge", "SELECT CASE WHEN component IN ('Brand#1', 'Brand#2') THEN 'Brand#1' ELSE component END AS axis, count(*) AS n, min(part_id) AS first FROM parts GROUP BY 1", "parts")
def st27(t):
    axis = F.when(F.col("component").isin("Brand#1", "Brand#2"), "Brand#1").otherwise(F.col("component"))
    return t.parts.groupBy(axis.alias("axis")).agg(F.count(F.lit(1)).alias("n"), F.min("part_id").alias("first"))


@q("st33_guarded_transition", "SELECT offer_id, CASE WHEN price > 250000 AND review_status = 'pending' THEN 'promoted' ELSE review_status END AS state FROM offers", "offers")
def st33(t):
    return X.transition(t.offers.withColumnRenamed("review_status", "state"), "state", {"pending": "promoted"}, F.col("price") > 250000).select("offer_id", "state")


_TITLES = "SELECT regexp_extract(html, '<title>(.*?)</title>', 1) AS title, min(page_id) AS id FROM pages GROUP BY 1"


@q(
    "fn32_near_duplicate",
    f"""WITH w AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM (SELECT id, list_filter(string_split(lower(title), ' '), lambda x: x <> '') AS w FROM ({_TITLES}))),
    g AS (SELECT id, len(s) AS n, unnest(s) AS g FROM w), k AS (SELECT a.id AS a, b.id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM g a JOIN g b USING (g) WHERE a.id < b.id GROUP BY 1, 2)
    SELECT a, b FROM k WHERE k / (na + nb - k) >= 0.45""",
)
def fn32(t, least: float = 0.45):
    """Different titles of pages (each named by its first page) whose 3-word shingles overlap so far."""
    titles = t.table("pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")).groupBy("title").agg(F.min("page_id").alias("id"))
    w = titles.select("id", T.shingles(F.filter(F.split(F.lower("title"), " "), lambda x: x != "")).alias("s"))
    each = w.select("id", F.size("s").alias("n"), F.explode("s").alias("g"))
    pair = each.withColumnsRenamed({"id": "a", "n": "na"}).join(each.withColumnsRenamed({"id": "b", "n": "nb"}), "g").where("a < b")
    k = pair.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    return k.where(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")) >= least).select("a", "b")
