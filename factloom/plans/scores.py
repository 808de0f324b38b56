"""Composite scores, snapshots, health indicators, queues and dossiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.operators import scores as S

from . import aggregates as AG
from . import joins as JN
from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query
AS_OF = "2001-11-05"


def one():
    return F.count(F.lit(1))


def as_of():
    return F.lit(AS_OF).cast("date")


_CONFIDENCE = """WITH f AS (SELECT actor_id, count(*) FILTER (WHERE status = 'validated') AS v, count(*) AS n, count(*) FILTER (WHERE verbatim) AS q, count(lang) AS c, count(*) FILTER (WHERE date_confidence = 'published') AS p,
      count(*) FILTER (WHERE date_confidence <> 'unknown') AS d FROM evidence GROUP BY 1)
    SELECT actor_id, CASE WHEN v > 0 THEN round(greatest(0.0, least(100.0, 100 * (0.35 * coalesce(v / nullif(n, 0), 0) + 0.25 * coalesce(q / nullif(c, 0), 0) + 0.25 * coalesce(p / nullif(d, 0), 0) + 0.15 * active::INT))), 1) END AS confidence
    FROM f JOIN actors USING (actor_id)"""


def _confidence(t):
    f = t.evidence.groupBy("actor_id").agg(
        F.count_if(F.col("status") == "validated").alias("v"),
        one().alias("n"),
        F.count_if("verbatim").alias("q"),
        F.count("lang").alias("c"),
        F.count_if(F.col("date_confidence") == "published").alias("p"),
        F.count_if(F.col("date_confidence") != "unknown").alias("d"),
    )
    c = lambda x: F.col(x)
    score = S.confidence_score(c("v"), c("n"), c("q"), c("c"), c("p"), c("d"), F.col("active").cast("int"))
    return f.join(t.actors.select("actor_id", "active"), "actor_id").select("actor_id", score.alias("confidence"))


@q("sc01_confidence", _CONFIDENCE, "evidence actors")
def sc01(t):
    return _confidence(t)


_THREAT = f"""WITH k AS (SELECT count(DISTINCT strftime(created, '%Y-%m')) AS periods FROM evidence), f AS (SELECT actor_id, count(*) AS n, count(*) FILTER (WHERE date_diff('day', created, DATE '{AS_OF}') <= 60) AS r FROM evidence WHERE status = 'validated' AND verbatim GROUP BY 1)
    SELECT a.actor_id, CASE WHEN is_reference THEN 0.0 ELSE round(greatest(0.0, least(100.0, CASE class WHEN 'C1' THEN 55 WHEN 'C2' THEN 30 WHEN 'T1' THEN 10 ELSE 15 END + least(25.0, 1.5 * coalesce(n, 0)) + CASE WHEN periods > 1 THEN least(20.0, 4.0 * coalesce(r, 0)) ELSE 0 END - CASE WHEN active THEN 0 ELSE 15 END)), 1) END::DOUBLE AS threat
    FROM actors a CROSS JOIN k LEFT JOIN f USING (actor_id)"""


def _threat(t):
    e = t.evidence
    f = e.where("status = 'validated' AND verbatim").groupBy("actor_id").agg(one().alias("n"), F.count_if(D.whole_days(as_of(), F.col("created")) <= D.RECENT_DAYS).alias("r"))
    periods = e.agg(F.countDistinct(F.date_format("created", "yyyy-MM"))).scalar()
    zero = lambda c: F.coalesce(c, F.lit(0))
    return t.actors.join(f, "actor_id", "left").select("actor_id", S.threat_score(F.col("class"), zero("n"), zero("r"), F.col("active"), F.col("is_reference"), periods).alias("threat"))


@q("sc02_threat", _THREAT, "evidence actors")
def sc02(t):
    return _threat(t)


_INTENSITY = """WITH f AS (SELECT market, count(*) FILTER (WHERE bucket = 'existing') AS e, count(*) FILTER (WHERE bucket = 'radar') AS r, count(DISTINCT actor_id) AS a,
      count(*) FILTER (WHERE date_confidence = 'published') AS p, count(*) AS n FROM evidence JOIN parts USING (part_id) WHERE market IS NOT NULL AND verbatim AND status = 'validated' GROUP BY 1)
    SELECT market, round(greatest(0.0, least(100.0, 100 * (0.35 * least(1.0, e / 8.0) + 0.15 * least(1.0, r / 8.0) + 0.25 * least(1.0, a / 5.0) + 0.25 * coalesce(p / nullif(n, 0), 0)))), 1)::DOUBLE AS intensity"""


def _intensity(t):
    e = t.evidence.where("verbatim AND status = 'validated'").join(t.parts.where("market IS NOT NULL").select("part_id", "market"), "part_id")
    f = e.groupBy("market").agg(F.count_if(F.col("bucket") == "existing").alias("e"), F.count_if(F.col("bucket") == "radar").alias("r"), F.countDistinct("actor_id").alias("a"), F.count_if(F.col("date_confidence") == "published").alias("p"), one().alias("n"))
    return f.select("market", S.intensity_score(F.col("e"), F.col("r"), F.col("a"), F.col("p"), F.col("n")).alias("intensity"))


@q("sc03_intensity", _INTENSITY + " FROM f", "evidence parts")
def sc03(t):
    return _intensity(t)


@q("prj10_intensity_level", _INTENSITY.replace("SELECT market, round", "SELECT market, CASE WHEN x >= 55 THEN 'high' WHEN x >= 25 THEN 'medium' ELSE 'low' END AS level FROM (SELECT market, round").replace("AS intensity", "AS x FROM f)"), "evidence parts")
def prj10(t):
    return _intensity(t).select("market", S.intensity_level(F.col("intensity")).alias("level"))


@q(
    "sc04_monthly_snapshot",
    """SELECT 'actor' AS dimension, actor_id::VARCHAR AS key, strftime(created, '%Y-%m') AS period, count(*) AS facts, count(*) FILTER (WHERE status = 'validated') AS validated FROM evidence GROUP BY 1, 2, 3
    UNION ALL SELECT 'market', market, strftime(created, '%Y-%m'), count(*), count(*) FILTER (WHERE status = 'validated') FROM evidence JOIN parts USING (part_id) WHERE market IS NOT NULL GROUP BY 1, 2, 3
    UNION ALL SELECT 'maturity', bucket, strftime(created, '%Y-%m'), count(*), count(*) FILTER (WHERE status = 'validated') FROM evidence GROUP BY 1, 2, 3
    UNION ALL SELECT 'technology', component, strftime(created, '%Y-%m'), count(*), count(*) FILTER (WHERE status = 'validated') FROM evidence JOIN parts USING (part_id) GROUP BY 1, 2, 3
    UNION ALL SELECT 'signal', date_confidence, strftime(created, '%Y-%m'), count(*), count(*) FILTER (WHERE status = 'validated') FROM evidence GROUP BY 1, 2, 3""",
    "evidence parts",
)
def sc04(t):
    e = t.evidence.join(t.parts.select("part_id", "market", "component"), "part_id", "left")
    # the five dimensions in one pass: each row is counted under five keys
    keys = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).cast("string").alias("key")) for d, c in (("actor", "actor_id"), ("market", "market"), ("maturity", "bucket"), ("technology", "component"), ("signal", "date_confidence"))])
    each = e.select(F.explode(keys).alias("k"), F.date_format("created", "yyyy-MM").alias("period"), "status").where("k.key IS NOT NULL")
    return each.groupBy("k.dimension", "k.key", "period").agg(one().alias("facts"), F.count_if(F.col("status") == "validated").alias("validated"))


#: Where an indicator raises an alert.
ALERTS = [
    ("collection_yield", "below", 0.15), ("unvisited_rate", "above", 0.85), ("crawl_error_rate", "above", 0.10), ("non_verbatim_share", "above", 0.05),
    ("unreviewed_share", "above", 0.20), ("published_dates", "below", 0.30), ("latency_days", "above", 180.0), ("top_decile_share", "above", 0.50),
]
#: A visit of a page is an event: an error answers 500, any other 200; one of value below 1 was never made.
_HEALTH = """WITH v AS (SELECT CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS http, value >= 1 AS visited FROM runs),
    u AS (SELECT offer_id FROM evidence UNION SELECT offer_id FROM offers WHERE review_status = 'validated'),
    k AS (SELECT o.offer_id, count(DISTINCT e.actor_id) AS sources FROM offers o LEFT JOIN evidence e USING (offer_id) WHERE o.review_status = 'validated' GROUP BY 1),
    d AS (SELECT date_confidence = 'published' AS p FROM evidence UNION ALL SELECT precedence <= 2 FROM offers),
    l AS (SELECT date_diff('day', published, created) AS d FROM evidence JOIN offers USING (offer_id) UNION ALL SELECT date_diff('day', published, DATE '2001-08-01') FROM offers),
    c AS (SELECT count(*) AS n FROM evidence GROUP BY offer_id UNION ALL SELECT count(*) FROM offers GROUP BY buyer_id),
    r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS k, count(*) OVER () AS m FROM c),
    x AS (SELECT (SELECT round((SELECT count(*) FROM u) / nullif(count(*) FILTER (WHERE visited AND http = 200), 0), 4) FROM v) AS collection_yield, (SELECT round(count(*) FILTER (WHERE NOT visited) / nullif(count(*), 0), 4) FROM v) AS unvisited_rate,
      (SELECT round(count(*) FILTER (WHERE visited AND http NOT BETWEEN 200 AND 399) / nullif(count(*) FILTER (WHERE visited), 0), 4) FROM v) AS crawl_error_rate, (SELECT round(count(*) FILTER (WHERE NOT verbatim) / nullif(count(*), 0), 4) FROM evidence WHERE status = 'validated') AS non_verbatim_share,
      (SELECT round(count(*) FILTER (WHERE sources <= 1) / nullif(count(*), 0), 4) FROM k) AS unreviewed_share, (SELECT round(count(*) FILTER (WHERE p) / nullif(count(*), 0), 4) FROM d) AS published_dates, (SELECT round(median(d), 1) FROM l) AS latency_days,
      (SELECT round(sum(n) FILTER (WHERE k <= greatest(1, round_even(m * 0.1, 0))) / nullif(sum(n), 0), 4) FROM r) AS top_decile_share),
    h AS (UNPIVOT x ON COLUMNS(*) INTO NAME indicator VALUE value)"""


def _top_share(counts):
    """Share of the sum that the top tenth of the counts holds (their number half-even, one at least), from a histogram of the counts."""
    from pyspark.sql import Window as W

    hist = counts.groupBy("n").agg(one().alias("times"))  # a row for each different count
    above = F.sum("times").over(W.partitionBy(F.lit(0)).orderBy(F.desc("n")))
    top = F.greatest(F.lit(1), F.bround(F.sum("times").over(W.partitionBy(F.lit(0))) * 0.1))
    taken = F.greatest(F.lit(0), F.least(F.col("times"), top - (above - F.col("times"))))
    return hist.select("n", "times", taken.alias("taken")).agg(S.ratio(F.sum(F.col("n") * F.col("taken")), F.sum(F.col("n") * F.col("times"))).alias("value"))


def _health(t):
    e, o = t.evidence, t.offers
    v = t.runs.select(F.when(F.col("event_type") == "error", 500).otherwise(200).alias("http"), (F.col("value") >= 1).alias("visited"))
    seen = v.agg(F.count_if(F.expr("visited AND http = 200")).alias("ok"), F.count_if("visited").alias("tried"), F.count_if(F.expr("visited AND http NOT BETWEEN 200 AND 399")).alias("bad"), F.count_if(~F.col("visited")).alias("not_tried"), one().alias("n"))
    urls = e.select("offer_id").union(o.where("review_status = 'validated'").select("offer_id")).distinct().agg(one().alias("urls"))
    k = o.where("review_status = 'validated'").select("offer_id").join(e.select("offer_id", "actor_id"), "offer_id", "left").groupBy("offer_id").agg(F.countDistinct("actor_id").alias("sources"))
    dates = e.select((F.col("date_confidence") == "published").alias("p")).union(o.select(F.col("precedence") <= 2))
    days = e.join(o.select("offer_id", "published"), "offer_id").select(F.date_diff("created", "published").alias("d")).union(o.select(F.date_diff(F.lit("2001-08-01").cast("date"), "published")))
    counts = e.groupBy("offer_id").agg(one().alias("n")).select("n").union(o.groupBy("buyer_id").agg(one().alias("n")).select("n"))
    row = lambda df, name, value: df.agg(value.cast("double").alias("value")).select(F.lit(name).alias("indicator"), "value")
    c = F.col
    out = [
        urls.crossJoin(seen.select("ok")).select(F.lit("collection_yield").alias("indicator"), S.ratio(c("urls"), c("ok")).alias("value")),  # two single rows
        seen.select(F.lit("unvisited_rate"), S.ratio(c("not_tried"), c("n"))),
        seen.select(F.lit("crawl_error_rate"), S.ratio(c("bad"), c("tried"))),
        row(e.where("status = 'validated'"), "non_verbatim_share", S.ratio(F.count_if(~c("verbatim")), one())),
        row(k, "unreviewed_share", S.ratio(F.count_if(c("sources") <= 1), one())),
        row(dates, "published_dates", S.ratio(F.count_if("p"), one())),
        row(days, "latency_days", F.round(F.median("d"), 1)),
        _top_share(counts).select(F.lit("top_decile_share"), "value"),
    ]
    whole = out[0]
    for df in out[1:]:
        whole = whole.union(df)
    return whole


@q("sc05_health_indicators", f"{_HEALTH} SELECT indicator, value::DOUBLE AS value FROM h", "runs evidence offers")
def sc05(t):
    return _health(t)


@q(
    "prj11_threshold_alerts",
    f"{_HEALTH} SELECT indicator, CASE WHEN direction = 'below' THEN value < bound ELSE value > bound END AS alert FROM h JOIN (VALUES {', '.join(map(repr, ALERTS))}) a(indicator, direction, bound) USING (indicator)",
    "runs evidence offers",
)
def prj11(t):
    h = t.spark.createDataFrame(ALERTS, "indicator string, direction string, bound double")
    j = _health(t).join(F.broadcast(h), "indicator")
    return j.select("indicator", F.when(F.col("direction") == "below", F.col("value") < F.col("bound")).otherwise(F.col("value") > F.col("bound")).alias("alert"))


@q(
    "sc06_data_quality",
    f"""SELECT date_confidence AS mode, count(*) AS n, round(count(*) FILTER (WHERE status = 'review') / count(*), 4) AS rejection, median(date_diff('day', published, created)) FILTER (WHERE created >= published) AS latency
    FROM evidence JOIN offers USING (offer_id) GROUP BY 1""",
    "evidence offers",
)
def sc06(t):
    days = F.date_diff("created", "published")
    j = t.evidence.join(t.offers.select("offer_id", "published"), "offer_id")
    return j.groupBy(F.col("date_confidence").alias("mode")).agg(one().alias("n"), S.ratio(F.count_if(F.col("status") == "review"), one()).alias("rejection"), F.median(F.when(days >= 0, days)).alias("latency"))


#: The impact of an item by its queue.
IMPACT = {"evidence": 3, "offers": 2, "tech_signals": 1, "events": 1, "facts": 1, "vocabulary": 1, "actors": 2, "candidates": 1}


@q(
    "sc08_review_queues",
    f"""WITH u AS (SELECT 'evidence' AS queue, evidence_id AS id, class, confidence FROM evidence JOIN actors USING (actor_id) WHERE status = 'review' UNION ALL SELECT 'offers', offer_id, '', NULL FROM offers WHERE review_status = 'pending'
      UNION ALL SELECT 'tech_signals', doc_id, '', NULL FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'events', event_id, '', NULL FROM runs WHERE event_type = 'error' UNION ALL SELECT 'facts', part_id, '', 0.5 FROM parts WHERE market IS NULL
      UNION ALL SELECT 'vocabulary', doc_id, '', 0.25 FROM labels WHERE quality = 0 UNION ALL SELECT 'actors', actor_id, class, NULL FROM actors WHERE NOT active UNION ALL SELECT 'candidates', buyer_id, '', NULL FROM buyers WHERE balance < 0)
    SELECT queue, id, round(CASE class WHEN 'C1' THEN 3 WHEN 'C2' THEN 2 WHEN 'A1' THEN 2 ELSE 1 END * CASE queue {' '.join(f"WHEN '{k}' THEN {v}" for k, v in IMPACT.items())} END * CASE WHEN confidence IS NULL THEN 1.5 ELSE 1 + (1 - confidence) END, 3)::DOUBLE AS priority FROM u""",
    "evidence offers actors runs parts buyers",
)
def sc08(t):
    """Eight queues in one row shape, with one formula of priority."""

    def shape(df, queue, key, klass=None, confidence=None):
        klass, confidence = F.lit("") if klass is None else klass, F.lit(None) if confidence is None else confidence
        return df.select(F.lit(queue).alias("queue"), F.col(key).alias("id"), klass.alias("class"), confidence.cast("double").alias("confidence"))

    a, labels = t.actors, t.table("labels")
    queues = [
        shape(t.evidence.where("status = 'review'").join(a.select("actor_id", "class"), "actor_id"), "evidence", "evidence_id", F.col("class"), F.col("confidence")),
        shape(t.offers.where("review_status = 'pending'"), "offers", "offer_id"),
        shape(t.table("documents").select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti"), "tech_signals", "doc_id"),
        shape(t.runs.where("event_type = 'error'"), "events", "event_id"),
        shape(t.parts.where("market IS NULL"), "facts", "part_id", confidence=F.lit(0.5)),
        shape(labels.where("quality = 0"), "vocabulary", "doc_id", confidence=F.lit(0.25)),
        shape(a.where("NOT active"), "actors", "actor_id", F.col("class")),
        shape(t.buyers.where("balance < 0"), "candidates", "buyer_id"),
    ]
    u = queues[0]
    for x in queues[1:]:
        u = u.unionByName(x)
    return u.select("queue", "id", S.review_priority(F.col("class"), S.lookup(F.col("queue"), IMPACT, 1), F.col("confidence")).alias("priority"))


_DOSSIER = "SELECT 'positioning' AS section, market AS key, confirmed AS a, named AS b FROM ({ag17_positioning}) UNION ALL SELECT 'demand', segment, total, recent FROM ({ag18_demand}) UNION ALL SELECT 'trend', component, n, cited FROM ({ag19_axis_trend}) UNION ALL SELECT 'movements', event_type, n, users FROM ({ag20_movements}) UNION ALL SELECT 'perimeter', class || '|' || country, n, 0 FROM ({ag21_perimeter}) UNION ALL SELECT 'gaps', gaps, 0, 0 FROM ({ag22_gap_rules})"


@q("sc09_marketing_dossier", _DOSSIER.format(**AG.ORACLE))
def sc09(t):
    """The dossier's six sections in one shape: (section, key, a, b)."""
    part = lambda df, section, key, a, b: df.select(F.lit(section).alias("section"), key.alias("key"), F.col(a).cast("long").alias("a") if a else F.lit(0).cast("long").alias("a"), F.col(b).cast("long").alias("b") if b else F.lit(0).cast("long").alias("b"))
    c = F.col
    out = part(AG.ag17(t), "positioning", c("market"), "confirmed", "named")
    for x in (part(AG.ag18(t), "demand", c("segment"), "total", "recent"), part(AG.ag19(t), "trend", c("component"), "n", "cited"), part(AG.ag20(t), "movements", c("event_type"), "n", "users"), part(AG.ag21(t), "perimeter", F.concat("class", F.lit("|"), "country"), "n", ""), part(AG.ag22(t), "gaps", c("gaps"), "", "")):
        out = out.unionByName(x)
    return out


_FEEDBACK = "SELECT 'provenance' AS section, CASE WHEN row_still_exists THEN 'there' ELSE 'gone' END AS key, count(*) AS n FROM ({jn23_provenance}) GROUP BY 1, 2 UNION ALL SELECT 'misses', verdict, count(*) FROM ({jn24_miss_cascade}) GROUP BY 1, 2 UNION ALL SELECT 'terms', CASE WHEN rejected > accepted THEN 'mostly_rejected' ELSE 'mostly_accepted' END, count(*) FROM ({ag23_term_scoreboard}) GROUP BY 1, 2 UNION ALL SELECT 'tally', lang, n FROM ({ag24_tally})"


@q("sc10_feedback_dossier", _FEEDBACK.format(**JN.ORACLE, **AG.ORACLE))
def sc10(t):
    """What decisions tell: whose rows are still there, what the golden rows miss, which terms are rejected, and a tally."""
    by = lambda df, section, key: df.groupBy(F.lit(section).alias("section"), key.alias("key")).agg(one().alias("n"))
    terms = F.when(F.col("rejected") > F.col("accepted"), "mostly_rejected").otherwise("mostly_accepted")
    out = by(JN.jn23(t), "provenance", F.when(F.col("row_still_exists"), "there").otherwise("gone"))
    out = out.unionByName(by(JN.jn24(t), "misses", F.col("verdict"))).unionByName(by(AG.ag23(t), "terms", terms))
    return out.unionByName(AG.ag24(t).select(F.lit("tally").alias("section"), F.col("lang").alias("key"), "n"))


@q(
    "sc11_overview",
    "SELECT (SELECT count(*) FROM actors WHERE active) AS actors, (SELECT count(*) FROM evidence WHERE status = 'validated') AS facts, (SELECT count(*) FROM offers WHERE review_status = 'pending') AS pending, (SELECT count(*) FROM documents) AS documents",
    "actors evidence offers",
)
def sc11(t):
    n = lambda df, k: df.agg(one().alias("n")).select(F.lit(k).alias("k"), "n")
    u = n(t.actors.where("active"), "actors").unionByName(n(t.evidence.where("status = 'validated'"), "facts")).unionByName(n(t.offers.where("review_status = 'pending'"), "pending")).unionByName(n(t.table("documents"), "documents"))
    return u.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("actors", "facts", "pending", "documents")])


@q(
    "sc12_monthly_delta",
    f"""SELECT bucket, count(*) FILTER (WHERE created >= DATE '{AS_OF}' - 30) AS fresh, count(*) FILTER (WHERE created < DATE '{AS_OF}' - 30 AND created >= DATE '{AS_OF}' - 60) AS before FROM evidence GROUP BY 1""",
    "evidence",
)
def sc12(t):
    back = lambda n: F.date_sub(as_of(), n)
    c = F.col("created")
    return t.evidence.groupBy("bucket").agg(F.count_if(c >= back(30)).alias("fresh"), F.count_if((c < back(30)) & (c >= back(60))).alias("before"))


@q(
    "sc13_actor_list",
    f"""WITH n AS (SELECT actor_id, count(*) AS n, max(created) AS last, count(*) FILTER (WHERE status = 'validated') AS v, count(*) FILTER (WHERE date_confidence = 'published') AS p, list_sort(list(DISTINCT bucket)) AS buckets FROM evidence GROUP BY 1),
    th AS ({_THREAT}), co AS ({_CONFIDENCE}),
    j AS (SELECT a.*, coalesce(n, 0) AS facts, last, coalesce(v, 0) AS v, coalesce(p, 0) AS p, coalesce(buckets, []) AS buckets, confidence, threat,
      CASE WHEN last IS NULL THEN 0.3 WHEN date_diff('day', last, DATE '{AS_OF}') <= 30 THEN 1.0 WHEN date_diff('day', last, DATE '{AS_OF}') <= 90 THEN 0.85 WHEN date_diff('day', last, DATE '{AS_OF}') <= 180 THEN 0.6 ELSE 0.35 END AS f FROM actors a LEFT JOIN n USING (actor_id) LEFT JOIN th USING (actor_id) LEFT JOIN co USING (actor_id))
    SELECT actor_id, name, facts, CASE WHEN facts >= 10 THEN 'good' WHEN facts >= 1 THEN 'partial' ELSE 'weak' END AS coverage, f::DOUBLE AS freshness, confidence, threat, buckets, v > 0 AS confirmed,
      round(((facts > 0)::INT + (v > 0)::INT + (p > 0)::INT + (parent IS NOT NULL)::INT + (class <> '')::INT + active::INT) / 6.0 * f, 3)::DOUBLE AS completeness FROM j""",
    "actors evidence",
)
def sc13(t):
    """The actors' page: counts, ladders, both scores, and six questions of completeness weighted by freshness."""
    f = t.evidence.groupBy("actor_id").agg(one().alias("n"), F.max("created").alias("last"), F.count_if(F.col("status") == "validated").alias("v"), F.count_if(F.col("date_confidence") == "published").alias("p"), F.array_sort(F.collect_set("bucket")).alias("buckets"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    n, v, p = zero("n"), zero("v"), zero("p")
    fresh = S.freshness(D.whole_days(as_of(), F.col("last")))
    has = [n > 0, v > 0, p > 0, F.col("parent").isNotNull(), F.col("class") != "", F.col("active")]
    complete = F.round(sum((x.cast("int") for x in has), F.lit(0)) / 6.0 * fresh, 3)
    j = t.actors.join(f, "actor_id", "left").join(_threat(t), "actor_id", "left").join(_confidence(t), "actor_id", "left")
    return j.select("actor_id", "name", n.alias("facts"), S.coverage_level(n).alias("coverage"), fresh.alias("freshness"), "confidence", "threat", F.coalesce("buckets", F.array().cast("array<string>")).alias("buckets"), (v > 0).alias("confirmed"), complete.alias("completeness"))


@q(
    "sc14_network_edges",
    """SELECT 'actor:' || actor_id AS source, 'country:' || country AS target, 'based_in' AS relation FROM actors UNION ALL SELECT DISTINCT 'actor:' || actor_id, 'market:' || market, 'serves' FROM evidence JOIN parts USING (part_id) WHERE market IS NOT NULL
    UNION ALL SELECT 'actor:' || actor_id, 'group:' || parent, 'part_of' FROM actors WHERE parent IS NOT NULL""",
    "actors evidence parts",
)
def sc14(t):
    node = lambda k, c: F.concat(F.lit(k + ":"), F.col(c).cast("string"))
    a = t.actors
    based = a.select(node("actor", "actor_id").alias("source"), node("country", "country").alias("target"), F.lit("based_in").alias("relation"))
    serves = t.evidence.join(t.parts.where("market IS NOT NULL"), "part_id").select(node("actor", "actor_id"), node("market", "market"), F.lit("serves")).distinct()
    return based.union(serves).union(a.where("parent IS NOT NULL").select(node("actor", "actor_id"), node("group", "parent"), F.lit("part_of")))


@q(
    "sc14_network_nodes",
    """WITH e AS (SELECT 'actor:' || actor_id AS s, 'country:' || country AS t FROM actors UNION ALL SELECT 'actor:' || actor_id, 'group:' || parent FROM actors WHERE parent IS NOT NULL)
    SELECT DISTINCT id, string_split(id, ':')[1] AS kind FROM (SELECT s AS id FROM e UNION ALL SELECT t FROM e)""",
    "actors",
)
def sc14_nodes(t):
    e = sc14(t).where("relation <> 'serves'")
    ids = e.select(F.col("source").alias("id")).union(e.select("target")).distinct()
    return ids.withColumn("kind", F.split_part("id", F.lit(":"), F.lit(1)))


@q(
    "sc15_next_actions",
    "SELECT 'review' AS action, offer_id AS id FROM offers WHERE review_status = 'pending' AND price > 480000 UNION ALL SELECT 'revisit', actor_id FROM actors WHERE NOT active AND NOT is_reference UNION ALL SELECT 'classify', actor_id FROM actors WHERE class = ''",
    "offers actors",
)
def sc15(t):
    act = lambda df, k, c: df.select(F.lit(k).alias("action"), F.col(c).alias("id"))
    return act(t.offers.where("review_status = 'pending' AND price > 480000"), "review", "offer_id").unionByName(act(t.actors.where("NOT active AND NOT is_reference"), "revisit", "actor_id")).unionByName(act(t.actors.where("class = ''"), "classify", "actor_id"))


@q(
    "sc16_crawl_decision",
    """WITH v AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ('view', 'purchase')) AS d, count(*) FILTER (WHERE event_type = 'click') AS b, count(*) FILTER (WHERE event_type = 'error') AS e, count(*) AS s, count(*) FILTER (WHERE event_type = 'signup' AND value > 100) AS u, max(value) > 300 AS p FROM runs GROUP BY 1),
    x AS (SELECT *, d + u = 0 OR (u = 0 AND b = 0) OR e >= greatest(1, floor(s / 2)) AS anomaly FROM v) SELECT user_id, CASE WHEN p OR anomaly THEN 'adaptive' ELSE 'generic' END AS strategy, anomaly FROM x""",
    "runs",
)
def sc16(t):
    kind = lambda *k: F.count_if(F.col("event_type").isin(*k))
    v = t.runs.groupBy("user_id").agg(kind("view", "purchase").alias("d"), kind("click").alias("b"), kind("error").alias("e"), one().alias("s"), F.count_if(F.expr("event_type = 'signup' AND value > 100")).alias("u"), (F.max("value") > 300).alias("p"))
    strategy, anomaly = S.crawl_decision(*[F.col(c) for c in "pdbesu"])
    return v.select("user_id", strategy.alias("strategy"), anomaly.alias("anomaly"))


@q("sc17_offer_sheet", "SELECT actor_id, list_sort(list(DISTINCT component)) AS components, list_sort(list(DISTINCT bucket)) AS buckets FROM evidence JOIN parts USING (part_id) GROUP BY 1", "evidence parts")
def sc17(t):
    j = t.evidence.join(t.parts.select("part_id", "component"), "part_id")
    return j.groupBy("actor_id").agg(F.array_sort(F.collect_set("component")).alias("components"), F.array_sort(F.collect_set("bucket")).alias("buckets"))


@q("sc18_haystack", "SELECT part_id, lower(concat_ws(' ', label, component, market)) AS haystack FROM parts", "parts")
def sc18(t):
    return t.parts.select("part_id", F.lower(F.concat_ws(" ", "label", "component", "market")).alias("haystack"))
