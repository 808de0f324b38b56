"""Extraction, and the upserts that rest on it, on the landed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import blocks as B
from factloom.operators import extraction as E
from factloom.operators import rules as R
from factloom.operators import state as X
from factloom.operators import vocabulary as V

from .base import Book
from .texts import _CORE_RULES, _FOUND, DOMAIN, RULES, _any, _core_sql, _found, _norm, _pad, _rules, found_sql

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query

#: What the landed texts state: licences in place of certificates, and a graded version of one.
LICENCES = (("MIT", r"\bMIT License\b"), ("Apache", r"\bApache License\b"))
VERSION, CONTEXT = r"Version ([0-9]+)\.[0-9]", "(?i)licen[sc]e"
CUES = ("inthe", "inere", "workpiece")


def n():
    return F.count(F.lit(1))


@q("fn01_normalize", f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def fn01(t):
    return t.table("documents").select("doc_id", F.md5(R.normalized("text")).alias("digest"))


@q("fn48_number_text", "SELECT evidence_id, regexp_replace(regexp_replace(replace(replace(amount::DECIMAL(18, 3)::VARCHAR, '.', ','), ',', '.'), '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS number FROM evidence", "evidence")
def fn48(t):
    written = F.replace(F.col("amount").cast("decimal(18,3)").cast("string"), F.lit("."), F.lit(","))
    return t.evidence.select("evidence_id", E.number_text(written).alias("number"))


@q("tx35_certificates", "SELECT source, code, min(doc_id) AS doc_id FROM (SELECT source, doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '\\bMIT License\\b') THEN 'MIT' END, CASE WHEN regexp_matches(text, '\\bApache License\\b') THEN 'Apache' END], lambda x: x IS NOT NULL)) AS code FROM documents) GROUP BY 1, 2")
def tx35(t):
    d = t.table("documents").select(F.col("source").alias("grp"), "doc_id", "text")
    return E.certificates(d, "grp", "doc_id", "text", LICENCES).select(F.col("grp").alias("source"), "code", F.col("source").alias("doc_id"))


@q("tx35_best_grade", "SELECT lang, min(struct_pack(g := g, d := doc_id)).g AS grade, min(struct_pack(g := g, d := doc_id)).d AS doc_id FROM (SELECT lang, doc_id, unnest(list_transform(regexp_extract_all(text, 'Version ([0-9]+)\\.[0-9]', 1), lambda x: x::BIGINT)) AS g FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e')) GROUP BY 1")
def tx35_grade(t):
    return E.best_grade(t.table("documents"), "lang", "doc_id", "text", VERSION, r"class ([0-9]+) never", CONTEXT).select("lang", "grade", "doc_id")


#: Numbers with a "unit" that the landed texts have: a version, and two digits or more before a word.
UNITS = {"version": (r"Version ([0-9]+\.[0-9]+)", CONTEXT, 0, 100, "most"), "quantity": (r"([0-9]{2,4}) [a-z]", "", 20, 1500, "least")}


@q(
    "tx34_measures",
    """WITH x AS (SELECT source, doc_id, 'version' AS measure, true AS up, unnest(list_transform(regexp_extract_all(text, 'Version ([0-9]+\\.[0-9]+)', 1), lambda x: x::DOUBLE)) AS value FROM documents WHERE regexp_matches(text, '(?i)licen[sc]e')
      UNION ALL SELECT source, doc_id, 'quantity', false, unnest(list_transform(regexp_extract_all(text, '([0-9]{2,4}) [a-z]', 1), lambda x: x::DOUBLE)) FROM documents),
    y AS (SELECT *, CASE measure WHEN 'version' THEN value BETWEEN 0 AND 100 ELSE value BETWEEN 20 AND 1500 END AS fit FROM x)
    SELECT source, measure, arg_min(value, struct_pack(a := CASE WHEN up THEN -value ELSE value END, b := doc_id)) FILTER (WHERE fit) AS value, arg_min(doc_id, struct_pack(a := CASE WHEN up THEN -value ELSE value END, b := doc_id)) FILTER (WHERE fit) AS doc_id,
      coalesce(list_sort(list(DISTINCT value) FILTER (WHERE NOT fit)), []) AS implausible FROM y GROUP BY 1, 2""",
)
def tx34(t):
    return E.measures(t.table("documents"), "source", "doc_id", "text", UNITS)


@q("tx36_named_offers")
def tx36(t):
    p = B.documents(t.table("pages")).select("page_id", F.posexplode("blocks").alias("pos", "b"))
    titles = t.table("pages").select(F.col("page_id").cast("long").alias("page_id"), F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))
    blocks = p.select("page_id", "pos", "b.heading", "b.text").join(titles, "page_id")
    return E.named_offers(blocks, _rules(t, "operation", DOMAIN), DOMAIN).select("page_id", "kind", F.md5("name_key").alias("name"), F.size("operations").alias("operations"), "status")


_MACHINING = [r for r in RULES if r[0] in ("operation", "architecture")]


@q("tx38_describes_machining", f"WITH {found_sql('documents', 'doc_id', 'text', _MACHINING)} SELECT id FROM found_n WHERE id IN (SELECT id FROM found) OR {_any(CUES)}")
def tx38(t):
    cued = t.table("documents").select(F.col("doc_id").alias("id"), R.padded(F.col("text")).alias("t")).where(R.named(F.col("t"), CUES)).select("id")
    return cued.unionByName(_found(t, "operation", "architecture").select("id")).distinct()


@q(
    "tx42_multi_context",
    f"""WITH b AS (SELECT conv_id, turn, conv_id || ':' || turn AS bid, role, coalesce(text, '') AS text FROM conversations), {found_sql("b", "bid", "text", _CORE_RULES)}, {_core_sql("found")}
    SELECT conv_id AS grp, turn, coalesce(len(markets) > 1 OR len(components) > 1, false) AS several, role = 'user' AS isolated FROM b LEFT JOIN c ON c.id = b.bid""",
)
def tx42(t):
    """Blocks that list several applications, items that stand alone, and the group that a block may share context in."""
    b = t.table("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.struct("conv_id", "turn"))
    c = R.core(R.labels(b, _rules(t, "market", "component", "operation"), "id", "text"), V.market_of()).select("id", ((F.size("markets") > 1) | (F.size("components") > 1)).alias("several"))
    return b.join(c, "id", "left").select(F.col("conv_id").alias("grp"), "turn", F.coalesce("several", F.lit(False)).alias("several"), (F.col("role") == "user").alias("isolated"))


_KNOWN = sorted({v for r in RULES for k in (3, 4, 5, 6) for x in r[k] for v in R.variants(x) if " " not in v and "-" not in v})


@q("tx30_proposals", f"SELECT w, count(*) AS seen FROM (SELECT DISTINCT doc_id, unnest(string_split(trim({_pad('text')}), ' ')) AS w FROM documents) WHERE length(w) BETWEEN 2 AND 60 AND regexp_matches(w, '\\p{{L}}') AND w NOT IN ({', '.join(map(repr, _KNOWN))}) GROUP BY 1")
def tx30(t):
    words = t.table("documents").select(F.explode(F.array_distinct(F.split(F.trim(R.padded(F.col("text"))), " "))).alias("w"), "doc_id").groupBy("w").agg(F.countDistinct("doc_id").alias("seen"))
    return E.proposals(words, _rules(t), "w")


@q(
    "st34_project_index",
    f"WITH {_FOUND} SELECT id, list_sort(list(DISTINCT label) FILTER (WHERE dimension = 'operation')) AS operations, coalesce(list_sort(list(DISTINCT label) FILTER (WHERE dimension = 'market')), []) AS markets FROM found GROUP BY 1 HAVING count(*) FILTER (WHERE dimension = 'operation') > 0 AND count(*) FILTER (WHERE dimension = '{DOMAIN}') > 0",
)
def st34(t):
    """Projects on topic whose text names an operation, with what it names."""
    of = lambda d: F.array_sort(F.collect_set(F.when(F.col("dimension") == d, F.col("label"))))
    g = _found(t, "operation", "market", DOMAIN).groupBy("id").agg(of("operation").alias("operations"), of("market").alias("markets"), F.count_if(F.col("dimension") == DOMAIN).alias("k"))
    return g.where("size(operations) > 0 AND k > 0").select("id", "operations", "markets")


@q(
    "st21_cofunding_signals",
    f"WITH {_FOUND}, p AS (SELECT id FROM found GROUP BY 1 HAVING count(*) FILTER (WHERE dimension = 'operation') > 0 AND count(*) FILTER (WHERE dimension = '{DOMAIN}') > 0) SELECT sha256('fund|' || doc_id || '|' || source) AS fingerprint, min(doc_id) AS project FROM documents JOIN p ON p.id = doc_id JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1",
)
def st21(t):
    """A signal for each private partner of an indexed project, inserted once by its fingerprint."""
    partners = t.table("labels").where("quality = 1").select("doc_id").join(t.table("documents").select("doc_id", "source"), "doc_id")
    signals = partners.join(st34(t).select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    keyed = signals.select(F.sha2(F.concat_ws("|", F.lit("fund"), F.col("doc_id").cast("string"), "source"), 256).alias("fingerprint"), F.col("doc_id").alias("project"))
    first = keyed.groupBy("fingerprint").agg(F.min("project").alias("project"))
    return X.insert_missing(first.where("project % 2 = 0"), first, ["fingerprint"])


@q(
    "st20_named_offer_upsert",
    "SELECT sha256(actor_id || '|' || lower(label)) AS fingerprint, min(created) AS first_seen, max(created) AS last_seen, arg_min(lang, struct_pack(a := created, b := evidence_id)) FILTER (WHERE lang IS NOT NULL) AS description FROM evidence JOIN parts USING (part_id) GROUP BY 1",
    "evidence parts",
)
def st20(t):
    e = t.evidence.join(t.parts.select("part_id", "label"), "part_id")
    o = e.select(F.sha2(F.concat_ws("|", F.col("actor_id").cast("string"), F.lower("label")), 256).alias("fingerprint"), F.col("created").alias("first_seen"), F.col("created").alias("last_seen"), F.col("lang").alias("description"), "created", "evidence_id")
    cut = F.lit("1999-01-01").cast("date")
    policies = {"first_seen": X.least, "last_seen": X.most, "description": X.keep}
    return X.fold(o.where(F.col("created") < cut), o.where(F.col("created") >= cut), ["fingerprint"], policies, ["created", "evidence_id"])


@q(
    "st01_transition_log",
    "WITH o AS (SELECT actor_id, part_id, arg_max(bucket, CASE bucket WHEN 'existing' THEN 2 WHEN 'radar' THEN 1 ELSE 0 END) AS b FROM evidence WHERE created < DATE '1999-01-01' GROUP BY 1, 2), w AS (SELECT actor_id, part_id, arg_max(bucket, CASE bucket WHEN 'existing' THEN 2 WHEN 'radar' THEN 1 ELSE 0 END) AS b FROM evidence GROUP BY 1, 2) SELECT actor_id, part_id, o.b AS before, w.b AS after FROM o JOIN w USING (actor_id, part_id) WHERE o.b <> w.b",
    "evidence",
)
def st01_log(t):
    e = t.evidence.select("actor_id", "part_id", "bucket", "created", "evidence_id")
    cut = F.lit("1999-01-01").cast("date")
    key, policies, at = ["actor_id", "part_id"], {"bucket": X.highest()}, ["evidence_id"]
    old = X.fold(e.where(F.col("created") < cut), e.limit(0), key, policies, at)
    new = X.fold(e.where(F.col("created") < cut), e.where(F.col("created") >= cut), key, policies, at)
    return X.transitions(old, new, key, "bucket")


@q("st31_curated_restore", "SELECT actor_id, part_id, bool_or(status = 'validated') AS kept FROM evidence GROUP BY 1, 2", "evidence")
def st31(t):
    keys = lambda s: t.evidence.where(F.col("status") == s).select("actor_id", "part_id").distinct()
    state = keys("validated").withColumn("kept", F.lit(True))
    return X.insert_missing(state, keys("review").withColumn("kept", F.lit(False)), ["actor_id", "part_id"])
