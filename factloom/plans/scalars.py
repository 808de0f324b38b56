"""Filters, projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.functions import text as T
from factloom.operators import scores as S

from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query
AS_OF = "2001-11-05"

#: A filter is the same text in Spark and DuckDB where both dialects agree: name -> (role, predicate, columns, DuckDB predicate or "").
_FILTERS = {
    "flt01_conjunction": ("evidence", "status = 'validated' AND verbatim", "evidence_id", ""),
    "flt02_in_list": ("evidence", "bucket IN ('existing', 'radar')", "evidence_id, bucket", ""),
    "flt03_not_in": ("evidence", "coalesce(lang, 'unknown') NOT IN ('en', 'fr')", "evidence_id, lang", ""),
    "flt04_between_null": ("evidence", "(confidence IS NULL OR confidence NOT BETWEEN 0.02 AND 0.08)", "evidence_id, confidence", ""),
    "flt05_ilike": ("parts", "label ILIKE '%RING%'", "part_id, label", ""),
    "flt06_blank_guard": ("parts", "trim(coalesce(market, '')) <> ''", "part_id", ""),
    "flt07_time_range": ("evidence", "created >= DATE '2001-06-01'", "evidence_id, created", ""),
    "flt08_resurfaced": ("offers", "published < DATE '1998-01-01' AND price > 450000", "offer_id", ""),
    "flt09_hash_changed": ("parts", "market IS NULL OR size IS NULL OR market <> component", "part_id", ""),
    "flt13_review_filter": ("offers", "review_status = 'pending' AND precedence <= 2 AND price BETWEEN 100000 AND 120000", "offer_id", ""),
    "flt12_actor_bar": ("actors", "active AND class IN ('C1', 'C2') AND country LIKE 'NATION_1%'", "actor_id", ""),
    "flt17_plausible_range": ("runs", "value BETWEEN 0.5 AND 20", "event_id", ""),
    "flt18_nameable": ("parts", "length(label) BETWEEN 3 AND 80 AND label LIKE '% %'", "part_id", ""),
    "flt19_allowlist": ("runs", "event_type IN ('click', 'purchase')", "event_id", ""),
    "flt16_noise_blocks": ("runs", "value < 1 OR event_type = 'error' AND value < 2", "event_id", ""),
}


def _filter(role, predicate, columns):
    return lambda t: getattr(t, role).where(predicate).select(*columns.split(", "))


for _name, (_role, _predicate, _columns, _duck) in _FILTERS.items():
    q(_name, f"SELECT {_columns} FROM {_role} WHERE {_duck or _predicate}", _role)(_filter(_role, _predicate, _columns))


@q("flt10_optional_clause", "SELECT event_id FROM runs WHERE event_type = 'click'", "runs")
def flt10(t, kind: str | None = "click", least: float | None = None):
    df = t.runs
    if kind is not None:
        df = df.where(F.col("event_type") == kind)
    if least is not None:
        df = df.where(F.col("value") >= least)
    return df.select("event_id")


@q("flt14_review_reasons", "SELECT evidence_id, array_to_string(list_filter([CASE WHEN NOT verbatim THEN 'not_verbatim' END, CASE WHEN confidence IS NULL THEN 'no_confidence' END, CASE WHEN date_confidence = 'unknown' THEN 'undated' END], lambda x: x IS NOT NULL), ',') AS reasons FROM evidence", "evidence")
def flt14(t):
    r = F.array(F.when(~F.col("verbatim"), "not_verbatim"), F.when(F.col("confidence").isNull(), "no_confidence"), F.when(F.col("date_confidence") == "unknown", "undated"))
    return t.evidence.select("evidence_id", F.array_join(F.array_compact(r), ",").alias("reasons"))


@q("flt15_first_party", "SELECT page_id FROM pages WHERE regexp_extract(url, '^https?://([^/?#]+)', 1) = 'example.com' OR ends_with(regexp_extract(url, '^https?://([^/?#]+)', 1), '.example.com')")
def flt15(t):
    h = T.host(F.col("url"))
    return t.table("pages").where((h == "example.com") | h.endswith(".example.com")).select("page_id")


@q("flt20_grounding", "SELECT event_id, list_contains([1, 2, 3, 5, 8, 13, 21, 34, 55, 89], json_extract(props, '$.k')::BIGINT) AS grounded FROM runs", "runs")
def flt20(t):
    numbers = F.regexp_extract_all("props", F.lit(r"(\d+)"))
    allowed = F.array(*[F.lit(str(x)) for x in (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)])
    return t.runs.select("event_id", (F.size(F.array_except(numbers, allowed)) == 0).alias("grounded"))


#: A projection whose expression is the same in both dialects: name -> (role, key, expression, result column).
_PROJECTIONS = {
    "prj01_case": ("evidence", "evidence_id", "CASE WHEN date_confidence = 'published' THEN 'source' WHEN lang IS NOT NULL THEN 'observed' ELSE 'none' END", "kind"),
    "prj02_coalesce_nullif": ("parts", "part_id", "coalesce(nullif(market, 'ECONOMY'), nullif(component, 'Brand#1'), 'none')", "label"),
    "prj05_reference_label": ("offers", "offer_id", "CASE WHEN review_status = 'validated' THEN concat('V-', CAST(offer_id AS STRING)) ELSE concat('P', CAST(precedence AS STRING), '-', CAST(offer_id AS STRING)) END", "reference"),
    "prj07_coverage_bucket": ("parts", "part_id", "CASE WHEN size >= 10 THEN 'good' WHEN size >= 1 THEN 'partial' ELSE 'weak' END", "coverage"),
    "prj12_freshness_kind": ("evidence", "evidence_id", "CASE WHEN date_confidence <> 'published' THEN 'undated' WHEN created < DATE '2000-01-01' THEN 'backfill' ELSE 'fresh' END", "kind"),
    "prj14_page_type": ("parts", "part_id", "CASE market WHEN 'ECONOMY' THEN 'case_study' WHEN 'LARGE' THEN 'application' ELSE 'other' END", "page_type"),
    "prj15_page_family": ("parts", "part_id", "CASE WHEN market IN ('ECONOMY', 'SMALL') THEN 'offer' WHEN market IS NULL THEN 'unknown' ELSE 'proof' END", "family"),
    "prj18_crawl_budget": ("actors", "actor_id", "CASE WHEN class = 'C1' THEN 12 ELSE 6 END + CASE WHEN active THEN 20 ELSE 0 END", "budget"),
    "prj21_funding_scale": ("buyers", "buyer_id", "CASE WHEN lower(trim(segment)) IN ('building', 'machinery') THEN 'national' ELSE 'european' END", "scale"),
    "fn15_date_class": ("evidence", "evidence_id", "CASE date_confidence WHEN 'published' THEN 2 WHEN 'observed_only' THEN 1 ELSE 0 END", "rank"),
    "fn20_period": ("offers", "offer_id", "substr(CAST(published AS STRING), 1, 7)", "period"),
    "fn21_clamp": ("runs", "event_id", "greatest(5, least(20, value))", "clamped"),
    "fn41_cost": ("evidence", "evidence_id", "quantity * 3 + amount * 15", "cost"),
    "fn45_alias": ("runs", "event_id", "CASE event_type WHEN 'purchase' THEN 'order' WHEN 'signup' THEN 'join' ELSE event_type END", "operation"),
}


def _projection(role, key, expression, name):
    return lambda t: getattr(t, role).select(key, F.expr(expression).alias(name))


for _name, (_role, _key, _expression, _column) in _PROJECTIONS.items():
    q(_name, f"SELECT {_key}, {_expression.replace('AS STRING', 'AS VARCHAR')} AS {_column} FROM {_role}", _role)(_projection(_role, _key, _expression, _column))


@q("prj03_star_plus", "SELECT *, size * 2 AS twice FROM parts", "parts")
def prj03(t):
    return t.parts.select("*", (F.col("size") * 2).alias("twice"))


@q("prj04_json_decode", "SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS k FROM runs", "runs")
def prj04(t):
    return t.runs.select("event_id", F.coalesce(F.from_json("props", "k bigint")["k"], F.lit(0)).alias("k"))


@q("prj06_host_attribution", "SELECT page_id, CASE WHEN regexp_extract(url, '^https?://([^/?#]+)', 1) ILIKE '%example.com' THEN 'registry' WHEN regexp_extract(url, '^https?://([^/?#]+)', 1) ILIKE '%example.org' THEN 'press' ELSE 'web' END AS source FROM pages")
def prj06(t):
    h = T.host(F.col("url"))
    return t.table("pages").select("page_id", F.when(h.ilike("%example.com"), "registry").when(h.ilike("%example.org"), "press").otherwise("web").alias("source"))


@q(
    "prj08_freshness_factor",
    f"SELECT evidence_id, (CASE WHEN date_diff('day', created, DATE '{AS_OF}') <= 30 THEN 1.0 WHEN date_diff('day', created, DATE '{AS_OF}') <= 90 THEN 0.85 WHEN date_diff('day', created, DATE '{AS_OF}') <= 180 THEN 0.6 ELSE 0.35 END)::DOUBLE AS factor FROM evidence",
    "evidence",
)
def prj08(t):
    return t.evidence.select("evidence_id", S.freshness(D.whole_days(F.lit(AS_OF).cast("date"), F.col("created"))).alias("factor"))


@q(
    "prj09_completeness",
    "SELECT part_id, round(((market IS NOT NULL)::INT + (size > 10)::INT + (length(label) > 8)::INT) / 3.0, 4)::DOUBLE AS completeness, array_to_string(list_filter([CASE WHEN market IS NULL THEN 'market' END, CASE WHEN NOT size > 10 THEN 'size' END, CASE WHEN NOT length(label) > 8 THEN 'label' END], lambda x: x IS NOT NULL), ',') AS missing FROM parts",
    "parts",
)
def prj09(t):
    present = {"market": F.col("market").isNotNull(), "size": F.col("size") > 10, "label": F.length("label") > 8}
    total = sum((c.cast("int") for c in present.values()), F.lit(0)) / float(len(present))
    return t.parts.select("part_id", F.round(total, 4).alias("completeness"), F.array_join(F.array_compact(F.array(*[F.when(~c, k) for k, c in present.items()])), ",").alias("missing"))


@q("prj13_stage_head", "SELECT part_id, CASE WHEN string_split(label, ' ')[1] IN ('small', 'large') THEN string_split(label, ' ')[1] ELSE 'unspecified' END AS stage FROM parts", "parts")
def prj13(t):
    head = F.split_part("label", F.lit(" "), F.lit(1))
    return t.parts.select("part_id", F.when(head.isin("small", "large"), head).otherwise("unspecified").alias("stage"))


@q("prj16_multi_family", "SELECT part_id, list_filter([CASE WHEN contains(label, 'ring') THEN 'ring' END, CASE WHEN size > 25 THEN 'big' END], lambda x: x IS NOT NULL) AS families FROM parts", "parts")
def prj16(t):
    return t.parts.select("part_id", F.array_compact(F.array(F.when(F.col("label").contains("ring"), "ring"), F.when(F.col("size") > 25, "big"))).alias("families"))


@q("prj17_trim", "SELECT part_id, label, market FROM parts", "parts")
def prj17(t):
    return t.parts.select("part_id", "label", "market")


@q("prj19_title_annotation", "SELECT actor_id, regexp_extract(name || ' [' || country || ']', '^(.*?)\\s*\\[', 1) AS title, regexp_extract(name || ' [' || country || ']', '\\[([^\\]]*)\\]$', 1) AS note FROM actors", "actors")
def prj19(t):
    title = F.concat("name", F.lit(" ["), "country", F.lit("]"))
    return t.actors.select("actor_id", F.regexp_extract(title, r"^(.*?)\s*\[", 1).alias("title"), F.regexp_extract(title, r"\[([^\]]*)\]$", 1).alias("note"))


@q("prj20_well_formed", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) >= 40 AND lang IN ('en', 'fr', 'de', 'es')")
def prj20(t):
    return t.table("documents").where(F.col("text").isNotNull() & (F.length("text") >= 40) & F.col("lang").isin("en", "fr", "de", "es")).select("doc_id")


@q("fn02_slug", "SELECT DISTINCT label, trim(regexp_replace(lower(strip_accents(label)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM parts", "parts")
def fn02(t):
    return t.parts.select("label", T.slug(F.col("label")).alias("slug")).distinct()


@q("fn03_org_key", "SELECT actor_id, upper(trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', ' ', 'g'))) AS key FROM actors", "actors")
def fn03(t):
    return t.actors.select("actor_id", T.org_key(F.col("name")).alias("key"))


@q("fn05_squeeze", "SELECT doc_id, md5(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS squeezed FROM documents")
def fn05(t):
    return t.table("documents").select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("squeezed"))


@q("fn06_strip_html", "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS plain FROM pages")
def fn06(t):
    return t.table("pages").select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("plain"))


@q("fn07_canonical_url", "SELECT page_id, lower(regexp_extract(url, '^(https?)://', 1)) || '://' || lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) || regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS canonical FROM pages")
def fn07(t):
    return t.table("pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@q("fn08_root_domain", "SELECT page_id, regexp_extract(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '([^.]+\\.[^.]+)$', 1) AS domain FROM pages")
def fn08(t):
    return t.table("pages").select("page_id", T.root_domain(F.col("url")).alias("domain"))


@q("fn09_language_from_url", "SELECT page_id, nullif(regexp_extract(url, '^https?://[^/]+/(fr|en|de|es)(/|$|[?#])', 1), '') AS lang FROM pages")
def fn09(t):
    return t.table("pages").select("page_id", T.language_of_url(F.col("url")).alias("lang"))


@q("fn11_fact_key", "SELECT evidence_id, concat_ws('|', actor_id::VARCHAR, bucket, coalesce(lang, ''), strftime(created, '%Y-%m')) AS fact_key FROM evidence", "evidence")
def fn11(t):
    return t.evidence.select("evidence_id", F.concat_ws("|", F.col("actor_id").cast("string"), "bucket", F.coalesce("lang", F.lit("")), F.date_format("created", "yyyy-MM")).alias("fact_key"))


@q("fn12_fingerprint", "SELECT doc_id, sha256(source || '|' || text) AS fingerprint, substr(sha256(text), 1, 24) AS group_id FROM documents")
def fn12(t):
    return t.table("documents").select("doc_id", F.sha2(F.concat_ws("|", "source", "text"), 256).alias("fingerprint"), F.substring(F.sha2("text", 256), 1, 24).alias("group_id"))


@q("fn13_evidence_type", "SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]+ ?(%|mm|kg|km)') THEN 'proof' ELSE 'claim' END AS kind FROM documents")
def fn13(t):
    return t.table("documents").select("doc_id", F.when(F.col("text").rlike(r"[0-9]+ ?(%|mm|kg|km)"), "proof").otherwise("claim").alias("kind"))


@q("fn14_numeric_tokens", "SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))) AS numbers FROM documents")
def fn14(t):
    return t.table("documents").select("doc_id", F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)")))).alias("numbers"))


@q(
    "fn16_late_arrival",
    "SELECT evidence_id, e.part_id, CASE WHEN date_confidence = 'published' THEN date_diff('day', published, created) > 60 END AS late FROM evidence e JOIN offers USING (offer_id)",
    "evidence offers",
)
def fn16(t):
    j = t.evidence.join(t.offers.select("offer_id", "published"), "offer_id")
    return j.select("evidence_id", "part_id", D.is_late(F.col("date_confidence"), F.col("created"), F.col("published")).alias("late"))


@q("fn17_fractional_days", "SELECT event_id, round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0, 6) AS days FROM events")
def fn17(t):
    return t.table("events").select("event_id", F.round(D.elapsed_days(F.col("ts"), F.lit("2024-01-01")), 6).alias("days"))


@q("fn18_calendar_days", "SELECT offer_id, date_diff('day', published, DATE '2001-11-05') AS days FROM offers", "offers")
def fn18(t):
    return t.offers.select("offer_id", F.date_diff(F.lit(AS_OF).cast("date"), F.col("published")).cast("bigint").alias("days"))


@q("fn19_recent_floor", "SELECT event_id, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0)::BIGINT <= 7 AS recent FROM events")
def fn19(t):
    return t.table("events").select("event_id", (D.whole_days(F.lit("2024-01-31"), F.col("ts")) <= 7).alias("recent"))


@q("fn22_half_even", "SELECT part_id, round_even(list_price / 8, 1) AS x, round(list_price / 8, 1) AS y FROM parts", "parts")
def fn22(t):
    return t.parts.select("part_id", F.bround(F.col("list_price") / 8, 1).alias("x"), F.round(F.col("list_price") / 8, 1).alias("y"))


@q("fn23_number_parse", "SELECT offer_id, round(price, 2) AS a, round(price, 2) AS b FROM offers", "offers")
def fn23(t):
    shown = F.format_number("price", 2)
    french = F.translate(F.translate(F.translate(shown, ",", " "), ".", ","), " ", " ")
    return t.offers.select("offer_id", T.number(french).alias("a"), T.number(shown).alias("b"))


@q("fn24_plausible_date", "SELECT offer_id, CASE WHEN year(published) BETWEEN 1995 AND 2000 THEN strftime(published, '%Y-%m-%d') END AS d FROM offers", "offers")
def fn24(t):
    return t.offers.select("offer_id", D.plausible(F.concat(F.date_format("published", "yyyy-MM-dd"), F.lit("T00:00")), 2000).alias("d"))


@q("fn26_partial_pad", "SELECT offer_id, strftime(published, '%Y-%m-%d') AS d FROM offers", "offers")
def fn26(t):
    return t.offers.select("offer_id", D.pad_partial(F.date_format("published", "yyyy-M-d")).alias("d"))


@q("fn27_compact_date", "SELECT offer_id, strftime(published, '%Y-%m-%d') AS d FROM offers", "offers")
def fn27(t):
    return t.offers.select("offer_id", D.compact_date(F.date_format("published", "yyyyMMdd").cast("int")).alias("d"))


@q(
    "fn28_inverted_index",
    "WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, md5(left(array_to_string(w, ' '), 6000)) AS abstract FROM w",
)
def fn28(t):
    """A text's words and their places, and the text rebuilt from them; both in the text's own row, so no word is shuffled."""
    of = lambda index: F.flatten(F.transform(index, lambda e: F.transform(e["at"], lambda p: F.struct(p.alias("p"), e["word"].alias("w")))))
    placed = F.sort_array(of(T.inverted_index(F.split("text", " "))))
    return t.table("documents").select("doc_id", F.md5(F.left(F.array_join(F.transform(placed, lambda x: x["w"]), " "), F.lit(6000))).alias("abstract"))


@q("fn29_preferred_language", "SELECT part_id, coalesce(min(lang) FILTER (WHERE lang = 'fr'), min(lang)) AS lang FROM evidence GROUP BY 1", "evidence")
def fn29(t):
    langs = F.array_sort(F.collect_set("lang"))
    return t.evidence.groupBy("part_id").agg(langs.alias("l")).select("part_id", F.coalesce(F.get(F.filter("l", lambda x: x == "fr"), F.lit(0)), F.get("l", F.lit(0))).alias("lang"))


_SHINGLES = "list_distinct(list_transform(range(1, greatest(len({0}) - 2, 1) + 1), lambda i: array_to_string({0}[i:i + 2], ' ')))"


@q("fn30_shingles", f"WITH w AS (SELECT item_id, string_split(lower(text), ' ') AS w FROM benchmark) SELECT item_id, len({_SHINGLES.format('w')})::BIGINT AS n FROM w")
def fn30(t):
    return t.table("benchmark").select("item_id", F.size(T.shingles(F.split(F.lower("text"), " "))).cast("bigint").alias("n"))


@q(
    "fn31_jaccard",
    f"""WITH w AS (SELECT item_id, {_SHINGLES.format("string_split(lower(text), ' ')")} AS s FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))), 4) AS j FROM w a JOIN w b ON b.item_id = a.item_id + 1""",
)
def fn31(t):
    w = t.table("benchmark").select("item_id", T.shingles(F.split(F.lower("text"), " ")).alias("s"))
    b = w.select((F.col("item_id") - 1).alias("k"), F.col("s").alias("z"), F.col("item_id").alias("b"))
    return w.join(b, w.item_id == b.k).select(F.col("item_id").alias("a"), "b", F.round(T.jaccard(F.col("s"), F.col("z")), 4).alias("j"))


@q("fn33_keyword_class", "SELECT doc_id, CASE WHEN contains(lower(text), ' of ') THEN 'english' WHEN contains(lower(text), ' der ') THEN 'german' ELSE 'other' END AS kind FROM documents")
def fn33(t):
    low = F.lower("text")
    return t.table("documents").select("doc_id", F.when(low.contains(" of "), "english").when(low.contains(" der "), "german").otherwise("other").alias("kind"))


@q("fn34_prefix_strip", "SELECT actor_id, string_split(name, '#')[2] AS tail FROM actors", "actors")
def fn34(t):
    return t.actors.select("actor_id", F.substring_index("name", "#", -1).alias("tail"))


@q("fn37_search_variants", "SELECT part_id, list_filter(string_split(label, ' '), lambda w: length(w) >= 5) AS terms FROM parts", "parts")
def fn37(t):
    return t.parts.select("part_id", F.filter(F.split("label", " "), lambda w: F.length(w) >= 5).alias("terms"))


@q("fn43_known_list", "SELECT part_id, len(list_filter(string_split(label, ' '), lambda w: w NOT IN ('small', 'ring', 'red', 'widget', 'blue'))) = 0 AS known FROM parts", "parts")
def fn43(t):
    return t.parts.select("part_id", F.forall(F.split("label", " "), lambda w: w.isin("small", "ring", "red", "widget", "blue")).alias("known"))


@q("fn44_dimension_summary", "SELECT user_id, string_agg(event_type || ' (' || n || ')', '; ' ORDER BY event_type) AS summary FROM (SELECT user_id, event_type, count(*) AS n FROM runs GROUP BY 1, 2) GROUP BY 1", "runs")
def fn44(t):
    n = t.runs.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit(" ("), x["n"].cast("string"), F.lit(")")))
    return n.groupBy("user_id").agg(F.array_join(shown, "; ").alias("summary"))


@q("fn46_amount_label", "SELECT offer_id, format('{:,}', round(price)::BIGINT) AS label FROM offers", "offers")
def fn46(t):
    return t.offers.select("offer_id", F.format_number(F.round("price").cast("bigint"), 0).alias("label"))


@q("fn49_concat_skip_null", "SELECT part_id, concat_ws(' ', market, component, label) AS text FROM parts", "parts")
def fn49(t):
    return t.parts.select("part_id", F.concat_ws(" ", "market", "component", "label").alias("text"))


@q("fn50_nested_distinct", "SELECT conv_id, list_sort(list(DISTINCT role)) AS roles FROM conversations GROUP BY 1")
def fn50(t):
    return t.table("conversations").groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("role"))))).alias("roles"))


@q("fn36_whole_phrase", "SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])(of the|in der)([^a-z0-9_]|$)')")
def fn36(t):
    return t.table("documents").where(F.lower("text").rlike(r"(?<![a-z0-9_])(?:of the|in der)(?![a-z0-9_])")).select("doc_id")


@q("fn10_doi", "SELECT part_id, '10.1/' || lower(label) AS doi FROM parts", "parts")
def fn10(t):
    return t.parts.select("part_id", T.doi(F.concat(F.lit("https://doi.org/10.1/"), "label")).alias("doi"))


@q("fn25_published_cascade", "SELECT page_id, coalesce(nullif(regexp_extract(html, 'published_time\" content=\"([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), nullif(regexp_extract(html, '\"datePublished\":\"([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), ''), nullif(regexp_extract(url, '/([0-9]{4}-[0-9]{2}-[0-9]{2})/', 1), '')) AS published FROM pages")
def fn25(t):
    day = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
    found = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    return t.table("pages").select("page_id", F.coalesce(found("html", 'published_time" content="' + day), found("html", '"datePublished":"' + day), found("url", f"/{day}/")).alias("published"))


@q("fn35_alias", "SELECT actor_id, CASE WHEN length(x) >= 4 THEN x END AS alias FROM (SELECT actor_id, trim(regexp_replace(regexp_replace(lower(name || ' (' || country || ') GmbH'), '\\([^)]*\\)', ' ', 'g'), '(^| )(gmbh|sa|ltd|inc)( |$)', ' ', 'g')) AS x FROM actors)", "actors")
def fn35(t):
    full = F.lower(F.concat("name", F.lit(" ("), "country", F.lit(") GmbH")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(full, r"\([^)]*\)", " "), r"(^| )(gmbh|sa|ltd|inc)( |$)", " "))
    return t.actors.select("actor_id", F.when(F.length(bare) >= 4, bare).alias("alias"))


@q("fn38_title_segment", "SELECT page_id, trim(string_split(regexp_extract(html, '<title>([^<]*)</title>', 1), ' - ')[1]) AS title FROM pages")
def fn38(t):
    return t.table("pages").select("page_id", F.trim(F.split_part(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" - "), F.lit(1))).alias("title"))


@q("fn39_description", "SELECT doc_id, md5(left(string_split(text, '. ')[1], 320)) AS description FROM documents")
def fn39(t):
    return t.table("documents").select("doc_id", F.md5(F.left(F.split_part("text", F.lit(". "), F.lit(1)), F.lit(320))).alias("description"))


@q(
    "fn40_url_score",
    "SELECT page_id, least(140, greatest(0, CASE WHEN regexp_matches(url, '/(fr|en)/') THEN 60 ELSE 20 END + CASE WHEN starts_with(url, 'https') THEN 18 ELSE 0 END + CASE WHEN contains(url, '?') THEN -10 ELSE 0 END)) AS score FROM pages",
)
def fn40(t):
    u = F.col("url")
    raw = F.when(u.rlike("/(fr|en)/"), 60).otherwise(20) + F.when(u.startswith("https"), 18).otherwise(0) + F.when(F.contains(u, F.lit("?")), -10).otherwise(0)
    return t.table("pages").select("page_id", F.least(F.lit(140), F.greatest(F.lit(0), raw)).alias("score"))


@q("fn42_implausible_note", "SELECT user_id, string_agg(event_type || '=' || m::BIGINT, '; ' ORDER BY event_type) AS note FROM (SELECT user_id, event_type, floor(max(value)) AS m FROM runs GROUP BY 1, 2) WHERE m > 60 GROUP BY 1", "runs")
def fn42(t):
    m = t.runs.groupBy("user_id", "event_type").agg(F.floor(F.max("value")).alias("m")).where("m > 60")
    entries = F.array_sort(F.map_entries(F.map_from_entries(F.collect_list(F.struct("event_type", "m")))))
    return m.groupBy("user_id").agg(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ").alias("note"))


@q("fn47_flatten_strings", "SELECT event_id, [event_type, json_extract(props, '$.k')::BIGINT::VARCHAR] AS leaves FROM runs", "runs")
def fn47(t):
    nested = F.to_json(F.struct("event_type", F.struct(F.from_json("props", "k bigint")["k"].cast("string").alias("k")).alias("inner")))
    return t.runs.select("event_id", F.regexp_extract_all(nested, F.lit(r':"([^"]*)"')).alias("leaves"))


@q("fn51_participants", "SELECT offer_id, list_sort(list_distinct(list(coalesce(lang, 'participant')) FILTER (WHERE bucket <> 'pending'))) AS roles FROM evidence GROUP BY 1 HAVING count(*) FILTER (WHERE bucket <> 'pending') > 0", "evidence")
def fn51(t):
    g = t.evidence.groupBy("offer_id").agg(F.collect_list(F.struct("bucket", "lang")).alias("p"))
    kept = F.filter("p", lambda x: x["bucket"] != "pending")
    return g.select("offer_id", F.array_sort(F.array_distinct(F.transform(kept, lambda x: F.coalesce(x["lang"], F.lit("participant"))))).alias("roles")).where("size(roles) > 0")


@q("fn04_plain_bag", "SELECT page_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(url), '[^a-z0-9]+'), lambda w: w <> ''))) AS bag FROM pages")
def fn04(t):
    words = F.filter(F.split(T.fold(F.coalesce(F.try_url_decode("url"), F.col("url"))), "[^a-z0-9]+"), lambda w: w != "")
    return t.table("pages").select("page_id", F.array_sort(F.array_distinct(words)).alias("bag"))
