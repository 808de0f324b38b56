"""The rule engine over the landed texts: labels, gates, sentences, relations and what is compiled from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import rules as R
from factloom.operators import vocabulary as V

from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query

RULES = V.vocabulary()
#: The dimension whose labels make a text one of the domain, labels too general to do so alone, and cues of the negative gates.
DOMAIN = "process_technology"
GENERIC = ("process_technology-00", "process_technology-01", "process_technology-02")
SOURCE_CUES = ("inth", "inon", "inan")
INSTRUMENT_CUES = ("reth", "reon", "rean")
#: Stages of maturity from the most mature one, and their terms in this vocabulary.
STAGES = (("production", "existing", ("onon", "anon", "onth")), ("pilot", "radar", ("onan", "oner", "anre")), ("research", "radar", ("of", "der", "que")))
CAREER = ("onin", "erin", "anin")
PROGRAMMES = ("onha", "erha", "thha")


def n():
    return F.count(F.lit(1))


# ---------------------------------------------------------------------------------------------------- SQL twins
_SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(lower(replace(nfc_normalize({x}), 'ß', 'ss')), '{_SPACE}', ' ', 'g'))"


def _pad(x: str) -> str:
    return rf"(' ' || trim(regexp_replace(regexp_replace({_norm(x)}, '([^\p{{L}}\p{{N}}_\s-])', ' \1 ', 'g'), '[\s-]+', ' ', 'g')) || ' ')"


def _values(rules) -> str:
    arr = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    rows = ", ".join(f"('{d}', '{lab}', {o}, {', '.join(map(arr, lists))})" for d, lab, o, *lists in rules)
    return f"(VALUES {rows}) r(dimension, label, ord, any_of, all_of, exclude, requires_any, regex)"


def _hit(x: str) -> str:
    v = f"replace({x}, '-', ' ')"
    return f"(contains(t, ' ' || {v} || ' ') OR (NOT regexp_matches({x}, '[sx]$') AND contains(t, ' ' || {v} || 's ')))"


_SCORED = "struct_pack(a := -(CASE WHEN len(all_of) > 0 THEN 3 ELSE 0 END + CASE WHEN len(regex) > 0 THEN 1 ELSE 0 END + len(hits)), b := -coalesce(list_sum(list_transform(hits, lambda x: length(x))), 0)::INT, c := -len(all_of), d := ord, e := label)"


def found_sql(source: str, id_: str, text: str, rules=RULES, name: str = "found") -> str:
    """CTEs that end in name(id, dimension, label, ord, hits, rank), as operators.rules.labels gives them."""
    return f"""{name}_n AS (SELECT {id_} AS id, {text} AS raw, {_pad(text)} AS t FROM {source}),
  {name}_f AS (SELECT id, dimension, label, ord, any_of, all_of, regex, list_filter(all_of, lambda x: {_hit("x")}) AS a, list_filter(any_of, lambda x: {_hit("x")}) AS b,
    list_filter(list_transform(regex, lambda p: regexp_extract(raw, '(?i)' || p, 0)), lambda x: x <> '') AS g, len(list_filter(exclude, lambda x: {_hit("x")})) AS x, len(list_filter(requires_any, lambda x: {_hit("x")})) AS q, requires_any
    FROM {name}_n, {_values(rules)} WHERE raw IS NOT NULL),
  {name}_h AS (SELECT *, list_transform(list_filter(list_zip(a || b || g, range(1, len(a || b || g) + 1)), lambda z: list_position(a || b || g, z[1]) = z[2]), lambda z: z[1]) AS hits FROM {name}_f WHERE x = 0 AND len(a) = len(all_of) AND len(a || b || g) > 0 AND (len(requires_any) = 0 OR q > 0)),
  {name} AS (SELECT id, dimension, label, ord, hits, {_SCORED} AS rank FROM {name}_h)"""


_FOUND = found_sql("documents", "doc_id", "text")
_BEST = "(SELECT id, dimension, arg_min(label, rank) AS label, min(rank) AS rank FROM found GROUP BY 1, 2)"


def _any(terms) -> str:
    return "(" + " OR ".join(f"contains(t, ' {x} ')" for x in terms) + ")"


def sentences_sql(text: str = "text") -> str:
    clean = f"trim(regexp_replace({text}, '{_SPACE}', ' ', 'g'))"
    marked = rf"regexp_replace(regexp_replace({clean}, '([.!?]) +', '\1' || chr(1), 'g'), ' *[•·▪◦;] *', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: length(s) >= 12)"


_EACH = f"s AS (SELECT doc_id, unnest(l) AS sentence, unnest(range(0, len(l))) AS position, doc_id || ':' || unnest(range(0, len(l))) AS sid FROM (SELECT doc_id, {sentences_sql()} AS l FROM documents))"


def _core_sql(found: str) -> str:
    """CTE c(id, markets, components, operations, market, component, operation, amb) from a found CTE."""
    pairs = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in V.market_of().items()) + "}"
    inside = " OR ".join(f"len(list_filter(markets, lambda m: NOT list_contains([{', '.join(repr(x) for x in sorted(c))}], m))) = 0" for c in V.clusters())
    each = lambda d: f"coalesce(list_sort(list(DISTINCT label) FILTER (WHERE dimension = '{d}')), []) AS {d}s, arg_min(label, rank) FILTER (WHERE dimension = '{d}') AS {d}0"
    return f"""c0 AS (SELECT id, {", ".join(each(d) for d in ("market", "component", "operation"))} FROM {found} WHERE dimension IN ('market', 'component', 'operation') GROUP BY 1),
  c1 AS (SELECT *, list_distinct(list_filter(list_transform(components, lambda x: {pairs}[x]), lambda m: m IS NOT NULL)) AS inferred, {pairs}[component0] AS own FROM c0),
  c2 AS (SELECT *, coalesce(len(inferred) = 1 AND list_contains(markets, inferred[1]), false) AS settled FROM c1),
  c AS (SELECT id, markets, components, operations, CASE WHEN list_contains(markets, own) THEN own ELSE market0 END AS market, component0 AS component, operation0 AS operation,
    (len(components) > 1 AND NOT settled) OR (len(markets) > 1 AND NOT settled AND NOT ({inside})) AS amb FROM c2)"""


# ---------------------------------------------------------------------------------------------------- labels
def _rules(t, *dims):
    return R.rule_table(t.spark, [r for r in RULES if not dims or r[0] in dims])


def _found(t, *dims):
    return R.labels(t.table("documents"), _rules(t, *dims), "doc_id")


@q("tx04_rule_matches", f"WITH {_FOUND} SELECT id, dimension, label, hits FROM found")
def tx04(t):
    return _found(t).select("id", "dimension", "label", "hits")


@q("tx05_specificity", f"WITH {_FOUND} SELECT id, label, (-rank.a)::INT AS hits, (-rank.b)::INT AS weight, (-rank.c)::INT AS required FROM found")
def tx05(t):
    return _found(t).select("id", "label", "score.*")


@q("tx07_best_label", f"WITH {_FOUND} SELECT id, dimension, label FROM {_BEST}")
def tx07(t):
    return R.best_label(_found(t)).select("id", "dimension", "label")


@q("tx08_all_labels", f"WITH {_FOUND} SELECT id, dimension, string_agg(label, ',' ORDER BY rank) AS labels FROM found GROUP BY 1, 2")
def tx08(t):
    ordered = F.array_sort(F.collect_list(F.struct(R.rank().alias("r"), "label")))
    return _found(t).groupBy("id", "dimension").agg(F.array_join(F.transform(ordered, lambda x: x["label"]), ",").alias("labels"))


@q("tx09_domain_gate", f"WITH {found_sql('documents', 'doc_id', 'text', [r for r in RULES if r[0] == DOMAIN])} SELECT DISTINCT id FROM found")
def tx09(t):
    return _found(t, DOMAIN).select("id").distinct()


def _gated(t):
    """A row for each text: whether it passes both negative gates, and what the gates and the domain ask.

    source: a text on building the source itself: a cue, and neither operation nor architecture; instrument: one that measures with
    it: a cue, and no axis, operation or architecture.
    """
    d = t.table("documents").select(F.col("doc_id").alias("id"), "text")
    f = R.labelled(d, _rules(t, "operation", "architecture", DOMAIN), "text", {"source": SOURCE_CUES, "instrument": INSTRUMENT_CUES})
    of = lambda *dims: F.bool_or(F.exists("found", lambda x: x["dimension"].isin(*dims)))
    special = F.bool_or(F.exists("found", lambda x: (x["dimension"] == DOMAIN) & ~x["label"].isin(*GENERIC)))
    cue = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = f.groupBy("id").agg(cue("source").alias("s"), cue("instrument").alias("i"), of("operation", "architecture").alias("worked"), of(DOMAIN).alias("domain"), special.alias("special"))
    source, instrument = F.col("s") & ~F.col("worked"), F.col("i") & ~F.col("worked") & ~F.col("domain")
    return g.select("id", "special", source.alias("source"), instrument.alias("instrument"))


_GATES = f"""source_only AS (SELECT id FROM found_n WHERE {_any(SOURCE_CUES)} AND id NOT IN (SELECT id FROM found WHERE dimension IN ('operation', 'architecture'))),
  instrument_only AS (SELECT id FROM found_n WHERE {_any(INSTRUMENT_CUES)} AND id NOT IN (SELECT id FROM found WHERE dimension IN ('operation', 'architecture', '{DOMAIN}')))"""


@q("tx11_negative_gates", f"WITH {_FOUND}, {_GATES} SELECT id, 'source' AS gate FROM source_only UNION ALL SELECT id, 'instrument' FROM instrument_only")
def tx11(t):
    gate = lambda g: F.when(F.col(g), g)
    return _gated(t).select("id", F.explode(F.array_compact(F.array(gate("source"), gate("instrument")))).alias("gate"))


@q(
    "tx10_on_topic",
    f"WITH {_FOUND}, {_GATES} SELECT DISTINCT id FROM found WHERE dimension = '{DOMAIN}' AND label NOT IN {GENERIC} AND id NOT IN (SELECT id FROM source_only) AND id NOT IN (SELECT id FROM instrument_only)",
)
def tx10(t):
    return _gated(t).where("special AND NOT source AND NOT instrument").select("id")


@q("tx12_maturity", f"WITH d AS (SELECT doc_id AS id, {_pad('text')} AS t FROM documents) SELECT id, CASE {' '.join(f'WHEN {_any(w)} THEN {s!r}' for s, _, w in STAGES)} ELSE 'undetermined' END AS stage, CASE {' '.join(f'WHEN {_any(w)} THEN {b!r}' for _, b, w in STAGES)} ELSE 'unknown' END AS bucket FROM d")
def tx12(t):
    d = t.table("documents").select(F.col("doc_id").alias("id"), "text")
    d = R.labelled(d, R.rule_table(t.spark, []), "text", {s: terms for s, _, terms in STAGES})
    stage, bucket = F.lit("undetermined"), F.lit("unknown")
    for s, b, _ in reversed(STAGES):
        stage, bucket = F.when(F.col(s), s).otherwise(stage), F.when(F.col(s), b).otherwise(bucket)
    return d.select("id", stage.alias("stage"), bucket.alias("bucket"))


@q("tx43_match_terms", f"WITH {_FOUND} SELECT id, dimension, label, array_to_string(hits, ',') AS terms FROM found JOIN {_BEST} b USING (id, dimension, label)")
def tx43(t):
    return R.best_label(_found(t)).select("id", "dimension", "label", F.array_join("hits", ",").alias("terms"))


@q("tx32_document_tags", f"WITH {_FOUND} SELECT dimension, label, count(*) AS documents FROM found GROUP BY 1, 2")
def tx32(t):
    return _found(t).groupBy("dimension", "label").agg(n().alias("documents"))


@q("tx40_rejudged", f"WITH {_FOUND} SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT id FROM found) AND d.doc_id NOT IN (SELECT doc_id FROM labels)")
def tx40(t):
    none = t.table("documents").select("doc_id").join(_found(t).select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    return none.join(t.table("labels").select("doc_id"), "doc_id", "left_anti")


@q("st32_project_signals", f"WITH {_FOUND} SELECT label, count(*) AS signals, list_sort(list_distinct(list(d.source))) AS sources FROM found JOIN documents d ON d.doc_id = found.id GROUP BY 1")
def st32(t):
    s = _found(t).join(t.table("documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return s.groupBy("label").agg(n().alias("signals"), F.array_sort(F.collect_set("source")).alias("sources"))


# ---------------------------------------------------------------------------------------------------- sentences
def _lines():
    return T.sentences(F.col("text"))


@q("tx14_sentences", f"WITH {_EACH} SELECT doc_id, position, md5(sentence) AS digest FROM s")
def tx14(t):
    return t.table("documents").select("doc_id", F.posexplode(_lines()).alias("position", "s")).select("doc_id", F.col("position").cast("bigint").alias("position"), F.md5("s").alias("digest"))


OFFER_MOST = 320
_USABLE = f"""length(sentence) <= {OFFER_MOST} AND NOT regexp_matches(sentence, '(?i)doi\\.org|et al|conference|congress|proceedings|\\[\\s*pdf') AND NOT regexp_matches(sentence, '\\b[A-Z]\\.[,:]\\s') AND NOT {_any(V.NEGATION)}"""


def _guard(sentence, readable):
    return R.usable(sentence, readable, OFFER_MOST, True, True)


@q("tx15_usable_sentences", f"WITH {_EACH}, p AS (SELECT *, {_pad('sentence')} AS t FROM s) SELECT doc_id, position FROM p WHERE {_USABLE}")
def tx15(t):
    each = t.table("documents").select("doc_id", F.posexplode(_lines()).alias("position", "s"))
    return each.where(_guard(F.col("s"), F.col("s"))).select("doc_id", F.col("position").cast("bigint").alias("position"))


NAMES = ["Thon", "Erer"]
_MASKED = "regexp_replace(regexp_replace(sentence, '(?i)Thon', ' ', 'g'), '(?i)Erer', ' ', 'g')"
_IN_SENTENCES = f"""{_EACH}, m AS (SELECT *, {_MASKED} AS readable FROM s), p AS (SELECT *, {_pad("readable")} AS t FROM m), u AS (SELECT * FROM p WHERE {_USABLE}),
  {found_sql("u", "sid", "readable", [r for r in RULES if r[0] in ("market", "component")])},
  first AS (SELECT u.doc_id AS id, dimension, label, min(position) AS position FROM found JOIN u ON u.sid = found.id GROUP BY 1, 2, 3)"""


def _proofs(t):
    guard = lambda sentence, readable: R.usable(sentence, readable, OFFER_MOST, True)
    return R.sentence_labels(t.table("documents"), _rules(t, "market", "component"), _lines(), "doc_id", NAMES, guard, denied=V.NEGATION)


@q("tx16_sentence_labels", f"WITH {_IN_SENTENCES} SELECT first.id, dimension, label, first.position, md5(sentence) AS proof FROM first JOIN s ON s.doc_id = first.id AND s.position = first.position")
def tx16(t):
    return _proofs(t).select("id", "dimension", "label", F.col("position").cast("bigint").alias("position"), F.md5("sentence").alias("proof"))


@q("tx33_compiled", f"WITH {_IN_SENTENCES} SELECT a.label AS market, b.label AS component, count(*) AS documents FROM first a JOIN first b ON a.id = b.id AND a.dimension = 'market' AND b.dimension = 'component' GROUP BY 1, 2")
def tx33(t):
    of = lambda d: F.collect_set(F.when(F.col("dimension") == d, F.col("label"))).alias(d)
    pairs = _proofs(t).groupBy("id").agg(of("market"), of("component"))
    return pairs.select(F.explode("market").alias("market"), "component").select("market", F.explode("component").alias("component")).groupBy("market", "component").agg(n().alias("documents"))


@q(
    "tx27_offer_candidates",
    f"""WITH {_EACH}, {found_sql("s", "sid", "sentence", [r for r in RULES if r[0] in ("operation", DOMAIN)])}, k AS (SELECT id FROM found WHERE dimension = '{DOMAIN}'),
    o AS (SELECT s.doc_id, dimension, label, min(position) AS position, bool_or(found.id IN (SELECT id FROM k)) AS gate, max(len(hits)) AS terms FROM found JOIN s ON s.sid = found.id GROUP BY 1, 2, 3)
    SELECT doc_id, dimension, label, position, least(0.97, 0.70 + CASE WHEN gate THEN 0.08 ELSE 0 END + CASE WHEN terms > 1 THEN 0.05 ELSE 0 END)::DOUBLE AS confidence FROM o""",
)
def tx27(t):
    """An offer for each operation and each process: .08 more if the sentence passes the domain gate, .05 if several terms name it."""
    each = t.table("documents").select(F.col("doc_id").alias("doc"), F.posexplode(_lines()).alias("position", "sentence")).withColumn("sid", F.struct("doc", "position"))
    f = R.labels(each, _rules(t, "operation", DOMAIN), "sid", "sentence")
    gate = f.where(F.col("dimension") == DOMAIN).select("id").distinct().withColumn("gate", F.lit(True))
    g = f.join(gate, "id", "left").groupBy(F.col("id.doc").alias("doc_id"), "dimension", "label")
    g = g.agg(F.min("id.position").cast("bigint").alias("position"), F.coalesce(F.bool_or("gate"), F.lit(False)).alias("gate"), F.max(F.size("hits")).alias("terms"))
    c = F.lit(0.70) + F.when(F.col("gate"), 0.08).otherwise(0.0) + F.when(F.col("terms") > 1, 0.05).otherwise(0.0)
    return g.select("doc_id", "dimension", "label", "position", F.least(F.lit(0.97), c).alias("confidence"))


@q("tx22_guards", f"WITH {_EACH}, p AS (SELECT *, {_pad('sentence')} AS t FROM s) SELECT doc_id, position, {_any(V.NEGATION)} AS negated, {_any(V.PREDICATES)} AS asserted FROM p")
def tx22(t):
    each = t.table("documents").select("doc_id", F.posexplode(_lines()).alias("position", "s")).withColumn("p", R.padded(F.col("s")))
    return each.select("doc_id", F.col("position").cast("bigint").alias("position"), R.negated(F.col("p")).alias("negated"), R.asserted(F.col("p")).alias("asserted"))


# ---------------------------------------------------------------------------------------------------- core labels and relations
_CORE_RULES = [r for r in RULES if r[0] in ("market", "component", "operation")]


@q("tx19_core_labels", f"WITH {found_sql('documents', 'doc_id', 'text', _CORE_RULES)}, {_core_sql('found')} SELECT id, market, component, operation, len(markets)::INT AS markets, len(components)::INT AS components FROM c")
def tx19(t):
    c = R.core(_found(t, "market", "component", "operation"), V.market_of())
    return c.select("id", "market", "component", "operation", F.size("markets").alias("markets"), F.size("components").alias("components"))


def _sentence_labels(t):
    """(doc, position, sentence, found, negated, asserted) of every sentence; the labels stay in the row."""
    each = t.table("documents").select(F.col("doc_id").alias("doc"), F.posexplode(_lines()).alias("position", "sentence"))
    return R.labelled(each, _rules(t, *R.CORE), "sentence", {"negated": V.NEGATION, "asserted": V.PREDICATES})


def _sentence_core(t):
    return R.core_of(_sentence_labels(t), V.market_of()).withColumn("id", F.concat_ws(":", "doc", "position"))


_SENTENCE_CORE = f"{_EACH}, {found_sql('s', 'sid', 'sentence', _CORE_RULES)}, {_core_sql('found')}"


@q("tx21_ambiguous_window", f"WITH {_SENTENCE_CORE} SELECT id, amb AS ambiguous FROM c")
def tx21(t):
    return _sentence_core(t).select("id", R.ambiguous(V.clusters()).alias("ambiguous"))


@q(
    "tx44_confirming_sentence",
    f"""WITH {_SENTENCE_CORE}, w AS ({"WITH " + found_sql("documents", "doc_id", "text", _CORE_RULES, "whole") + ", " + _core_sql("whole") + " SELECT id, market, component, operation FROM c WHERE market IS NOT NULL AND component IS NOT NULL AND operation IS NOT NULL"}),
    p AS (SELECT *, {_pad("sentence")} AS t FROM s)
    SELECT w.id, min(position) AS position FROM w JOIN p ON p.doc_id = w.id JOIN c ON c.id = p.sid AND c.market = w.market AND c.component = w.component AND c.operation = w.operation
    WHERE NOT amb AND NOT {_any(V.NEGATION)} AND {_any(V.PREDICATES)} AND list_contains(markets, w.market) GROUP BY 1""",
)
def tx44(t):
    """The first sentence that resolves to its document's own triple, unambiguous, not denied, asserting it."""
    triple = ["market", "component", "operation"]
    whole = R.core(_found(t, *triple), V.market_of()).where("market IS NOT NULL AND component IS NOT NULL AND operation IS NOT NULL").select(F.col("id").alias("doc"), *triple)
    c = _sentence_core(t).where(~R.ambiguous(V.clusters()) & F.array_contains("markets", F.col("market")) & ~F.col("negated") & F.col("asserted"))
    own = c.select("doc", "position", *triple).join(whole, ["doc", *triple], "left_semi")
    return own.groupBy(F.col("doc").alias("id")).agg(F.min("position").cast("bigint").alias("position"))


#: A block of a page is a turn of a conversation: its heading is the turn before, its group the conversation, the page's title the first turn.
_WINDOWS = f"""b AS (SELECT conv_id, turn, conv_id || ':' || turn AS block, coalesce(text, '') AS text, coalesce(lag(text) OVER w, '') AS heading, coalesce(first_value(text) OVER w, '') AS title,
    concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS grouped FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  l AS (SELECT *, {sentences_sql("text")} AS ss FROM b),
  x AS (SELECT block, heading, title, ss, grouped, unnest(range(1, len(ss) + 1)) AS i FROM l),
  w0 AS (SELECT block, 0 AS level, i AS ord, ss[i] AS text, NULL::VARCHAR AS giver FROM x UNION ALL SELECT block, 1, i, ss[i], heading FROM x UNION ALL SELECT block, 2, i, ss[i] || ' ' || ss[i + 1], NULL FROM x WHERE i < len(ss)
    UNION ALL SELECT DISTINCT block, 3, 1, grouped, NULL FROM x UNION ALL SELECT block, 4, i, ss[i], title FROM x),
  w AS (SELECT *, block || ':' || level || ':' || ord AS wid FROM w0)"""
_MARKET_RULES = [r for r in RULES if r[0] == "market"]
_RELATION = f"""WITH {_WINDOWS}, texts AS (SELECT DISTINCT text FROM w), {found_sql("texts", "text", "text", _CORE_RULES)}, {_core_sql("found")},
  givers AS (SELECT DISTINCT giver FROM w WHERE giver IS NOT NULL), {found_sql("givers", "giver", "giver", _MARKET_RULES, "gf")},
  g AS (SELECT id, min(label) AS given FROM gf GROUP BY 1 HAVING count(*) = 1),
  j AS (SELECT w.block, w.level, w.ord, w.text, CASE WHEN level IN (1, 4) THEN g.given ELSE c.market END AS market, c.component, c.operation, amb, {_pad("w.text")} AS t FROM w JOIN c ON c.id = w.text LEFT JOIN g ON g.id = w.giver),
  r AS (SELECT block, arg_min(level, struct_pack(a := level, b := ord)) AS level, arg_min(text, struct_pack(a := level, b := ord)) AS win FROM j
    WHERE market IS NOT NULL AND component IS NOT NULL AND operation IS NOT NULL AND NOT amb AND NOT {_any(V.NEGATION)} AND {_any(V.PREDICATES)} GROUP BY 1)"""
_STRENGTH = "CASE level WHEN 0 THEN 'direct' WHEN 1 THEN 'contextual' WHEN 2 THEN 'contextual' WHEN 3 THEN 'structured' ELSE 'page_context' END"


def _relation(t):
    """Every text is labelled where it stands: a turn for the market it gives to others, then each sentence, pair and group once."""
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    empty = lambda c: F.coalesce(c, F.lit(""))
    c = R.labelled(t.table("conversations").select("conv_id", "turn", "text"), _rules(t, "market")).withColumn("gives", F.when(F.size("found") == 1, F.col("found")[0]["label"]))
    b = c.select(F.concat_ws(":", "conv_id", "turn").alias("block"), empty(F.col("text")).alias("text"), F.lag("gives").over(w).alias("heading"), F.first("gives").over(w).alias("title"), F.concat_ws(" ", F.lag("text").over(w), "text", F.lead("text").over(w)).alias("grouped"))
    b = b.withColumn("ss", T.sentences(F.col("text"))).where(F.size("ss") > 0)
    kind = lambda level, ord_, text: F.struct(F.lit(level).alias("level"), ord_.cast("int").alias("ord"), text.alias("text"))
    each = lambda level, text, last=0: F.transform(F.sequence(F.lit(1), F.size("ss") - last), lambda i: kind(level, i, text(i)))
    at = lambda i: F.try_element_at("ss", i)
    pairs = F.when(F.size("ss") > 1, each(2, lambda i: F.concat_ws(" ", at(i), at(i + 1)), 1)).otherwise(F.array().cast("array<struct<level:int,ord:int,text:string>>"))
    every = F.concat(each(0, at), pairs, F.array(kind(3, F.lit(1), F.col("grouped"))))
    windows = b.select("block", "heading", "title", F.explode(every).alias("w")).select("block", "heading", "title", "w.*")
    found = R.core_of(R.labelled(windows, _rules(t, *R.CORE), "text", {"negated": V.NEGATION, "asserted": V.PREDICATES}), V.market_of())
    # a sentence stands alone, under its heading and under the page's title
    under = lambda level, given: F.struct(F.lit(level).alias("level"), given.cast("string").alias("given"))
    levels = F.when(F.col("level") == 0, F.array(under(0, F.lit(None)), under(1, F.col("heading")), under(4, F.col("title")))).otherwise(F.array(F.struct("level", F.lit(None).cast("string").alias("given"))))
    return R.strongest(found.withColumn("u", F.explode(levels)).withColumn("level", F.col("u.level")).withColumn("given", F.col("u.given")), V.clusters())


@q("tx24_relation_cascade", f"{_RELATION} SELECT block, {_STRENGTH} AS strength, md5(win) AS window_md5 FROM r")
def tx24(t):
    return _relation(t).select("block", "strength", F.md5("window").alias("window_md5"))


@q("tx29_relation_strength", f"{_RELATION} SELECT {_STRENGTH} AS strength, count(*) AS n FROM r GROUP BY 1")
def tx29(t):
    return _relation(t).groupBy("strength").agg(n().alias("n"))


@q("tx31_career_signal", f"WITH {_FOUND} SELECT DISTINCT found.id FROM found JOIN found_n USING (id) WHERE dimension = '{DOMAIN}' AND {_any(CAREER)}")
def tx31(t):
    d = t.table("documents").select(F.col("doc_id").alias("id"), "text")
    f = R.labelled(d, _rules(t, DOMAIN), "text", {"career": CAREER})
    return f.groupBy("id").agg(F.bool_or("career").alias("career"), F.bool_or(F.size("found") > 0).alias("domain")).where("career AND domain").select("id")


@q(
    "tx37_context_mentions",
    f"""WITH s AS (SELECT conv_id, turn, concat_ws(' ', lag(text) OVER w, text, lead(text) OVER w) AS near, {_pad("coalesce(text, '')")} AS t, conv_id || ':' || turn AS sid FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    {found_sql("s", "sid", "near", [r for r in RULES if r[0] == DOMAIN])} SELECT conv_id, turn FROM s WHERE {_any(PROGRAMMES)} AND sid IN (SELECT id FROM found)""",
)
def tx37(t):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    s = t.table("conversations").select("conv_id", "turn", F.concat_ws(" ", F.lag("text").over(w), "text", F.lead("text").over(w)).alias("near"), "text").withColumn("id", F.struct("conv_id", "turn"))
    here = s.where(R.named(R.padded(F.coalesce("text", F.lit(""))), PROGRAMMES))
    return here.join(R.labels(here, _rules(t, DOMAIN), "id", "near").select("id").distinct(), "id", "left_semi").select("conv_id", "turn")


#: Confidence by a relation's strength; more for the domain and for each further dimension in the window; its bounds.
BASE = {"direct": 0.78, "structured": 0.74, "contextual": 0.70, "page_context": 0.66, "partial": 0.55}
FURTHER = ("material", "architecture", "process_technology", "machine_capability")


@q(
    "tx26_confidence_model",
    f"""{_RELATION}, ws AS (SELECT DISTINCT win FROM r), {found_sql("ws", "win", "win", [r for r in RULES if r[0] in FURTHER], "wf")}, k AS (SELECT id, count(DISTINCT dimension) AS dims, bool_or(dimension = '{DOMAIN}') AS domain FROM wf GROUP BY 1)
    SELECT block, round(greatest(0.70, least(0.98, CASE {_STRENGTH} {" ".join(f"WHEN '{a}' THEN {b}" for a, b in BASE.items())} END + CASE WHEN coalesce(domain, false) THEN 0.05 ELSE 0 END + 0.02 * coalesce(dims, 0))), 4)::DOUBLE AS confidence FROM r LEFT JOIN k ON k.id = r.win""",
)
def tx26(t):
    """Confidence of a full relation; a partial one may fall to .45 (tx25)."""
    r = R.labelled(_relation(t), _rules(t, *FURTHER), "window")
    dims = F.array_distinct(F.transform("found", lambda x: x["dimension"]))
    base = F.lit(None).cast("double")
    for a, b in BASE.items():
        base = F.when(F.col("strength") == a, b).otherwise(base)
    c = base + F.when(F.array_contains(dims, DOMAIN), 0.05).otherwise(0.0) + 0.02 * F.size(dims)
    return r.select("block", F.round(F.greatest(F.lit(0.70), F.least(F.lit(0.98), c)), 4).alias("confidence"))


@q("tx25_partial_two_of_three", f"WITH {_SENTENCE_CORE} SELECT id, (market IS NOT NULL)::INT + (component IS NOT NULL)::INT + (operation IS NOT NULL)::INT = 2 AND NOT amb AND len(markets) <= 1 AND len(components) <= 1 AS partial FROM c")
def tx25(t):
    known = sum((F.col(x).isNotNull().cast("int") for x in ("market", "component", "operation")), F.lit(0))
    single = (F.size("markets") <= 1) & (F.size("components") <= 1)
    return _sentence_core(t).select("id", ((known == 2) & ~R.ambiguous(V.clusters()) & single).alias("partial"))


@q(
    "tx28_reject_reasons",
    f"""WITH {_SENTENCE_CORE}, p AS (SELECT sid, {_pad("sentence")} AS t FROM s), x AS (SELECT CASE WHEN c.id IS NULL OR market IS NULL OR component IS NULL OR operation IS NULL THEN 'relation_too_weak' WHEN amb THEN 'ambiguous_window' WHEN {_any(V.NEGATION)} THEN 'relation_negated' WHEN NOT {_any(V.PREDICATES)} THEN 'relation_no_predicate' ELSE 'kept' END AS reason FROM p LEFT JOIN c ON c.id = p.sid)
    SELECT reason, count(*) AS n FROM x GROUP BY 1""",
)
def tx28(t):
    weak = F.col("market").isNull() | F.col("component").isNull() | F.col("operation").isNull()
    reason = F.when(weak, "relation_too_weak").when(R.ambiguous(V.clusters()), "ambiguous_window").when(F.col("negated"), "relation_negated").when(~F.col("asserted"), "relation_no_predicate").otherwise("kept")
    return R.core_of(_sentence_labels(t), V.market_of(), every=True).groupBy(reason.alias("reason")).agg(n().alias("n"))


_PATH = "lower(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '[-_/]', ' ', 'g') || ' ' || regexp_extract(html, '<title>(.*?)</title>', 1))"


@q("tx20_url_market", f"WITH u AS (SELECT page_id, {_PATH} AS words FROM pages), {found_sql('u', 'page_id', 'words', _MARKET_RULES)} SELECT id AS page_id, min(label) AS market FROM found GROUP BY 1 HAVING count(*) = 1")
def tx20(t):
    """The market that a page's address and title name, if it is only one."""
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1), "[-_/]", " ")
    p = t.table("pages").select("page_id", F.lower(F.concat(path, F.lit(" "), F.regexp_extract("html", "<title>(.*?)</title>", 1))).alias("words"))
    g = R.labels(p, _rules(t, "market"), "page_id", "words").groupBy(F.col("id").alias("page_id")).agg(n().alias("k"), F.min("label").alias("market"))
    return g.where("k = 1").select("page_id", "market")


#: Roles of a section from its heading, in order, and their terms in this vocabulary.
ROLES = (("publication", ("erre", "eran")), ("news", ("onan", "onnd")), ("project", ("anan", "anin")), ("application", ("then", "thin")), ("service", ("of", "der", "que")))


@q("tx23_section_role", f"WITH b AS (SELECT conv_id, turn, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS heading FROM conversations), p AS (SELECT conv_id, turn, {_pad('heading')} AS t FROM b) SELECT conv_id, turn, CASE {' '.join(f'WHEN {_any(w)} THEN {r!r}' for r, w in ROLES)} ELSE 'content' END AS section FROM p")
def tx23(t):
    from pyspark.sql import Window as W

    heading = F.coalesce(F.lag("text").over(W.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    p = t.table("conversations").select("conv_id", "turn", heading.alias("h")).select("conv_id", "turn", R.padded(F.col("h")).alias("t"))
    role = F.lit("content")
    for r, terms in reversed(ROLES):
        role = F.when(R.named(F.col("t"), terms), r).otherwise(role)
    return p.select("conv_id", "turn", role.alias("section"))


_NUMBERS = "list_distinct(regexp_extract_all(coalesce(text, ''), '[0-9]+'))"


@q(
    "tx39_page_diff",
    f"""WITH c AS (SELECT conv_id, turn, conv_id || ':' || turn AS cid, coalesce(text, '') AS text FROM conversations), {found_sql("c", "cid", "text", _CORE_RULES)},
    l AS (SELECT id, list_distinct(list(label)) AS labels FROM found GROUP BY 1), x AS (SELECT conv_id, turn, list_distinct({sentences_sql("text")}) AS b, coalesce(labels, []) AS l, {_NUMBERS} AS n FROM c LEFT JOIN l ON l.id = cid),
    v AS (SELECT conv_id, turn, b, l, n, lag(b) OVER w AS pb, lag(l) OVER w AS pl, lag(n) OVER w AS pn FROM x WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    d AS (SELECT conv_id, turn, 'block_added' AS change, unnest(list_filter(b, lambda y: NOT list_contains(pb, y))) AS value FROM v WHERE pb IS NOT NULL UNION ALL SELECT conv_id, turn, 'block_removed', unnest(list_filter(pb, lambda y: NOT list_contains(b, y))) FROM v WHERE pb IS NOT NULL
      UNION ALL SELECT conv_id, turn, 'lexicon_term_appeared', unnest(list_filter(l, lambda y: NOT list_contains(pl, y))) FROM v WHERE pb IS NOT NULL
      UNION ALL SELECT conv_id, turn, 'numeric_spec_changed', array_to_string(list_sort(n), ',') FROM v WHERE pb IS NOT NULL AND list_sort(n) <> list_sort(pn) AND len(n) > 0)
    SELECT conv_id, turn, change, md5(value) AS value FROM d""",
)
def tx39(t):
    """What a version (turn) has against the one before it: blocks added and removed, labels that appear, numbers that change."""
    from pyspark.sql import Window as W

    c = t.table("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.struct("conv_id", "turn"))
    found = R.labels(c, _rules(t, "market", "component", "operation"), "id", "text").groupBy("id").agg(F.collect_set("label").alias("l"))
    none = F.array().cast("array<string>")
    x = c.join(found, "id", "left").select("conv_id", "turn", F.array_distinct(T.sentences(F.col("text"))).alias("b"), F.coalesce("l", none).alias("l"), F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("([0-9]+)")))).alias("n"))
    w = W.partitionBy("conv_id").orderBy("turn")
    v = x.withColumns({f"p{k}": F.lag(k).over(w) for k in "bln"}).where("pb IS NOT NULL")
    kind = lambda name, values: F.transform(values, lambda y: F.struct(F.lit(name).alias("change"), y.alias("value")))
    numbers = F.when((F.col("n") != F.col("pn")) & (F.size("n") > 0), F.array(F.array_join("n", ","))).otherwise(none)
    every = F.concat(kind("block_added", F.array_except("b", "pb")), kind("block_removed", F.array_except("pb", "b")), kind("lexicon_term_appeared", F.array_except("l", "pl")), kind("numeric_spec_changed", numbers))
    return v.select("conv_id", "turn", F.explode(every).alias("d")).select("conv_id", "turn", "d.change", F.md5("d.value").alias("value"))


@q(
    "tx13_quote",
    f"""WITH x AS (SELECT doc_id, unnest(l) AS sentence, unnest(range(0, len(l))) AS position, doc_id || ':' || unnest(range(0, len(l))) AS sid FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM documents)),
    s AS (SELECT * FROM x), p AS (SELECT *, {_pad("sentence")} AS t FROM s), h AS (SELECT doc_id, position, sentence, list_distinct(flatten(list(list_filter(any_of || all_of, lambda x: {_hit("x")})))) AS terms FROM p, {_values([r for r in RULES if r[0] == "market"])} GROUP BY 1, 2, 3),
    b AS (SELECT doc_id AS id, arg_max(sentence, struct_pack(a := len(terms), b := least(length(sentence), 700), c := -position)) AS s, arg_max(terms, struct_pack(a := len(terms), b := least(length(sentence), 700), c := -position)) AS terms FROM h WHERE len(terms) > 0 GROUP BY 1),
    c AS (SELECT id, s, greatest(0, least(coalesce(list_min(list_filter(list_transform(terms, lambda x: position(x IN lower(s))), lambda p: p > 0)), 1) - 1 - 233, length(s) - 700)) AS o FROM b)
    SELECT id, md5(CASE WHEN length(s) <= 700 THEN s ELSE CASE WHEN o > 0 THEN '…' ELSE '' END || substring(s, (o + 1)::INT, 700) END) AS quote FROM c""",
)
def tx13(t):
    return R.quote(t.table("documents"), _rules(t, "market"), T.quotable(F.col("text")), "doc_id").select("id", F.md5("sentence").alias("quote"))
