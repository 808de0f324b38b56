"""Facts read from pages and texts by patterns and rules: certificates, graded classes, named offers, vocabulary proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules as R

#: Certificates and their patterns; grades of a clean room in the current and the former standard, and their context.
CERTIFICATES = (("ISO 9001", r"(?i)\bISO[ -]?9001\b"), ("ISO 13485", r"(?i)\bISO[ -]?13485\b"), ("ISO 14001", r"(?i)\bISO[ -]?14001\b"), ("AS 9100", r"(?i)\b(?:AS|EN)[ -]?9100\b"), ("IATF 16949", r"(?i)\bIATF[ -]?16949\b"))
GRADE_NOW, GRADE_BEFORE, GRADE_CONTEXT = r"(?i)ISO(?: class)?[ -]?([3-9])\b", r"(?i)\bclass ?(10{0,5})\b", r"(?i)clean ?rooms?|salle blanche|reinraum"
#: Names that aren't offers, and what makes a name one.
NOT_AN_OFFER = r"(?i)\b(?:brochure|flyer|datasheet|statistics|examples?|history|more about)\b|^\d+\s+(?:benefits|reasons|tips|ways|things|facts)\b"
OFFER_NOUN, MODEL_CODE = r"(?i)\b(?:machines?|systems?|platform|workstation|series|station|service)\b|[®™]", r"\b(?!(?:ISO|EN|DIN|IEC|ASTM|AS)\b)[A-Z]{1,5}[- ]?\d{2,5}[A-Z]?\b"
MOST_NAME, MOST_NAME_WORDS, MOST_SECTION_WORDS, MOST_DESCRIPTION = 80, 10, 7, 320


def certificates(texts: DataFrame, group: str, source: str, text: str, patterns=CERTIFICATES) -> DataFrame:
    """(group, code, source): each certificate that a group's texts name, with the least source that does."""
    codes = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(k)) for k, p in patterns]))
    return texts.select(group, source, F.explode(codes).alias("code")).groupBy(group, "code").agg(F.min(source).alias("source"))


def best_grade(texts: DataFrame, group: str, source: str, text: str, now: str = GRADE_NOW, before: str = GRADE_BEFORE, context: str = GRADE_CONTEXT) -> DataFrame:
    """(group, standard, grade, source): the least grade in the current standard, else in the former one, of texts in context."""
    each = lambda p, k: F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda x: F.struct(F.lit(k).alias("standard"), x.cast("long").alias("grade")))
    found = texts.where(F.col(text).rlike(context)).select(group, source, F.explode(F.concat(each(now, 0), each(before, 1))).alias("_g"))
    best = found.groupBy(group).agg(F.min(F.struct("_g.standard", "_g.grade", source)).alias("_b"))
    return best.select(group, F.when(F.col("_b.standard") == 0, "current").otherwise("former").alias("standard"), "_b.grade", F.col(f"_b.{source}").alias(source))


def nameable(name: Column, most_words: int = MOST_NAME_WORDS) -> Column:
    """Whether a heading can be an offer's name: short, capitalised, no sentence, question, list or brochure."""
    words = F.size(F.split(F.trim(name), r"\s+"))
    first = F.substring(name, 1, 1)
    fine = (F.length(name).between(1, MOST_NAME)) & (words <= most_words) & ~name.rlike(r"(?:[?.…])\s*$") & ~name.rlike(NOT_AN_OFFER)
    return F.coalesce(fine & ((F.lower(first) == F.upper(first)) | (first == F.upper(first))), F.lit(False))


def named_offers(blocks: DataFrame, rules: DataFrame, gate: str) -> DataFrame:
    """(page_id, name_key, name, kind, description, operations, status) from blocks (page_id, pos, title, heading, text).

    A page's title names an offer if it is nameable; a section's heading only if it names an operation, a gated label or a model itself.
    The page's description is the first block that names it, else the first one; descriptions end with their first sentence. An offer
    whose page passes the gate and whose name says what it is counts as accepted, others wait for review. One row for each name of a page.
    """
    sentence = lambda text, name: F.substring(F.split(F.trim(F.when(F.startswith(F.lower(text), F.lower(name)), F.substr(text, F.length(name) + 1)).otherwise(text)), r"(?<=[.!?])\s")[0], 1, MOST_DESCRIPTION)
    pages = blocks.groupBy("page_id").agg(F.first("title").alias("title"), F.min_by("text", F.struct(~F.contains(F.lower("text"), F.lower("title")), "pos")).alias("text"))
    page = pages.where(nameable(F.col("title"))).select("page_id", F.lit(-1).alias("pos"), F.col("title").alias("name"), F.lit("page").alias("kind"), sentence(F.col("text"), F.col("title")).alias("description"))
    section = blocks.where(nameable(F.col("heading"), MOST_SECTION_WORDS)).select("page_id", "pos", F.col("heading").alias("name"), F.lit("section").alias("kind"), sentence(F.col("text"), F.col("heading")).alias("description"))
    every = page.unionByName(section).withColumn("name_key", R.normalized("name"))
    one = every.groupBy("page_id", "name_key").agg(F.min_by(F.struct("name", "kind", "description"), "pos").alias("o")).select("page_id", "name_key", "o.*")
    one = one.withColumn("id", F.struct("page_id", "name_key")).withColumn("both", F.concat_ws(" ", "name", "description"))
    found = R.labels(one, rules, "id", "name").select("id").distinct().withColumn("says", F.lit(True))
    ops = R.labels(one, rules.where("dimension = 'operation'"), "id", "both").groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("operations"))
    scope = R.labels(blocks.select(F.struct("page_id", "pos").alias("id"), "text"), rules.where(F.col("dimension") == gate), "id", "text").select(F.col("id.page_id").alias("page_id")).distinct().withColumn("scope", F.lit(True))
    j = one.join(found, "id", "left").join(ops, "id", "left").join(scope, "page_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    model = F.col("name").rlike(MODEL_CODE)
    j = j.where((F.col("kind") == "page") | yes("says") | model)
    says = yes("says") | model | F.col("name").rlike(OFFER_NOUN)
    return j.select("page_id", "name_key", "name", "kind", "description", F.coalesce("operations", F.array().cast("array<string>")).alias("operations"), F.when(yes("scope") & says, "accepted").otherwise("review").alias("status"))


def proposals(words: DataFrame, rules: DataFrame, word: str, least: int = 2, most: int = 60) -> DataFrame:
    """Proposed terms that can enter the vocabulary: of a fit length, with a letter, and no variant of a known term."""
    known = R.term_table(rules).select(F.col("v").alias("_known")).distinct()
    fit = words.where(F.length(word).between(least, most) & F.col(word).rlike(r"\p{L}"))
    return fit.withColumn("_known", F.trim(R.padded(F.col(word)))).join(known, "_known", "left_anti").drop("_known")


def number_text(c: Column) -> Column:
    """A number's text with a point, without trailing zeros behind it."""
    return F.regexp_replace(F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"(\.\d*?)0+$", "$1"), r"\.$", "")


#: Measures of a capability: name -> (pattern of number and unit, context, least, most, which value counts).
MEASURES = {
    "pulse_fs": (r"(\d[\d.,]*)\s*fs\b", "", 100, 1500, "least"),
    "tolerance_um": (r"±\s*(\d[\d.,]*)\s*(?:µm|um|microns?)", "", 0, 1000, "least"),
    "feature_um": (r"(\d[\d.,]*)\s*(?:µm|um|microns?)", r"(?i)feature|structure|hole|resolution", 0.5, 200, "least"),
    "part_mm": (r"(\d[\d.,]*)\s*mm\b", r"(?i)part size|work ?piece|working area|up to", 0, 600, "most"),
}
_TOLERANCE = r"±\s*\d[\d.,]*\s*(?:µm|um|microns?|mm)"


def measures(texts: DataFrame, group: str, source: str, text: str, table: dict = MEASURES) -> DataFrame:
    """(group, measure, value, source, implausible): the best plausible value of each measure, and what was written but is out of range.

    A measure counts in texts that name its context; what stands behind a plus-minus sign is a tolerance and nothing else.
    """
    from factloom.functions.text import number

    bare = F.regexp_replace(text, _TOLERANCE, " ")
    value = lambda x: number(F.regexp_replace(x, "[.,]+$", ""))

    def met(name: str, pattern: str, context: str, least: float, most: float, which: str) -> Column:
        got = F.regexp_extract_all(F.col(text) if "±" in pattern else bare, F.lit(pattern), 1)
        got = F.when(F.col(text).rlike(context), got).otherwise(F.array().cast("array<string>")) if context else got
        return F.transform(got, lambda x: F.struct(F.lit(name).alias("measure"), value(x).alias("value"), value(x).between(least, most).alias("fit"), F.lit(which == "most").alias("up")))

    each = [met(name, *rest) for name, rest in table.items()]
    found = texts.where(F.col(text).isNotNull()).select(F.col(group).alias("_group"), F.col(source).alias("_source"), F.explode(F.concat(*each)).alias("_m")).select("_group", "_source", "_m.*").where("value IS NOT NULL")
    rank = F.struct(F.when(F.col("up"), -F.col("value")).otherwise(F.col("value")).alias("v"), "_source")
    best = found.groupBy("_group", "measure").agg(F.min_by(F.struct("value", "_source"), F.when(F.col("fit"), rank)).alias("b"), F.array_sort(F.collect_set(F.when(~F.col("fit"), F.col("value")))).alias("implausible"))
    return best.select(F.col("_group").alias(group), "measure", "b.value", F.col("b._source").alias(source), "implausible")
