"""Scalar text functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks, and the plain letters they fold to.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def squeeze(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column) -> Column:
    """Lower case without marks."""
    return F.lower(F.translate(c, MARKED, PLAIN))


def slug(c: Column, default: str = "unknown") -> Column:
    s = F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.when(s != "", s), F.lit(default))


def org_key(c: Column) -> Column:
    """Upper-case name without marks and punctuation."""
    return F.upper(F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")))


def doi(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?i)^https?://(dx\.)?doi\.org/", ""))


def strip_tags(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, "<[^>]+>", " "))


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), "^www\\.", ""))


def root_domain(url: Column) -> Column:
    """The host's last two labels."""
    labels = F.split(host(url), r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, path without a closing slash, no query and no fragment."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("HOST"))), path)


def language_of_url(url: Column, known: tuple[str, ...] = ("fr", "en", "de", "es")) -> Column:
    """Language named by a path segment, else by the first label of the host; null if neither does."""
    choice = "|".join(known)
    by_path = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), rf"^/({choice})(?:/|$)", 1)
    by_host = F.regexp_extract(F.coalesce(host(url), F.lit("")), rf"^({choice})\.", 1)
    return F.coalesce(F.when(by_path != "", by_path), F.when(by_host != "", by_host))


def shingles(words: Column, k: int = 3) -> Column:
    """Distinct runs of k words; all words as one if there are fewer."""
    n = F.size(words)
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(k)), " ")))


def inverted_index(words: Column) -> Column:
    """(word, at) of each distinct word, at being its places from 0 on."""
    let = lambda value, body: F.element_at(F.transform(F.array(value), body), 1)  # noqa: E731  # value is worked out once, not in each step of the body
    entries = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    word = lambda s, k: F.element_at(s, k)["w"]
    starts = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: (k == 1) | (word(s, k) != word(s, F.greatest(k - 1, F.lit(1)))))
    after = lambda s, b, j: F.coalesce(F.get(b, j + 1), F.size(s) + 1)
    entry = lambda s, b: F.transform(b, lambda k, j: F.struct(word(s, k).alias("word"), F.transform(F.slice(s, k, after(s, b, j) - k), lambda e: e["i"]).alias("at")))
    index = let(entries, lambda s: let(starts(s), lambda b: entry(s, b)))
    return F.when(F.size(words) > 0, index).otherwise(F.when(words.isNotNull(), F.array().cast("array<struct<word:string,at:array<int>>>")))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def number(c: Column) -> Column:
    """A number written with spaces, a comma or a point; null if it isn't one."""
    bare = F.regexp_replace(c, r"[\s  ]", "")
    dots = F.when(F.instr(bare, ",") > F.instr(bare, "."), F.regexp_replace(F.regexp_replace(bare, r"\.", ""), ",", ".")).otherwise(F.regexp_replace(bare, ",", ""))
    return dots.try_cast("double")


def sentences(text: Column, least: int = 12) -> Column:
    """Sentences of at least so many characters; bullets and semicolons end one, too."""
    clean = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.filter(F.transform(F.split(clean, r"(?<=[.!?]) +| *[•·▪◦;] *"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)


def quotable(text: Column) -> Column:
    """Sentences of any length; line breaks end one, too."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+|\n+"), lambda s: squeeze(s)), lambda s: s != "")
