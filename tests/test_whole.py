"""Queries that once read only a part of their input, against the whole of it."""

import hashlib
import re

import pytest

from factloom.plans import registry

from .oracle import SF, same

QUERIES = registry.queries()
#: The whole job in SQL, where the twin beside the query still has the cut.
WHOLE = {
    "jn30_roster_first": """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, list_filter(w, lambda x: x IN ('the', 'der', 'les', 'que', 'of', 'un'))[1] AS matched FROM w""",
    "st22_vocabulary_queue": "SELECT w, count(*) AS seen, count(*) >= 150 AS promoted FROM (SELECT DISTINCT doc_id, unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY 1",
    "st35_schema_evolution": "SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages",
    "fn28_inverted_index": "SELECT doc_id, md5(left(array_to_string(string_split(text, ' '), ' '), 6000)) AS abstract FROM documents",
    "ag23_term_scoreboard": """SELECT term, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0) AS rejected
    FROM (SELECT DISTINCT d.doc_id, l.quality, unnest(string_split(lower(text), ' ')) AS term FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IN (0, 1)) GROUP BY 1""",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_input(spark, name):
    same(spark, QUERIES[name], WHOLE[name])


def documents(spark, folder, texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_roster_match_at_any_place(spark, tmp_path):
    texts = ["x " * 30 + "der of", "of\nthe", "x y", "", None, "x " * 5000 + "UN", "x x x the x of"]
    got = {r.doc_id: r.matched for r in QUERIES["jn30_roster_first"](spark, documents(spark, tmp_path, texts)).collect()}
    roster = {"the", "der", "les", "que", "of", "un"}
    assert got == {i: next((w for w in re.split(r"[ \t\n\x0B\f\r]+", (t or "").lower()) if w in roster), None) for i, t in enumerate(texts)}
    assert got[0] == "der" and got[5] == "un"


def test_index_in_the_row(spark, tmp_path):
    from pyspark.sql import functions as F

    from factloom.functions import text as T

    texts = ["a b a", "", None, " x  x ", "word " * 3000 + "end"]
    folder = documents(spark, tmp_path, texts)
    df = QUERIES["fn28_inverted_index"](spark, folder)
    got = {r.doc_id: r.abstract for r in df.collect()}
    assert got == {i: t if t is None else hashlib.md5(t[:6000].encode()).hexdigest() for i, t in enumerate(texts)}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    words = F.split("text", " ")
    got = {r.doc_id: r.x and {e.word: e.at for e in r.x} for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", T.inverted_index(words).alias("x")).collect()}
    want = {i: t if t is None else {w: [p for p, x in enumerate(t.split(" ")) if x == w] for w in t.split(" ")} for i, t in enumerate(texts)}
    assert got == want
