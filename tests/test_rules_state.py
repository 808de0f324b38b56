"""Rule matching, folds, sources, pages and streams."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.functions import html as H
from factloom.functions import text as T
from factloom.operators import rules as R
from factloom.operators import state as X
from factloom.operators import vocabulary as V
from factloom.sources import landed
from factloom.streaming import folds

RULES = [
    ("op", "weld", 0, ["laser weld", "joining"], [], ["spot"], []),
    ("op", "cut", 1, ["cut", "trim"], ["beam"], [], []),
    ("mat", "glass", 0, ["glass"], [], [], ["thin", "clear"]),
    ("mat", "steel", 1, [], ["steel", "sheet"], [], []),
]


def met(term, text):
    """Whether a normalised text holds a term: whole words, blanks and hyphens alike, singular or plural."""
    body = r"[\s-]+".join(re.escape(x) for x in re.split(r"[\s-]+", R.normalize(term)) if x)
    plural = "" if R.normalize(term).endswith(("s", "x")) else "s?"
    return re.search(rf"(?<!\w){body}{plural}(?!\w)", text) is not None


def exhaustive(text, rules):
    """Every rule tried on a text: {(dimension, label): (hits, score)}."""
    low, out = R.normalize(text), {}
    for d, lab, ord_, a, b, c, e, *g in rules:
        g = g[0] if g else []
        if any(met(x, low) for x in c) or not all(met(x, low) for x in b):
            continue
        hits = [*b, *[x for x in a if met(x, low)], *[m.group(0) for p in g if (m := re.search(p, text, re.I))]]
        if hits and (not e or any(met(x, low) for x in e)):
            hits = list(dict.fromkeys(hits))
            out[d, lab] = (hits, ((3 if b else 0) + (1 if g else 0) + len(hits), sum(len(R.normalize(x)) for x in hits), len(b)), ord_)
    return out


def check_all(spark, texts, rules):
    df = spark.createDataFrame(texts, "id long, text string")
    found = R.labels(df, R.rule_table(spark, rules))
    got = {}
    for x in found.collect():
        got.setdefault(x.id, {})[x.dimension, x.label] = (x.hits, tuple(x.score), x.ord)
    want = {i: e for i, t in texts if (e := exhaustive(t or "", rules))}
    assert got == want
    best = {(x.id, x.dimension): x.label for x in R.best_label(found).collect()}
    for i, by in want.items():
        for d in {k[0] for k in by}:
            assert best[i, d] == max(((s, -o, lab) for (dd, lab), (_, s, o) in by.items() if dd == d))[2]


def test_indexed_matching_equals_exhaustive(spark):
    r = random.Random(4)
    pool = ["laser", "weld", "joining", "spot", "cut", "trim", "beam", "glass", "thin", "clear", "steel", "sheet", "of", "lasers", "welds", "-", ",", "GLASS"]
    texts = [(i, " ".join(r.choice(pool) for _ in range(r.randrange(0, 9)))) for i in range(300)]
    texts += [(900, None), (901, "Laser-Weld, GLASS thin"), (902, "ｌａｓｅｒ ｗｅｌｄ"), (903, "laser –  weld"), (904, "laser\u00a0weld"), (905, "laser, weld")]
    check_all(spark, texts, RULES)


def test_the_vocabulary_equals_exhaustive(spark):
    rules = V.vocabulary()
    assert len(rules) >= 150 and len({x[0] for x in rules}) == 7 and any(x[7] for x in rules)
    r = random.Random(9)
    pool = [V.word(i) for i in range(700)] + [V.word(i) + s for i in range(40) for s in ("s", "ing", "ed", "ly")] + ["the", "de", "of", "-", "."]
    check_all(spark, [(i, " ".join(r.choice(pool) for _ in range(r.randrange(3, 40)))) for i in range(120)], rules)


def test_patterns_read_the_text_as_it_stands(spark):
    rules = [("d", "a", 0, ["straße"], [], [], [], [r"ns\d{2}"]), ("d", "b", 1, ["µm/s"], [], [], [], [])]
    check_all(spark, [(0, "STRASSE"), (1, "Straße NS12"), (2, "ns１２"), (3, "10 µm/s"), (4, "NS 12")], rules)
    with pytest.raises(ValueError):
        R.rule_table(spark, [rules[0], rules[0]])


def test_sentences_masks_and_guards(spark):
    rules = [("d", "glass", 0, ["glass"], [], [], [], []), ("d", "steel", 1, ["steel"], [], [], [], []), ("o", "cut", 0, ["cut"], [], [], [], [])]
    text = "We work for Glass Corp today. It is not glass at all here; glass is cut by hand here. Steel et al. in proceedings. Steel is cut here too."
    df = spark.createDataFrame([(1, text)], "id long, text string")
    guard = lambda s, r: R.usable(s, r, 320, True, True)
    got = {(x.label, x.sentence) for x in R.sentence_labels(df, R.rule_table(spark, rules), T.sentences(F.col("text")), names=["glass corp"], guard=guard).where("dimension = 'd'").collect()}
    assert got == {("glass", "glass is cut by hand here."), ("steel", "Steel is cut here too.")}
    got = {x.label for x in R.sentence_labels(df, R.rule_table(spark, rules), T.sentences(F.col("text")), also=("o", "cut")).collect()}
    assert got == {"glass", "steel", "cut"}


def test_quote_is_cut_around_its_term(spark):
    rules = R.rule_table(spark, [("d", "glass", 0, ["glass"], [], [], [], [])])
    long = "x" * 900 + " glass " + "y" * 900
    df = spark.createDataFrame([(1, "Glass here. No more.\n" + long), (2, long), (3, "none")], "id long, text string")
    got = {x.id: x.sentence for x in R.quote(df, rules, T.quotable(F.col("text"))).collect()}
    assert set(got) == {1, 2} and all(len(q) == 701 and q[0] == "…" and "glass" in q for q in got.values())


def test_relation_levels(spark):
    names = {"market": ["optics", "energy"], "component": ["lens", "foil"], "operation": ["cutting"]}
    rules = R.rule_table(spark, [(d, x, i, [x], [], [], [], []) for d, xs in names.items() for i, x in enumerate(xs)])
    rows = [
        ("a", 0, "optics is for lens cutting"), ("a", 3, "optics lens cutting is"), ("b", 0, "lens cutting is"), ("b", 1, "lens cutting is"), ("c", 0, "optics is not lens cutting"), ("c", 4, "lens cutting is fine"),
        ("d", 0, "optics energy is lens cutting"), ("e", 2, "optics lens. cutting is"), ("f", 0, "optics lens cutting"), ("g", 0, "lens foil optics cutting is"),
    ]
    w = spark.createDataFrame([(i, b, k, i, t, "energy" if b in "bc" else None) for i, (b, k, t) in enumerate(rows)], "id long, block string, level int, ord int, text string, given string")
    got = {x.block: x.strength for x in R.relation(w, R.labels(w, rules), {"foil": "energy"}, [{"optics"}]).collect()}
    assert got == {"a": "direct", "b": "contextual", "c": "page_context", "e": "contextual"}


def test_overlay_and_extension(spark):
    more = R.extend(RULES, "cut", ["slice", "cut"])
    assert more[1][3] == ["cut", "trim", "slice"]
    own = R.rule_table(spark, [("op", "cut", 1, ["saw"], [], [], [])])
    got = {r.label: r.any_of for r in R.overlay(R.rule_table(spark, RULES), own).collect()}
    assert got["cut"] == ["saw"] and len(got) == 4


def _fold(old, new):
    return X.fold(old, new, ["k"], {"bucket": X.highest(), "lang": X.keep, "seen": X.total, "at": X.most, "reviewed": X.keep}, ["at"], "reviewed")


def test_fold_laws(spark):
    schema = "k long, bucket string, lang string, seen long, at long, reviewed boolean"
    old = spark.createDataFrame([(1, "radar", None, 1, 1, False), (2, "rejected", "en", 1, 1, True)], schema)
    new = spark.createDataFrame([(1, "existing", "fr", 1, 2, False), (1, "pending", "de", 1, 3, False), (2, "existing", "xx", 1, 2, False), (3, "radar", None, 1, 2, False)], schema)
    got = {r.k: (r.bucket, r.lang, r.seen, r.at) for r in _fold(old, new).collect()}
    assert got == {1: ("existing", "fr", 3, 3), 2: ("rejected", "en", 1, 1), 3: ("radar", None, 1, 2)}
    again = {r.k: (r.bucket, r.lang, r.at) for r in _fold(_fold(old, new), new.limit(0)).collect()}
    assert again == {k: (v[0], v[1], v[3]) for k, v in got.items()}


def test_stream_equals_batch(spark, tmp_path):
    schema = "k long, bucket string, lang string, seen long, at long, reviewed boolean"
    rows = [(i % 3, ["radar", "existing", "pending"][i % 3], "en" if i % 2 else None, 1, i, False) for i in range(12)]
    for n in range(3):
        spark.createDataFrame(rows[n * 4 : n * 4 + 4], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    empty = spark.createDataFrame([], schema)
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = folds.upsert_stream(arrivals, f"{tmp_path}/state", f"{tmp_path}/cp", _fold, empty, ["k"], 4)
    q.awaitTermination()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state" / "index").iterdir())
    named = {(r.bucket, r.version) for n in (last - 1, last) for r in spark.read.parquet(f"{tmp_path}/state/index/batch={n}").collect()}
    held = {(int(b.name.split("=")[1]), int(v.name.split("=")[1])) for v in (tmp_path / "state" / "data").iterdir() for b in v.iterdir() if b.name.startswith("state_bucket=")}
    assert held == named  # nothing older is kept
    key = lambda df: sorted((r.k, r.bucket, r.seen, r.at) for r in df.collect())
    assert key(folds.read_state(spark, f"{tmp_path}/state", last, empty)) == key(_fold(empty, spark.createDataFrame(rows, schema)))


def test_windowed_stream(spark, tmp_path):
    spark.sql("SELECT TIMESTAMP '2024-01-01 00:10:00' AS ts, 'a' AS event_type, 1.0D AS value UNION ALL SELECT TIMESTAMP '2024-01-01 00:50:00', 'a', 2.0D").write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(f"{tmp_path}/e")
    q = folds.windowed_counts(events).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.value) for r in spark.table("w").collect()] == [(2, 3.0)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name;n\nx;1\né\xff;2\n".encode("latin-1"))
    assert [r.n for r in landed.read_delimited(spark, str(tmp_path / "a.csv"), "name string, n int").collect()] == [1, 2]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> T </title><link>http://x</link><pubDate>d</pubDate></item></channel></rss>")
    assert landed.read_feed(spark, str(tmp_path / "f.xml")).first().title == "T"
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://a</loc><lastmod>2024-01-01</lastmod></url><url><loc>http://b</loc></url></urlset>")
    assert {r["loc"] for r in landed.read_sitemap(spark, str(tmp_path / "s.xml")).collect()} == {"http://a", "http://b"}
    (tmp_path / "j.json").write_text('{"results": [{"id": 1}, {"id": 2}]}')
    assert landed.read_json_pages(spark, str(tmp_path / "j.json"), "results array<struct<id:long>>", "results").count() == 2
    pages = spark.sql("SELECT 1L AS page_id, TIMESTAMP '2024-01-02' AS fetched_at, '[{\"heading\":\"h\",\"text\":\"t\"}]' AS blocks_json UNION ALL SELECT 2, TIMESTAMP '2024-01-02', 'broken' UNION ALL SELECT 3, TIMESTAMP '2020-01-01', '[]'")
    assert [(r.page_id, r.text) for r in landed.stored_blocks(pages, "2024-01-03", 48).collect() if r.text] == [(1, "t")]
    landed.write_csv(spark.sql("SELECT 'a,b' AS x, 1 AS y"), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_bytes()
    assert text == b'x,y\r\n"a,b",1\r\n'


def test_landed_archives_and_answers(spark, tmp_path):
    import gzip
    import zipfile

    with zipfile.ZipFile(tmp_path / "projects.zip", "w") as z:
        z.writestr("csv/organization.csv", "id;name\n1;\"A; é\"\n2;B\n")
        z.writestr("csv/other.csv", "x\n")
    got = landed.read_zip_member(spark, str(tmp_path / "*.zip"), "organization.csv", "id long, name string")
    assert [(r.id, r.name) for r in got.orderBy("id").collect()] == [(1, "A; é"), (2, "B")]
    (tmp_path / "maps").mkdir()
    (tmp_path / "maps" / "index.xml").write_text("<sitemapindex><sitemap><loc>https://x.org/a.xml</loc></sitemap><sitemap><loc>https://x.org/b.xml.gz</loc></sitemap></sitemapindex>")
    (tmp_path / "maps" / "a.xml").write_text("<urlset><url><loc>http://a</loc></url></urlset>")
    (tmp_path / "maps" / "b.xml.gz").write_bytes(gzip.compress(b"<urlset><url><loc>http://b</loc><lastmod>2024-01-01</lastmod></url></urlset>"))
    (tmp_path / "maps" / "c.xml").write_text("<urlset><url><loc>http://c</loc></url></urlset>")
    assert {r["loc"] for r in landed.read_sitemap_index(spark, str(tmp_path / "maps"), "index.xml").collect()} == {"http://a", "http://b"}
    (tmp_path / "atom.xml").write_text("<feed><entry><id>1</id><title>T</title><published>2024</published></entry></feed>")
    assert [tuple(r) for r in landed.read_atom(spark, str(tmp_path / "atom.xml")).collect()] == [("1", "T", "2024")]
    (tmp_path / "answers").mkdir()
    for i in range(3):
        (tmp_path / "answers" / f"page-{i}.json").write_text(f'{{"cursor": {i}, "results": [{{"id": {i}, "title": "Fast cutting {i}"}}, {{"id": {i + 10}, "title": "slow"}}]}}')
    schema = "cursor int, results array<struct<id:long,title:string>>"
    assert landed.read_json_pages(spark, str(tmp_path / "answers"), schema, "results", cursor="cursor", most_pages=2).count() == 4
    assert {r.id for r in landed.search_rows(landed.read_json_pages(spark, str(tmp_path / "answers"), schema, "results"), "title", ["fast CUTTING"]).collect()} == {0, 1, 2}
    (tmp_path / "cdx.txt").write_text("urlkey timestamp original\norg,x)/ 20200101000000 http://x.org/\norg,x)/ 20190101000000 http://x.org/\n")
    assert [r.stamp for r in landed.read_snapshots(spark, str(tmp_path / "cdx.txt")).collect()] == ["20190101000000", "20200101000000"]
    (tmp_path / "p.xml").write_text('<r><exchange-document country="EP" doc-number="1"><title lang="de">t</title><title lang="en">Title</title><applicant>A</applicant><date>20240102</date></exchange-document></r>')
    assert [tuple(r) for r in landed.read_patents(spark, str(tmp_path / "p.xml")).collect()] == [("EP1", "Title", ["A"], "2024-01-02")]
    assert landed.query_text("TechnoAlpine \"x\" (y)") == 'TechnoAlpine \\"x\\" (y)'
    registry = spark.createDataFrame([("l1", "A"), ("l2", "B")], "lei string, name string")
    assert [tuple(r) for r in landed.lookup(registry, spark.createDataFrame([("l2",), ("l9",)], "lei string"), "lei").orderBy("lei").collect()] == [("l2", "B"), ("l9", None)]
    listed = spark.createDataFrame([("Partners 2020", "u1"), ("projets", "u2")], "title string, url string")
    assert [r.url for r in landed.resources(listed, ["2020"]).collect()] == ["u1"]


def test_versions_and_export(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a"b;c'), (2, None)], "k int, t string")
    for day in ("2024-01-01", "2024-01-02", "2024-01-03"):
        landed.write_version(df, str(tmp_path / "v"), day)
    assert landed.prune_versions(spark, str(tmp_path / "v"), 2) == ["2024-01-01"] and sorted(p.name for p in (tmp_path / "v").iterdir()) == ["stamp=2024-01-02", "stamp=2024-01-03"]
    assert landed.export_csv(df) == b'\xef\xbb\xbfk;t\r\n1;"a""b;c"\r\n2;\r\n'
    assert landed.emptied(df).count() == 0 and landed.emptied(df).schema == df.schema


def test_page_parser():
    page = """<html lang=fr><head><title>T &amp; u</title><meta property="article:published_time" content="2024-05-06T01:02"></head><body><nav><a href=/n>menu</a></nav>
    <h1>Top</h1><p>One <b>bold</b> word</p><div class="cookie banner"><p>accept</p></div><h2>Sub</h2><p>Two <a href="https://other.org/x#y">link</a></p><p>Two <a href="/z">link</a></p><script>var a = "</p>";</script></body></html>"""
    p = H.parse(page, "https://me.org/")
    assert (p["title"], p["lang"], p["published"]) == ("T & u", "fr", "2024-05-06")
    assert [(b["heading"], b["text"], b["path"]) for b in p["blocks"]] == [("Top", "One bold word", "Top"), ("Sub", "Two link", "Top > Sub")]
    assert (p["n_links"], p["n_outbound"]) == (2, 1)
    assert H.parse("")["blocks"] == []


def test_parse_pages_keeps_all_rows(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", "<p>x</p>")], "page_id long, url string, html string")
    assert {r.page_id: r.n for r in H.parse_pages(df).select("page_id", F.size("blocks").alias("n")).collect()} == {1: 0, 2: 1}
