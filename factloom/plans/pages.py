"""Pages, sources and streaming-shaped queries on the landed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import blocks as B
from factloom.functions.html import parse_pages
from factloom.sources import landed

from .base import Book

book = Book()
QUERIES, ORACLE = book.QUERIES, book.ORACLE
q = book.query


@q("src01_table_scan", "SELECT n_name, n_regionkey FROM nation")
def src01(t):
    return t.table("nation").select("n_name", "n_regionkey")


@q("src02_scalar", "SELECT max(o_totalprice) AS most FROM orders")
def src02(t):
    return t.table("orders").agg(F.max("o_totalprice").alias("most"))


@q("src18_pushed_filter", "SELECT part_id FROM (SELECT p_partkey AS part_id, string_split(p_name, ' ') AS codes FROM part) WHERE len(list_filter(codes, lambda c: starts_with(c, 're'))) > 0")
def src18(t):
    p = t.table("part").select(F.col("p_partkey").alias("part_id"), F.split("p_name", " ").alias("codes"))
    return landed.array_prefix_filter(p, "codes", "re").select("part_id")


@q("src19_two_shapes", "SELECT 'T:' || o_orderkey AS id, o_orderstatus AS title, o_custkey::VARCHAR AS buyer, o_orderpriority AS published FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'B:' || o_orderkey, o_orderstatus, o_custkey::VARCHAR, o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def src19(t):
    o = t.table("orders").select(F.col("o_orderkey").cast("string").alias("k"), "o_orderkey", F.col("o_orderstatus").alias("s"), F.col("o_custkey").cast("string").alias("c"), F.col("o_orderpriority").alias("p"))
    a = o.where("o_orderkey % 2 = 0").select(F.col("k").alias("notice"), F.col("s").alias("title"), F.col("c").alias("buyer"), F.col("p").alias("date"))
    b = o.where("o_orderkey % 2 = 1").select(F.col("k").alias("ref"), F.col("s").alias("objet"), F.col("c").alias("acheteur"), F.col("p").alias("parution"))
    return landed.tenders(a, b)


@q("src22_pooled_first", "SELECT o_custkey AS buyer_id, min(o_orderkey) AS offer_id FROM orders GROUP BY 1")
def src22(t):
    o = t.table("orders").select(F.col("o_custkey").alias("buyer_id"), F.col("o_orderkey").alias("offer_id"), F.col("o_orderkey").alias("arrival"))
    return landed.first_per_key([o.where("offer_id % 2 = 0"), o.where("offer_id % 2 = 1")], "buyer_id", "arrival").select("buyer_id", "offer_id")


@q("src27_source_registry", "SELECT * FROM (VALUES ('registry', 'organisations', true, 'ready'), ('projects', 'funding', true, 'ready'), ('press', 'articles', true, 'ready'), ('patents', 'filings', false, 'needs_key')) v(name, kind, configured, status)")
def src27(t):
    return landed.source_registry(t.spark)


@q("snk01_insert_if_absent", "SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders)")
def snk01(t):
    from factloom.operators.state import insert_missing

    k = t.table("orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    return insert_missing(k.where("o_orderkey % 3 = 0").select("k").distinct(), k.where("o_orderkey % 3 <> 0").select("k").distinct(), ["k"]).agg(F.count(F.lit(1)).alias("n"))


@q("snk05_keep_versions", "SELECT stamp FROM (SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS stamp FROM events) WHERE stamp NOT IN (SELECT DISTINCT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS s FROM events ORDER BY s DESC LIMIT 7)")
def snk05(t):
    return landed.stale_versions(t.runs.select(F.date_format("day", "yyyy-MM-dd").alias("stamp")).distinct(), 7)


@q("ht09_parse_pages")
def ht09(t):
    p = parse_pages(t.table("pages"))
    return p.select("page_id", "title", "lang", "published", "n_links", "n_outbound", F.size("blocks").alias("n_blocks"), "coverage")


def _documents(t):
    return B.documents(t.table("pages"))


@q("ht02_links")
def ht02(t):
    d = _documents(t).select("page_id", F.explode(F.concat(F.transform("links", lambda x: F.struct(x["url"].alias("url"), x["category"].alias("category"), x["score"].alias("score"))), F.transform("outbound", lambda x: F.struct(x["url"].alias("url"), F.lit("outbound").alias("category"), F.lit(0).cast("long").alias("score"))))).alias("l"))
    return d.select("page_id", "l.*")


@q("ht04_editorial_blocks")
def ht04(t):
    d = _documents(t).select("page_id", F.posexplode("blocks").alias("pos", "b"))
    return d.select("page_id", "pos", "b.kind", "b.heading", "b.level1", "b.level2", F.md5("b.text").alias("digest"))


@q("ht07_page_quality")
def ht07(t):
    return _documents(t).select("page_id", "coverage", "useful", "noise", "oversized", "score")


@q("ht08_render_required")
def ht08(t):
    return _documents(t).select("page_id", "render")


@q("src12_feed_discovery", """SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS href FROM pages""")
def src12(t):
    """Addresses that a page links to, as a discovery pass reads them from the source text."""
    return t.table("pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1))).alias("href"))


@q("snk02_upsert_overwrite", "SELECT o_custkey AS k, arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS last FROM orders GROUP BY 1")
def snk02(t):
    from factloom.operators import state as X

    o = t.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("last"), "o_orderdate", "o_orderkey")
    cut = F.lit("1998-01-01").cast("date")
    return X.fold(o.where(F.col("o_orderdate").cast("date") < cut), o.where(F.col("o_orderdate").cast("date") >= cut), ["k"], {"last": X.replace}, ["o_orderdate", "o_orderkey"])


@q("snk03_upsert_do_nothing", "SELECT o_custkey AS k, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS first FROM orders GROUP BY 1")
def snk03(t):
    from factloom.operators import state as X

    o = t.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("first"), "o_orderdate", "o_orderkey")
    cut = F.lit("1998-01-01").cast("date")
    return X.fold(o.where(F.col("o_orderdate").cast("date") < cut), o.where(F.col("o_orderdate").cast("date") >= cut), ["k"], {"first": X.keep}, ["o_orderdate", "o_orderkey"])


@q("hourly_events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly(t):
    # the batch form of the streaming windows
    e = t.table("events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
