"""Landed files: the sources whose network part is out of the engine, and the sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY = [("registry", "organisations", True), ("projects", "funding", True), ("press", "articles", True), ("patents", "filings", False)]


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    """Delimited text with a header; undecodable bytes are replaced, short rows are filled with nulls."""
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("mode", "PERMISSIVE").option("encoding", "UTF-8").csv(path)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """(title, link, published) of RSS items."""
    raw = spark.read.schema("title string, link string, pubDate string").option("rowTag", "item").format("xml").load(path)
    return raw.select(F.trim("title").alias("title"), F.trim("link").alias("link"), F.col("pubDate").alias("published"))


def read_atom(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, published) of Atom entries."""
    return spark.read.schema("id string, title string, published string").option("rowTag", "entry").format("xml").load(path)


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """(loc, lastmod) of sitemap entries; gzip is read by the file's name."""
    return spark.read.schema("loc string, lastmod string").option("rowTag", "url").format("xml").load(path)


def read_sitemap_index(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """Entries of the landed sitemaps that an index names, by their file names."""
    listed = spark.read.schema("loc string").option("rowTag", "sitemap").format("xml").load(f"{folder}/{index}")
    names = listed.select(F.regexp_extract(F.trim("loc"), r"([^/?#]+)(?:[?#].*)?$", 1).alias("_name")).distinct()
    maps = spark.read.schema("loc string, lastmod string").option("rowTag", "url").format("xml").load(folder)
    named = maps.withColumn("_name", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))
    return named.join(names, "_name", "left_semi").select("loc", "lastmod")


def read_zip_member(spark: SparkSession, path: str, member: str, schema: str, sep: str = ";", most_rows: int = 10_000) -> DataFrame:
    """Rows of a delimited member (by the end of its name) of landed ZIP files, streamed from the archive in blocks of rows.

    One file is one task, as a ZIP can't be entered in the middle of a member. Undecodable bytes are replaced, short rows are
    filled with nulls; fields that don't fit their type are null.
    """
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema).fields]

    def run(frames):
        import csv
        import io
        import zipfile

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for name in z.namelist():
                        if not name.endswith(member):
                            continue
                        with z.open(name) as raw:
                            rows, held = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline=""), delimiter=sep), []
                            for row in rows:
                                held.append([row.get(c) for c in names])
                                if len(held) >= most_rows:
                                    yield pd.DataFrame(held, columns=names, dtype="object")
                                    held = []
                            yield pd.DataFrame(held, columns=names, dtype="object")

    files = spark.read.format("binaryFile").load(path).select("content")
    text = files.mapInPandas(run, ", ".join(f"`{c}` string" for c in names))
    return text.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in _parse_datatype_string(schema).fields])


def read_json_pages(spark: SparkSession, path: str, schema: str, rows: str, cursor: str | None = None, most_pages: int | None = None) -> DataFrame:
    """Rows of an array inside each landed JSON answer; malformed answers give none. Of a walk by cursor, its first pages at most."""
    one = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    if cursor and most_pages is not None:
        one = one.orderBy(cursor).limit(most_pages)
    return one.select(F.explode(rows).alias("r")).select("r.*")


def search_rows(rows: DataFrame, column: str, phrases: list[str]) -> DataFrame:
    """Answers to a keyword search, checked once more: rows whose text holds a phrase, in any case."""
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(F.lower(column), F.lit(p.lower()))
    return rows.where(out)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(key, stamp, url) of a landed list of archive snapshots, oldest first."""
    parts = F.split("value", " ")
    return spark.read.text(path).where(~F.startswith("value", F.lit("urlkey "))).select(parts[0].alias("key"), parts[1].alias("stamp"), parts[2].alias("url")).orderBy("stamp", "url")


def read_patents(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, applicants, published) of landed patent documents; the English title first, else the first one."""
    schema = "_country string, `_doc-number` string, title array<struct<_VALUE:string,_lang:string>>, applicant array<string>, date string"
    raw = spark.read.schema(schema).option("rowTag", "exchange-document").format("xml").load(path)
    english = F.filter("title", lambda x: x["_lang"] == "en")
    title = F.coalesce(F.try_element_at(english, F.lit(1))["_VALUE"], F.try_element_at("title", F.lit(1))["_VALUE"])
    day = F.regexp_replace("date", r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return raw.select(F.concat("_country", F.col("`_doc-number`")).alias("id"), title.alias("title"), F.coalesce("applicant", F.array().cast("array<string>")).alias("applicants"), day.alias("published"))


def query_text(value: str) -> str:
    """A value between the quotes of a query: backslashes and quotes are escaped."""
    return value.replace("\\", "\\\\").replace('"', '\\"')


def lookup(registry: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Registry rows of exact ids; an unknown id has nulls."""
    return ids.select(key).distinct().join(registry, key, "left")


def resources(catalog: DataFrame, suffixes: list[str]) -> DataFrame:
    """Rows of a catalog whose title ends with one of the suffixes, in any case."""
    out = F.lit(False)
    for s in suffixes:
        out = out | F.endswith(F.lower("title"), F.lit(s.lower()))
    return catalog.where(out)


def tenders(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two tender shapes as one."""
    a = first.select(F.concat(F.lit("T:"), F.col("notice")).alias("id"), "title", F.col("buyer"), F.col("date").alias("published"))
    b = second.select(F.concat(F.lit("B:"), F.col("ref")).alias("id"), F.col("objet").alias("title"), F.col("acheteur").alias("buyer"), F.col("parution").alias("published"))
    return a.unionByName(b)


def stored_blocks(pages: DataFrame, as_of: str, most_hours: int) -> DataFrame:
    """Blocks of stored pages that are fresh enough; malformed JSON gives none."""
    block = "array<struct<heading:string,text:string,path:string>>"
    fresh = pages.where(F.col("fetched_at") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(hours=F.lit(most_hours)))
    return fresh.select("page_id", F.posexplode(F.from_json("blocks_json", block)).alias("pos", "b")).select("page_id", "pos", "b.*")


def array_prefix_filter(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows with an array element that begins with a prefix."""
    return df.where(F.exists(column, lambda x: x.startswith(prefix)))


def first_per_key(frames: list[DataFrame], key: str, arrival: str) -> DataFrame:
    """Several fetches pooled: the first row of each key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.groupBy(key).agg(F.min_by(F.struct(*[c for c in out.columns if c != key]), arrival).alias("r")).select(key, "r.*")


def source_registry(spark: SparkSession) -> DataFrame:
    """The sources with a derived status."""
    return spark.createDataFrame(REGISTRY, "name string, kind string, configured boolean").withColumn("status", F.when(F.col("configured"), "ready").otherwise("needs_key"))


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with CRLF line ends and quoted delimiters."""
    df.write.mode("overwrite").option("header", True).option("lineSep", "\r\n").option("quoteAll", False).csv(folder)


def write_version(df: DataFrame, folder: str, stamp: str) -> str:
    """A dated copy."""
    path = f"{folder}/stamp={stamp}"
    df.write.mode("overwrite").parquet(path)
    return path


def stale_versions(versions: DataFrame, keep: int) -> DataFrame:
    """Versions beyond the newest ones (a row for each version, so few)."""
    newest = versions.orderBy(F.desc("stamp")).limit(keep)
    return versions.join(newest.select("stamp"), "stamp", "left_anti")


def prune_versions(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Deletes dated copies beyond the newest ones; their stamps (a folder for each, so few)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    top = jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(conf)
    names = sorted(x.getPath().getName() for x in fs.listStatus(top) if x.getPath().getName().startswith("stamp="))
    gone = names[:-keep] if keep else names
    for name in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(top, name), True)
    return [x.removeprefix("stamp=") for x in gone]


def export_csv(df: DataFrame) -> bytes:
    """A report as one file for a spreadsheet: mark of UTF-8, semicolons, CRLF, quotes where needed. For results of a screen's size."""
    import csv
    import io

    out = io.StringIO()
    w = csv.writer(out, delimiter=";", lineterminator="\r\n")
    w.writerow(df.columns)
    for row in df.toLocalIterator():
        w.writerow(["" if v is None else v for v in row])
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def emptied(df: DataFrame) -> DataFrame:
    """The same schema without rows."""
    return df.where(F.lit(False))
