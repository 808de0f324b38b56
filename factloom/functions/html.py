"""Page parsing on the standard library's parser, as one Arrow-batched function of the html column.

Navigation, scripts and other noise zones are left out; the rest becomes blocks of text under their headings. Blocks that
repeat an earlier one are dropped. The measures tell how much of a page's text the blocks keep.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NOISE = {"nav", "script", "style", "noscript", "footer", "aside", "form", "template", "svg"}
NOISE_NAME = re.compile(r"(?:^|[\s_-])(?:cookie|consent|banner|ad|ads|menu|breadcrumb)(?:$|[\s_-])", re.I)
BLOCK = {"p", "li", "td", "th", "blockquote", "figcaption", "dd", "dt", "div", "section", "article", "main", "body", "br", "tr", "ul", "ol", "table"}
HEADING = {"h1": 1, "h2": 2, "h3": 3, "h4": 4}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

SCHEMA = "page_id long, title string, lang string, published string, n_links long, n_outbound long, blocks array<struct<heading:string,text:string,path:string,fingerprint:string>>, coverage double"


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.lang, self.published = "", None, None
        self.stack: list[str] = []
        self.noise = 0
        self.heads = ["", "", "", "", ""]
        self.level = 0
        self.buffer: list[str] = []
        self.blocks: list[tuple[str, str, str]] = []
        self.links: list[str] = []
        self.seen_text = 0

    def _flush(self):
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if not text:
            return
        if self.level:
            self.heads[self.level] = text
            for deeper in range(self.level + 1, 5):
                self.heads[deeper] = ""
        else:
            heading = next((h for h in reversed(self.heads) if h), "")
            self.blocks.append((heading, text, " > ".join(h for h in self.heads if h)))

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang")
        if tag == "meta" and (a.get("property") or a.get("name") or "") in ("article:published_time", "date", "datePublished"):
            self.published = (a.get("content") or "")[:10] or None
        if tag in VOID:
            if tag == "br":
                self.buffer.append(" ")
            return
        self.stack.append(tag)
        if self.noise or tag in NOISE or NOISE_NAME.search(f"{a.get('class') or ''} {a.get('id') or ''}"):
            self.noise += 1
            return
        if tag == "a" and a.get("href"):
            self.links.append(a["href"])
        if tag in BLOCK or tag in HEADING:
            self._flush()
            self.level = HEADING.get(tag, 0)

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            if self.noise:
                self.noise -= 1
            elif top in BLOCK or top in HEADING:
                self._flush()
                self.level = 0
            if top == tag:
                break

    def handle_data(self, data):
        if "title" in self.stack:
            self.title += data
        elif not self.noise:
            self.buffer.append(data)
        self.seen_text += len(data.strip())


def parse(html: str, url: str = "") -> dict:
    p = _Parser()
    p.feed(html or "")
    p.close()
    p._flush()
    seen, blocks = set(), []
    for heading, text, path in p.blocks:
        key = hashlib.sha256(f"{path}|{text}".encode()).hexdigest()[:24]
        if key not in seen:
            seen.add(key)
            blocks.append({"heading": heading, "text": text, "path": path, "fingerprint": key})
    host = urlsplit(url).netloc
    links = {urljoin(url, x).partition("#")[0] for x in p.links}
    kept = sum(len(b["text"]) for b in blocks)
    return {
        "title": " ".join(p.title.split()),
        "lang": p.lang,
        "published": p.published,
        "n_links": len(links),
        "n_outbound": sum(bool(urlsplit(x).netloc) and urlsplit(x).netloc != host for x in links),
        "blocks": blocks,
        "coverage": round(min(1.0, kept / p.seen_text), 4) if p.seen_text else 0.0,
    }


def parse_pages(pages: DataFrame) -> DataFrame:
    """Columns of SCHEMA for every page; null html is an empty page."""
    names = [x.split()[0] for x in SCHEMA.split(", ", 7)[:7]] + ["coverage"]
    block = pa.list_(pa.struct([(n, pa.string()) for n in ("heading", "text", "path", "fingerprint")]))
    kinds = {"title": pa.string(), "lang": pa.string(), "published": pa.string(), "n_links": pa.int64(), "n_outbound": pa.int64(), "blocks": block, "coverage": pa.float64()}

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = [parse(h or "", u or "") for h, u in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[n] for r in rows], kinds[n]) for n in names[1:])], names)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html", "url").mapInArrow(run, SCHEMA)
