"""Editorial blocks of pages: a small element tree on the standard parser, and what is read from it.

A block is (heading, text, kind, level1, level2, level3). Kinds: segment (a heading and what follows up to the next heading of its
rank), repeated (one of several cards of one parent), pseudo (text under a bold line that acts as a heading), linked (an item of
a list of links), block (a plain paragraph or list item). All functions take the tree of parse_tree() and leave it unchanged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html import NOISE, NOISE_NAME, VOID

#: Lengths that make a unit of text a block of its kind, and what counts as oversized.
LEAST_SEGMENT, LEAST_CARD, LEAST_LINKED = 55, 45, 24
MOST_CARD, MOST_LINKED, OVERSIZED = 3500, 900, 1500
LEAST_CARDS, MOST_CARDS, CARD_SHARE = 3, 40, 0.55
#: Page types by words of a path or label, and their scores; a page of type ignore isn't followed.
PAGE_TYPES = (
    ("ignore", 0, ("login", "privacy", "cart", "cookie", "imprint", "terms")),
    ("application", 100, ("application", "case", "study")),
    ("project", 80, ("project", "research")),
    ("publication", 70, ("publication", "paper")),
    ("product", 60, ("product", "service", "technology")),
    ("news", 40, ("news", "press", "blog")),
)
DEFAULT_SCORE = 20
#: Ids of the empty containers that script applications fill.
SCRIPT_ROOTS = ("root", "app", "__next", "__nuxt", "app-root")
#: Elements nested deeper than this become siblings there, with all their text.
MOST_DEPTH = 200
_HEADING = re.compile(r"h([1-6])$")
_OWNERS = {"li", "article", "div", "p"}
_PLAIN = {"p", "li", "td", "blockquote", "dd", "figcaption"}
_EDITORIAL = {"segment", "repeated", "pseudo"}
_TOKEN = re.compile(r"[^\W_]{3,}")


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def nodes(self) -> Iterator[Node]:
        """Elements below, in document order."""
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.nodes()

    def strings(self) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, Node):
                yield from c.strings()
            else:
                yield c

    def text(self) -> str:
        return " ".join(" ".join(self.strings()).split())

    def level(self) -> int:
        m = _HEADING.match(self.tag)
        return int(m[1]) if m else 0

    def inside(self, tags: set[str]) -> bool:
        p = self.parent
        while p is not None:
            if p.tag in tags:
                return True
            p = p.parent
        return False


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID and self.depth < MOST_DEPTH:
            self.at = node
            self.depth += 1

    def handle_endtag(self, tag):
        p, up = self.at, 1
        while p is not None and p.tag != tag:
            p, up = p.parent, up + 1
        if p is not None and p.parent is not None:
            self.at = p.parent
            self.depth -= up

    def handle_data(self, data):
        if data.strip():
            self.at.children.append(data)


def parse_tree(html: str) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def is_noise(n: Node) -> bool:
    return n.tag in NOISE or n.tag == "head" or bool(NOISE_NAME.search(f"{n.attrs.get('class') or ''} {n.attrs.get('id') or ''}"))


def without_noise(n: Node, parent: Node | None = None) -> Node:
    """A copy without navigation, scripts, banners and the like."""
    out = Node(n.tag, n.attrs, parent)
    out.children = [without_noise(c, out) if isinstance(c, Node) else c for c in n.children if not isinstance(c, Node) or not is_noise(c)]
    return out


def page_type(path: str, label: str) -> tuple[str, int]:
    words = set(_TOKEN.findall(f"{path} {label}".lower()))
    return next(((kind, score) for kind, score, cues in PAGE_TYPES if any(w.startswith(c) for w in words for c in cues)), ("page", DEFAULT_SCORE))


def root_domain(host: str) -> str:
    return ".".join(host.lower().rpartition("@")[2].partition(":")[0].split(".")[-2:])


def links(tree: Node, url: str, terms: set[str] = frozenset(), most: int | None = None) -> tuple[list[dict], list[dict]]:
    """(links worth following, outbound links of the content), from a tree with its navigation.

    A link of the same root domain is followed if it isn't to be ignored and is a menu's, a document's, names a term, or is of a
    scored type; of several to one address the best stays. By score, then address.
    """
    own = root_domain(urlsplit(url).netloc)
    found: dict[str, dict] = {}
    outside: dict[str, dict] = {}
    for a in tree.nodes():
        if a.tag != "a" or not a.attrs.get("href"):
            continue
        try:
            href = urljoin(url, a.attrs["href"]).partition("#")[0]
            parts = urlsplit(href)
        except ValueError:
            continue
        if parts.scheme not in ("http", "https"):
            continue
        menu = a.inside({"nav", "header"})
        label = a.text()[:180]
        if root_domain(parts.netloc) != own:
            if not menu:
                outside.setdefault(href, {"url": href, "host": parts.netloc.lower().removeprefix("www."), "label": label})
            continue
        kind, score = page_type(parts.path, label)
        named = bool(terms & set(_TOKEN.findall(f"{label} {parts.path}".lower())))
        document = parts.path.lower().endswith(".pdf")
        if kind == "ignore" or not (menu or named or document or score > DEFAULT_SCORE):
            continue
        key = href.partition("?")[0].rstrip("/").lower()
        item = {"url": href, "label": label, "context": "navigation" if menu else "content", "category": kind, "score": score, "reason": "navigation" if menu else "document" if document else "term" if named else "type"}
        if key not in found or score > found[key]["score"]:
            found[key] = item
    return sorted(found.values(), key=lambda x: (-x["score"], x["url"]))[:most], list(outside.values())


def hierarchy(tree: Node) -> dict[int, tuple[str, str, str]]:
    """The h1, h2 and h3 above every element, by id(element): a heading ends those of lower rank before it."""
    out, now = {}, ["", "", ""]
    for n in tree.nodes():
        k = n.level()
        if 1 <= k <= 3:
            now = [*now[: k - 1], n.text(), *[""] * (3 - k)]
        out[id(n)] = tuple(now)
    return out


def _block(heading: str, text: str, kind: str, above: tuple[str, str, str]) -> dict:
    return {"heading": heading[:240], "text": text, "kind": kind, "level1": above[0][:240], "level2": above[1][:240], "level3": above[2][:240]}


def _flat(tree: Node) -> list:
    """Elements and strings in document order."""
    out = []
    for c in tree.children:
        out.append(c)
        if isinstance(c, Node):
            out += _flat(c)
    return out


def segments(tree: Node, levels: tuple[int, ...] = (2, 3, 4)) -> list[dict]:
    """A heading with all text up to the next heading of its rank or a higher one."""
    order, above, out = _flat(tree), hierarchy(tree), []
    for i, n in enumerate(order):
        if not isinstance(n, Node) or n.level() not in levels:
            continue
        pieces = []
        for x in order[i + 1 :]:
            if isinstance(x, Node) and 0 < x.level() <= n.level():
                break
            if isinstance(x, str):
                pieces.append(x)
        text = " ".join(" ".join(pieces).split())  # begins with the heading's own strings
        if len(text) >= LEAST_SEGMENT:
            out.append(_block(n.text(), text, "segment", above[id(n)]))
    return out


def _title(n: Node) -> str:
    """A card's title: its first heading, bold line or link of a length fit for one."""
    for x in n.nodes():
        if x.level() or x.tag in ("strong", "b", "a"):
            text = x.text()
            if 4 <= len(text) <= 160:
                return text
    return ""


def repeated(tree: Node) -> list[dict]:
    """Cards: three children or more of one parent that have a title and a text of their own, most of its children being such."""
    above, out, seen = hierarchy(tree), [], set()
    for parent in [tree, *tree.nodes()]:
        cards = [c for c in parent.children if isinstance(c, Node)]
        if not LEAST_CARDS <= len(cards) <= MOST_CARDS:
            continue
        fit = []
        for c in cards:
            text, title = c.text(), _title(c)
            item = c.tag == "li" and any(x.tag == "a" for x in c.nodes())
            if LEAST_CARD <= len(text) <= MOST_CARD and title and (len(text) >= len(title) + 18 or item):
                fit.append((c, title, text))
        if len(fit) < LEAST_CARDS or len(fit) < CARD_SHARE * len(cards):
            continue
        for c, title, text in fit:
            if text not in seen:
                seen.add(text)
                out.append(_block(title, text, "repeated", above[id(c)]))
    return out


def _is_pseudo(n: Node) -> bool:
    """A short line that is bold as a whole, or that a class names a title."""
    text = n.text()
    if not 4 <= len(text) <= 120 or text[-1] in ".!?;,":
        return False
    if n.tag in ("strong", "b"):
        return True
    kids = [c for c in n.children if not isinstance(c, str) or c.strip()]
    bold = len(kids) == 1 and isinstance(kids[0], Node) and kids[0].tag in ("strong", "b")
    return n.tag in ("p", "div", "span") and (bold or bool(re.search(r"(?:^|[\s_-])(?:title|heading|headline)(?:$|[\s_-])", n.attrs.get("class") or "", re.I)))


def pseudo(tree: Node) -> list[dict]:
    """Lines that act as headings, with what follows beside them up to the next one."""
    above, out, seen = hierarchy(tree), [], set()
    for n in tree.nodes():
        if not _is_pseudo(n) or (n.parent is not None and n.parent.tag in ("p", "div", "span") and _is_pseudo(n.parent)):
            continue
        siblings, pieces = n.parent.children, [n.text()]
        at = next(i for i, c in enumerate(siblings) if c is n)
        for c in siblings[at + 1 :]:
            if isinstance(c, Node) and (c.level() or _is_pseudo(c)):
                break
            pieces.append(c.text() if isinstance(c, Node) else " ".join(c.split()))
        text = " ".join(x for x in pieces if x)
        if len(text) >= LEAST_CARD and len(pieces) > 1 and text not in seen:
            seen.add(text)
            out.append(_block(n.text(), text, "pseudo", above[id(n)]))
    return out


def linked(tree: Node) -> list[dict]:
    """Items of a list of links: each link with the smallest element around it that is still an item. Three of them at least."""
    above, out, seen = hierarchy(tree), [], set()
    for a in tree.nodes():
        title = a.text() if a.tag == "a" and a.attrs.get("href") else ""
        if not LEAST_LINKED <= len(title) <= 260:
            continue
        owner, p = a, a.parent
        while p is not None and p.parent is not None and len(p.text()) <= MOST_LINKED and sum(x.tag == "a" for x in p.nodes()) == 1:
            owner = p if p.tag in _OWNERS else owner
            p = p.parent
        text = owner.text()
        if text.lower() not in seen:
            seen.add(text.lower())
            out.append(_block(title, text, "linked", above[id(owner)]))
    return out if len(out) >= 3 else []


def plain(tree: Node) -> list[dict]:
    """Paragraphs, items and cells, and text that stands in none of them, under the nearest heading."""
    above, out = hierarchy(tree), []

    def walk(n: Node) -> None:
        loose: list[str] = []

        def flush() -> None:
            text = " ".join(" ".join(loose).split())
            loose.clear()
            if text:
                a = above.get(id(n), ("", "", ""))
                out.append(_block(next((h for h in reversed(a) if h), ""), text, "block", a))

        for c in n.children:
            if isinstance(c, str):
                loose.append(c)
            elif c.level() or c.tag == "title":
                flush()
            elif c.tag in _PLAIN and not any(x.tag in _PLAIN for x in c.nodes()):
                flush()
                if text := c.text():
                    out.append(_block(next((h for h in reversed(above[id(c)]) if h), ""), text, "block", above[id(c)]))
            elif any(x.tag in _PLAIN or x.level() or x.tag in ("div", "section", "article") for x in c.nodes()) or c.tag in ("div", "section", "article", "ul", "ol", "table", "tr", "main", "body", "html"):
                flush()
                walk(c)
            else:
                loose.append(c.text())
        flush()

    walk(tree)
    return out


def dedupe(blocks: list[dict]) -> list[dict]:
    """Of blocks with the same text, the most editorial one, in the place of the first; a block inside a longer one stays."""
    rank = lambda b: (b["kind"] in _EDITORIAL, bool(b["heading"]), bool(b["level2"] or b["level3"]))
    best: dict[str, dict] = {}
    for b in blocks:
        key = " ".join(b["text"].lower().split())
        if key and (key not in best or rank(b) > rank(best[key])):
            best[key] = b
    return list(best.values())


def split_oversized(tree: Node, block: dict) -> list[dict]:
    """Smaller units of an oversized block, if three or more are found."""
    if len(block["text"]) < OVERSIZED:
        return []
    pieces = dedupe(segments(tree) + repeated(tree) + pseudo(tree) + linked(tree))
    pieces = [p for p in pieces if len(p["text"]) < min(0.85 * len(block["text"]), OVERSIZED) and p["text"] in block["text"]]
    return pieces if len(pieces) >= 3 else []


def _tokens(text: str) -> Counter:
    return Counter(_TOKEN.findall(text.lower()))


def quality(tree: Node, blocks: list[dict]) -> dict:
    """How much of the page's words the blocks keep, and in what shape; the score is 42, 23, 20 and 15 parts, less noise and oversize."""
    whole = _tokens(tree.text())
    every: Counter = Counter()
    weighed: dict[str, float] = {}
    for b in blocks:
        for w, n in _tokens(b["text"]).items():
            every[w] += n
            weighed[w] = weighed.get(w, 0.0) + n * (1.0 if len(b["text"]) <= OVERSIZED else 0.25)
    total = sum(whole.values())
    covered = sum(min(n, every[w]) for w, n in whole.items()) / total if total else 1.0
    useful = sum(min(float(n), weighed.get(w, 0.0)) for w, n in whole.items()) / total if total else 1.0
    words = [max(1, len(b["text"].split())) for b in blocks]
    noisy = sum(n for b, n in zip(blocks, words, strict=True) if re.search(r"cookie|consent|privacy settings", b["text"], re.I))
    noise = noisy / sum(words) if words else 0.0
    large = sum(len(b["text"]) > OVERSIZED for b in blocks)
    again = sum(max(0, n - 2) for n in Counter(b["heading"].lower() for b in blocks if b["heading"]).values())
    local, context = (1 - large / len(blocks), max(0.0, 1 - again / len(blocks))) if blocks else (0.0, 0.0)
    score = 100 * (0.42 * useful + 0.23 * covered + 0.20 * local + 0.15 * context) - 35 * noise - min(3.0 * large, 15.0)
    return {"coverage": round(covered, 4), "useful": round(useful, 4), "noise": round(noise, 4), "oversized": large, "score": round(max(0.0, min(100.0, score)), 1)}


def needs_rendering(whole: Node, clean: Node, blocks: list[dict]) -> bool:
    """Whether a page says nothing without running its scripts: hardly any text, and an empty application root or mostly scripts."""
    text = clean.text()
    if len(blocks) > 1 or len(text) > 300:
        return False
    scripts = sum(n.tag == "script" and bool(n.attrs.get("src")) for n in whole.nodes())
    empty = any(n.attrs.get("id") in SCRIPT_ROOTS and len(n.text()) < 50 for n in whole.nodes())
    return empty or (scripts >= 3 and len(text) < 100)


def document(html: str, url: str = "", most: int | None = None) -> dict:
    """The cascade: segments and cards, plain blocks for what they leave out, oversized ones split, duplicates dropped."""
    whole = parse_tree(html)
    clean = without_noise(whole)
    units = segments(clean) + repeated(clean) + pseudo(clean)
    held = " ".join(b["text"] for b in units)
    rest = [b for b in plain(clean) if b["text"] not in held]
    blocks = []
    for b in dedupe(units + rest):
        blocks += split_oversized(clean, b) or [b]
    blocks = dedupe(blocks)[:most]
    inner, outer = links(whole, url)
    return {"blocks": blocks, "links": inner, "outbound": outer, "render": needs_rendering(whole, clean, blocks), **quality(clean, blocks)}


_BLOCK = [(n, pa.string()) for n in ("heading", "text", "kind", "level1", "level2", "level3")]
_LINK = [*[(n, pa.string()) for n in ("url", "label", "context", "category")], ("score", pa.int64()), ("reason", pa.string())]
_OUT = [(n, pa.string()) for n in ("url", "host", "label")]
_NAMES = {"blocks": pa.list_(pa.struct(_BLOCK)), "links": pa.list_(pa.struct(_LINK)), "outbound": pa.list_(pa.struct(_OUT)), "render": pa.bool_(), "coverage": pa.float64(), "useful": pa.float64(), "noise": pa.float64(), "oversized": pa.int64(), "score": pa.float64()}
SCHEMA = (
    "page_id long, blocks array<struct<heading:string,text:string,kind:string,level1:string,level2:string,level3:string>>, "
    "links array<struct<url:string,label:string,context:string,category:string,score:long,reason:string>>, outbound array<struct<url:string,host:string,label:string>>, "
    "render boolean, coverage double, useful double, noise double, oversized long, score double"
)


def documents(pages: DataFrame) -> DataFrame:
    """Columns of SCHEMA for every page; null html is an empty page."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                rows = [document(h or "", u or "") for h, u in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[n] for r in rows], kind) for n, kind in _NAMES.items())], ["page_id", *_NAMES])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html", "url").mapInArrow(run, SCHEMA)
