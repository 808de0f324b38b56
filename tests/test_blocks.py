"""Blocks, links and measures of fixed pages."""

import pytest

from factloom.functions import blocks as B

WORDS = "some words that make the text long enough to be a block of its own kind"
PAGE = f"""<html><head><title>T</title></head><body><nav><a href="/applications/x">Menu</a></nav><div class="cookie-banner">We use cookies</div>
<h1>Top</h1><h2>First</h2><p>{WORDS} one</p><h3>Inner</h3><p>{WORDS} two</p><h2>Second</h2><p>{WORDS} three</p>
<div class="list"><div><h4>Card A</h4><p>{WORDS} a</p></div><div><h4>Card B</h4><p>{WORDS} b</p></div><div><h4>Card C</h4><p>{WORDS} c</p></div></div>
<section><p><b>Bold line</b></p><p>{WORDS} under the bold line</p></section>
<a href="https://other.org/page">Other</a><a href="/privacy">Privacy</a><a href="/plain">plain</a><a href="/doc.pdf#x">Doc</a><a href="mailto:x@y">m</a></body></html>"""


def tree(html):
    return B.without_noise(B.parse_tree(html))


def test_links():
    inner, outer = B.links(B.parse_tree(PAGE), "https://www.site.com/en/", {"plain"})
    assert [(x["url"], x["category"], x["reason"]) for x in inner] == [("https://www.site.com/applications/x", "application", "navigation"), ("https://www.site.com/doc.pdf", "page", "document"), ("https://www.site.com/plain", "page", "term")]
    assert [x["host"] for x in outer] == ["other.org"]
    assert B.links(B.parse_tree('<a href="/news/1">a</a><a href="/news/1/?x=1">b</a><a href="http://[bad">c</a>'), "https://s.com")[0][0]["url"] == "https://s.com/news/1"
    assert len(B.links(B.parse_tree("".join(f'<a href="/news/{i}">n</a>' for i in range(9))), "https://s.com", most=4)[0]) == 4


def test_noise_zones_go():
    text = tree(PAGE).text()
    assert "cookies" not in text and "Menu" not in text and "T" not in text.split()


def test_segments_end_at_a_heading_of_their_rank():
    got = {b["heading"]: b for b in B.segments(tree(PAGE))}
    assert got["First"]["text"] == f"First {WORDS} one Inner {WORDS} two" and got["Inner"]["text"] == f"Inner {WORDS} two"
    assert got["Second"]["text"].startswith(f"Second {WORDS} three Card A") and got["Second"]["level1"] == "Top"
    assert (got["Inner"]["level2"], got["Inner"]["level3"]) == ("First", "Inner")


def test_repeated_cards():
    assert [(b["heading"], b["text"]) for b in B.repeated(tree(PAGE)) if b["heading"].startswith("Card")] == [(f"Card {x.upper()}", f"Card {x.upper()} {WORDS} {x}") for x in "abc"]
    assert B.repeated(tree(PAGE.replace("Card C", "").replace(f"{WORDS} c", ""))) == []


def test_pseudo_headings():
    assert [(b["heading"], b["text"]) for b in B.pseudo(tree(PAGE))] == [("Bold line", f"Bold line {WORDS} under the bold line")]


def test_linked_items():
    items = "".join(f'<li><a href="/p/{i}">A publication title number {i}</a> by authors</li>' for i in range(4))
    got = B.linked(tree(f"<ul>{items}</ul>"))
    assert [b["text"] for b in got] == [f"A publication title number {i} by authors" for i in range(4)]
    assert B.linked(tree("<ul>" + items[: items.index("</li>")] + "</ul>")) == []


def test_dedupe_prefers_editorial_units():
    a = {"heading": "", "text": "Same  text", "kind": "block", "level1": "", "level2": "", "level3": ""}
    b = a | {"kind": "segment", "text": "same text"}
    c = a | {"text": "text"}
    assert B.dedupe([a, c, b, a]) == [b, c] and B.dedupe([]) == []


def test_oversized_blocks_are_split():
    part = lambda i: f"<h3>Part {i}</h3><p>{(WORDS + ' ') * 6}{i}</p>"
    t = tree("<h2>All</h2>" + "".join(part(i) for i in range(5)))
    whole = next(b for b in B.segments(t) if b["heading"] == "All")
    assert len(whole["text"]) > B.OVERSIZED and [b["heading"] for b in B.split_oversized(t, whole)] == [f"Part {i}" for i in range(5)]
    assert B.split_oversized(t, whole | {"text": "short"}) == []


def test_quality_and_rendering():
    t = tree(PAGE)
    full = B.quality(t, B.plain(t))
    assert full["coverage"] > 0.8 and 0 < B.quality(t, [])["coverage"] + 1 and B.quality(t, [])["score"] == 0.0 and full["score"] > B.quality(t, B.plain(t)[:1])["score"]
    assert B.document('<div id="root"></div>')["render"] and B.document("<script src=a></script>" * 3 + "hi")["render"]
    assert not B.document("<p>short static page</p>")["render"] and not B.document(PAGE)["render"]


def test_all_blocks_stay():
    html = "".join(f"<h2>Heading {i}</h2><p>{WORDS} {i}</p>" for i in range(200))
    assert len(B.document(html)["blocks"]) == 200 and len(B.document(html, most=80)["blocks"]) == 80


@pytest.mark.parametrize("html", ["", "<", "</p></div>", "<p>open<div>deep" * 30, "<!-- x --><![CDATA[y]]>", None, "<div>" * 3000 + "<p>deep text</p>" + "</div>" * 3000 + "<p>after</p>"])
def test_odd_pages(html):
    assert B.document(html)["score"] >= 0


def test_pages_of_a_table(spark):
    rows = [(1, PAGE, "https://site.com/"), (2, None, None), (3, "", "x")]
    got = {r.page_id: r for r in B.documents(spark.createDataFrame(rows, "page_id long, html string, url string")).collect()}
    assert {b.kind for b in got[1].blocks} >= {"segment", "pseudo"} and got[2].blocks == [] and len(got) == 3
