from __future__ import annotations

import re
import time
from html import unescape

from waybill.llm.html_text import best_path, blocks, extract_pages, main_text, scored_paths, walk
from waybill.llm.queries import QUERIES

FRAME = (
    '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header class="site-header"><p>Site</p>'
    '</header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice"><p>We use cookies</p></div>{}<aside><p>Also</p></aside>'
    '<section id="comments"><p>A reader says a lot of things here</p></section><footer>&copy; X</footer></body></html>'
)


def test_article_without_its_surroundings():
    page = FRAME.format(
        '<div class="ad">Buy</div><article><h1>A &amp; B</h1><p>One\n  two&nbsp;three<br>four <b>bold<br><p>Next &lt;x&gt;<form><input>no</form>'
        "<ul><li>i1<li>i2</ul><p hidden>gone</p><!-- c --></article>"
    )
    assert main_text(page, None) == "A & B\nOne two three four bold\nNext <x>\ni1\ni2"


def test_containers_without_an_article_element():
    page = FRAME.format('<div id="wrap-3"><div class="post-12"><h1>T</h1><div class="entry-content"><p>First words.</p><p>More.</p></div></div></div>')
    assert main_text(page, None) == "T\nFirst words.\nMore."
    assert max(scored_paths(page), key=lambda x: x[1])[0] == ">html>body>div.wrap-0>div.post-0"


def test_broken_markup():
    assert main_text(None, None) == main_text("", None) == main_text("<", None) == main_text("<p></p>", None) == ""
    assert main_text("plain text", None) == ""
    assert main_text("<body>a</i></div>b</p>c<p d", None) == "ab\nc"
    assert blocks(walk("<body><div class=x><p>in"), ">body>div.x") == ["in"]
    assert blocks(walk("<body><p>in"), ">body>div.x") is None


def test_tags_end_by_the_rules_of_html():
    for tag in ("<p title=it's>", "<p class=\"x\"y'>", "<p a='>' b=\">\" c=d'e>", "<p a = 'x>y'>", "<p =\"z>", "<p a==\"b>", "<p/a/>", "<p a=>", "<p\n\ta\n=\n'>'>"):
        assert main_text(f"<body>{tag}Hello there</p><p>you", None) == "Hello there\nyou", tag
    for tail in ('<p class="x>hello', "<p title='a>b", "<p d", "</p x='>", "<!-- open", "<!doctype", "<b a=\"", "<"):
        assert main_text(f"<body><p>Kept</p>{tail}", None) in ("Kept", "Kept\n<") and "hello" not in main_text(f"<body><p>Kept</p>{tail}", None)
    assert main_text("<body>a<!-->b<!--->c<!-- x --!>d<!-- > -->e</ bogus>f</>g< h", None) == "abcdefg< h"
    assert main_text("<body><script>x</scripty></script >y<p class=a class='nav'>z", None) == "y\nz"


def test_deep_and_unclosed_markup_takes_linear_time():
    for tag in ("<div>", "<div class=a>", "<b>", "<x>", "<p><x>", "<li>", "<span><div>"):
        page = f"<body><p>Start</p>{tag * 50_000}deep text"
        began = time.process_time()
        text = main_text(page, None)
        path = best_path(walk(page))[0]
        assert "deep text" in text and len(path) < len(page) + 10
        assert time.process_time() - began < 20, tag


def test_host_decides(frame):
    odd = "<html><body><div class='story-1'><p>Short.</p></div><div class='extra'><p>A much longer text that is not the story of it at all.</p></div>"
    usual = "<html><body><div class='story-2'><p>A long story with very many words, as usual on this host, and more of them, and still more of them.</p></div><div class='extra'><p>Bits.</p></div>"
    pages = [(k, "http://Example.com/x", usual, "h") for k in range(5)] + [(9, "http://example.com/y", odd, "h"), (10, None, None, "h"), (10, "::", "", "h")]
    got = {r.page_id: r for r in extract_pages(frame(pages, "page_id long, url string, html string, host string")).collect()}
    assert got[9].text == "Short." and got[0].text.startswith("A long story")
    assert got[10].text == "" and got[10].n_chars == 0
    assert extract_pages(frame([], "page_id long, url string, html string")).count() == 0


def test_query_on_all_pages(spark):
    folder = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = QUERIES["op10_html_extraction"](spark, folder).collect()
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        inner = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        want = [" ".join(unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(w for w in want if w) and r.n_chars == len(r.text)


def test_wrappers_named_like_boilerplate_keep_their_article():
    text = "<h1>Title</h1><p>First words of it.</p>"
    for open_tag, close_tag in [
        ("<div id='content-sidebar-wrap'>", "</div>"), ("<div class='has-sidebar'>", "</div>"), ("<div class='layout-sidebar-right'>", "</div>"),
        ("<div class='page-with-banner'>", "</div>"), ("<form action='/x'>", "</form>"),
    ]:
        for inner in (f"<article>{text}</article>", f"<main>{text}</main>", f"<div role=main>{text}</div>"):
            assert main_text(FRAME.format(f"{open_tag}{inner}<div class='sidebar'><p>Aside</p></div>{close_tag}"), None) == "Title\nFirst words of it."
        assert main_text(FRAME.format(f"{open_tag}<div>{text}<p>{'More words. ' * 5}</p></div>{close_tag}"), None).startswith("Title\nFirst words of it.\nMore")
    whole = f"<html><body><form id='form1'><div class='sidebar'><p>Links</p></div><div><p>{'All of the page. ' * 9}</p></div></form></body></html>"
    assert main_text(whole, None) == ("All of the page. " * 9).strip()


def test_passages_of_an_article_and_comments():
    words = "Some words of this passage, and further ones. " * 4
    for name in ("discussion", "legal", "related", "social-policy"):
        page = FRAME.format(f"<article><h1>T</h1><p>{words}</p><section class='{name}'><p>Kept here. {words}</p></section></article>")
        assert "Kept here." in main_text(page, None) and "reader" not in main_text(page, None)
    links = f"<article><p>{words}</p><div class='related'><a href='/x'>{words}</a></div></article>"
    assert main_text(FRAME.format(links), None) == words.strip()
    replies = f"<article><p>Short one.</p></article><div id='comments'><article class='comment'><p>{words * 9}</p></article></div>"
    assert main_text(FRAME.format(replies), None) == "Short one."
