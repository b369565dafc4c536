from __future__ import annotations

import pytest

from ledgerloom.llm import html

SCHEMA = "page_id long, url string, html string, text string, path string, host string, n_chars long, id long"
ARTICLE = "<h1>Title &amp; more</h1><p><b>First   line.<br><p>Second <a href='/x'>link</a> one.</p><ul><li>item a<li>item b</ul><aside>see also</aside><div class='comments'><p>nice!</p></div>"
WANT = "Title & more\nFirst line.\nSecond link one.\nitem a\nitem b"


def page(body, article=ARTICLE, wrap="<article>{}</article>"):
    return (
        f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a "
        f"href=/>Home</a></ul></nav><header>Site</header>{body}{wrap.format(article)}<footer>&copy; x</footer>"
    )


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "t", "p", "h", 1, 2) for i, u, h in rows], SCHEMA)


def test_article_without_boilerplate(spark):
    rows = [
        (1, "http://a.b/c", page("<div class='ad'>Buy <p>now</p></div>")),
        (2, "http://a.b/d", page("<form>x</form>", wrap="<div class='post-12 body'>{}</div>")),
    ]
    got = {r.page_id: r for r in html.main_text(pages(spark, rows)).collect()}
    assert got[1].text == got[2].text == WANT and got[1].n_chars == len(WANT)
    assert got[1].url == "http://a.b/c"


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "layout no-sidebar", "site header-fixed", "entry has-comments", "sidebar-wrap", "main-sidebar", "header"])
def test_wrappers_named_like_boilerplate(name):
    for wrap in ("<article>{}</article>", "<div class='post'>{}</div>")[: 1 if name == "header" else 2]:
        body = page("", wrap=f"<div class='{name}'>{wrap}</div><div class='sidebar'><p>other posts</p></div><div id='site-footer'><p>all rights</p></div>")
        assert html.extract(body, None) == WANT
        assert html.best_container(html.parse(body))[0].path.endswith(("/article", "/div.post"))


def test_names_of_boilerplate():
    assert [html.named_as(x) for x in ("ad", "x comments", "site-footer", "comment-list", "widget_area-2", "post")] == [2, 2, 1, 1, 1, 0]
    replies = "<div id='comments'><article class='comment-body'><p>" + "reply " * 200 + "</p></article></div>"
    assert html.extract(page("", wrap="<div class='content-sidebar-wrap'><article>{}</article>" + replies + "</div>"), None) == WANT


def test_page_all_in_boilerplate():
    assert html.extract("<body><div class='header'><p>only text</p></div>", None) == "only text"


def test_hosts_vote(spark):
    long = "<p>" + "teaser text " * 60 + "</p>"
    usual = "<div class='content'><p>" + "real words " * 90 + "</p></div>"
    rows = [(i, f"https://h.example/{i}", page("", usual, "{}")) for i in range(5)]
    # on this page another container is larger, but the host's path wins
    rows.append((9, "https://H.example/9", page(f"<div class='box'>{long}{long}</div>", "<div class='content'><p>short but real</p></div>", "{}")))
    # on another host the page's own best container wins
    rows.append((10, "https://other.example/9", page(f"<div class='box'>{long}</div>", "<div class='content'><p>short</p></div>", "{}")))
    got = {r.page_id: r for r in html.main_text(pages(spark, rows)).collect()}
    assert got[9].text == "short but real" and got[9].path == "/div.content"
    assert got[10].text.startswith("teaser text")
    assert got[0].text == ("real words " * 90).strip()


@pytest.mark.parametrize("text", ["", None, "plain text only", "<", "<a", "<p", "<p>x", "a < b and <3", "<!-- never closed", "<script>x", "&am &amp &nope; &#233;", "<p>" * 3000 + "deep", "<div>" * 3000 + "deep"])
def test_odd_pages(spark, text):
    got = html.main_text(pages(spark, [(1, None, text), (1, None, text), (None, "x", text)])).collect()
    assert len(got) == 3 and len({r.text for r in got}) == 1 and got[0].n_chars == len(got[0].text)
    if text and "deep" in text:
        assert got[0].text == "deep"
    if text == "&am &amp &nope; &#233;":
        assert got[0].text == "&am & &nope; é"


def test_empty_table(spark):
    assert html.main_text(pages(spark, [])).count() == 0


def test_hosts_by_join(spark, monkeypatch):
    monkeypatch.setattr(html, "HOSTS_BYTES", 0)
    assert [r.text for r in html.main_text(pages(spark, [(1, "http://a.b/c", page(""))])).collect()] == [WANT]


def test_pages_of_the_small_tables(spark, small):
    import re
    from html import unescape

    for r in html.op6_html(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>|<br>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("inside, want", [
    ("<p class='share'>The share price of the bank fell.</p>", "The share price of the bank fell."),
    ("<section id='related-work'><p>Earlier studies said so.</p></section>", "Earlier studies said so."),
    ("<h2 id='search'>The search</h2><div class='social'>Social life is <a href=x>rich</a> here and long.</div>", "The search\nSocial life is rich here and long."),
    ("<p>so <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is</p><noscript><p>plain</p></noscript>", "so x+1 is\nplain"),
    ("<p>one <span class='ad'>Buy <b>now</b> <span>and</span> here</span> two</p>", "one two"),
    ("<p>one <a class='share' href=x>share it</a> two</p>", "one two"),
    ("<p>one <span class='search'>sought</span> two</p><p hidden>gone</p>", "one sought two"),
    ("<div class='share'><a href=x>Share this now</a> or <a href=y>that</a></div><p>text</p>", "text"),
    ("<div class='newsletter'>Read it <input name=m></div><div class='comments'><p>nice words</p></div><p>text</p>", "text"),
])
def test_names_alone_take_no_article_text(inside, want):
    assert html.extract(page("", article=f"<h1>Title</h1>{inside}"), None) == f"Title\n{want}"


def test_hosts_of_any_url(spark):
    urls = {"http://A.b/c": "a.b", "//a.b/c": "a.b", "a.b/c?x#y": "a.b", "a.b:80/c": "a.b", "ftp://u:p@a.b:21/": "a.b", "": None, "/c": None, None: None}
    got = spark.createDataFrame(list(urls.items()), "url string, want string").select(
        "want",
        html.F.lower(html.F.nullif(html.F.regexp_extract("url", html.HOST, 1), html.F.lit(""))).alias("got"),
    ).collect()
    assert all(r.want == r.got for r in got), got


def test_pages_without_a_host_do_not_vote(spark):
    usual = "<div class='content'><p>" + "real words " * 90 + "</p></div>"
    rows = [(i, None, page("", usual, "{}")) for i in range(5)]
    rows.append((9, None, page("<div class='box'><p>" + "teaser text " * 60 + "</p></div>", "<div class='content'><p>short</p></div>", "{}")))
    got = {r.page_id: r for r in html.main_text(pages(spark, rows)).collect()}
    assert got[9].path is None and got[9].text.startswith("teaser text")


@pytest.mark.parametrize("made", ["<div>" * 100_000 + "deep", "<div class='ad x'><p>" * 50_000 + "deep", "<svg>" * 40_000 + "deep", "</nav></div>" * 50_000 + "deep", "<span class='share'>" * 50_000 + "deep"])
def test_long_and_deep_pages_take_linear_time_and_memory(made):
    import time
    import tracemalloc

    began = time.time()
    text = html.extract(made, None)
    assert time.time() - began < 20 and text in ("deep", "")
    tracemalloc.start()
    html.extract(made[: len(made) // 4] + "deep", None)
    quarter = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert quarter < 50e6


def test_keys_are_of_paths():
    root = html.parse("<body><div class='b a1'><section><p>x")
    for n in html.nodes_of(root):
        assert n.key == html.key_of_path(n.path)
    assert html.nodes_of(root)[-1].path == "/div.a0.b/section/p"


@pytest.mark.parametrize("body, want", [
    ("<div id=content><h1>Title</h1><div class=entry><p>one</p><p>two</p></div></div>", "Title\none\ntwo"),
    ("<div><p>left column of text</p></div><div><p>right</p></div>", "left column of text\nright"),
    ("<section><p>first part</p></section><section><p>2</p></section>", "first part\n2"),
    ("<table><tr><td><p>cell one, long</p></td><td>cell two</td></tr></table>", "cell one, long\ncell two"),
    ("<article><p>the longer article</p></article><article><p>short</p></article>", "the longer article\nshort"),
    ("<div><p>said</p><blockquote>a much longer quotation than the text</blockquote></div>", "said\na much longer quotation than the text"),
    ("<article><header><h1>Title</h1></header><p>text</p></article>", "Title\ntext"),
    ("<div id=content><h1>Title</h1><article><p>text of some length</p></article></div><div><p>beside the article</p></div>", "Title\ntext of some length"),
    ("<main><h1>T</h1><article><p>text</p></article></main><div>beside</div>", "T\ntext"),
    ("<div><p title=don't>one</p><p title=a'b\"c class=x>two</p><p title='a > b'>three</p></div>", "one\ntwo\nthree"),
    ("<div><p title='x class=ad'>one</p><p data-x=\"hidden\">two</p></div>", "one\ntwo"),
    ("<div><p>text</p></div><div><a href=a>Home</a> <a href=b>News</a></div><ul><li><a href=c>More</a></ul>", "text"),
])
def test_whole_article(body, want):
    assert html.extract(f"<body><header>Site</header><nav><a href=/>x</a></nav>{body}<footer>f</footer>", None) == want


@pytest.mark.parametrize("name", ["id=disqus_thread", "class=commentlist", "class=user-reviews", "class=reply-list", "class=discussion", "id=comments", "class=replies"])
def test_reader_comments(name):
    for wrap in ("<div class=post>{}</div>", "<article>{}</article>"):
        for where in ("{}" + f"<div {name}>" + "<div class=c>I like it, really.</div>" * 3 + "</div>",):
            inside = where.format("<h1>Title</h1><p>The text itself.</p>")
            assert html.extract(f"<body>{wrap.format(inside)}", None) == "Title\nThe text itself."


def test_a_discussion_within_an_article():
    assert html.extract("<article><p>Results.</p><section class=discussion><h2>Discussion</h2><p>We see.</p></section></article>", None) == "Results.\nDiscussion\nWe see."


def test_votes_are_of_fixed_length(spark):
    deep = "<div class='a b'>" * 3000 + "<p>deep text</p>"
    (vote,) = html.host_votes(spark.createDataFrame([("h", deep)], "host string, html string")).collect()
    assert len(vote["key"]) == 24
    (row,) = html.main_text(pages(spark, [(1, "http://a.b/c", deep)])).collect()
    assert row.text == "deep text"


def test_tags_are_found_in_linear_time():
    import time

    for page in ("<p=x" * 50_000, "<p a='" * 50_000, '<p a="' * 50_000, "<p =" * 50_000, "<a b=c'" * 50_000 + ">"):
        began = time.time()
        html.extract(page, None)
        assert time.time() - began < 10
