"""Main text of pages of many layouts, and time on broken ones."""

import time

import pytest

from plumbline.llm import html_extract

HEAD = "A headline of some words"
PARAS = [f"Paragraph {i} says something of its own, with commas, and goes on for a while so that it reads like text." for i in range(4)]
TEXT = "".join(f"<p>{p}</p>" for p in PARAS)
SIDE = '<nav><a href="/a">Home</a> <a href="/b">News</a></nav>'
END = "<footer>Imprint, contact, and so on</footer>"
WHOLE = "\n\n".join([HEAD, *PARAS])
LAYOUTS = [
    '<div class="page has-sidebar"><article><h1>{h}</h1>{t}</article></div>', '<div class="layout-with-header"><h1>{h}</h1>{t}</div>', '<form id="aspnetForm"><div class="content"><h1>{h}</h1>{t}</div></form>',
    '<div id="wrapper" class="no-sidebar"><div class="post"><h1>{h}</h1>{t}</div></div>', "<main><h1>{h}</h1>{t}</main>", '<div role="main"><h1>{h}</h1>{t}</div>', "<table><tr><td><h1>{h}</h1>{t}</td></tr></table>",
    '<div class="a"><div class="b"><div class="c"><h1>{h}</h1>{t}</div></div></div>', '<div class="widget"><article><h1>{h}</h1>{t}</article></div>', '<section class="entry-content"><h1>{h}</h1>{t}</section>',
    '<div class="main"><h1>{h}</h1>{t}</div><div class="sidebar"><p>Side, words, and more words of no use.</p></div>', '<div class="story"><h1>{h}</h1>{t}<div class="comment-list"><p>Great, great, great article, I like it so much, thanks.</p></div></div>',
    '<div id="cookie-banner"><p>We use cookies, and others too, please agree to that.</p></div><div><h1>{h}</h1>{t}</div>', '<div><h1>{h}</h1>{t}</div><div class="ad-slot"><p>Buy this, buy that, buy now, and buy more of it.</p></div>',
    '<div class="post"><header><h1>{h}</h1></header>{t}</div>'.replace("<header>", "").replace("</header>", ""), "<article><header><h1>{h}</h1></header>{t}</article>",
    '<div class="post"><h1>{h}</h1>{t}<ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></div>', '<center><div><h1>{h}</h1>{t}</div></center>',
    '<div class="body"><h1>{h}</h1>{t}<form><input>Search the site, quickly</form></div>', '<div class="text" hidden><p>Hidden, words</p></div><div><h1>{h}</h1>{t}</div>',
]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_layouts(layout):
    page = f"<html><head><title>t</title></head><body>{SIDE}{layout.format(h=HEAD, t=TEXT)}{END}</body></html>"
    assert html_extract.main_text(page) == WHOLE


def test_names_inside_an_article_drop_nothing():
    page = f'<body>{SIDE}<article><h1>{HEAD}</h1>{TEXT}<p id="tags">Tagged, as it were.</p><p class="share-price">The price fell, they say.</p><p>See also</p><ul>'
    page += "".join(f'<li><a href="/{i}">A reference with a longer title, {2000 + i}</a></li>' for i in range(3)) + f"</ul></article>{END}</body>"
    want = [HEAD, *PARAS, "Tagged, as it were.", "The price fell, they say.", "See also", *(f"A reference with a longer title, {2000 + i}" for i in range(3))]
    assert html_extract.main_text(page) == "\n\n".join(want)


def test_a_tag_that_is_cut_off():
    assert html_extract.main_text('<p>some text <a href="x') == "some text"
    assert html_extract.main_text("<p>some text <a") == "some text"


@pytest.mark.parametrize(
    "page",
    ["<div>" * 200_000, '<a href="' * 110_000, "</b>" * 250_000, "<div></b>" * 110_000, "<table>" + "<div>" * 90_000 + "<td>" * 90_000, "<p><span>" * 110_000, "<ul>" + "<li><b>" * 140_000, "<header>" * 125_000, "<!--" * 250_000, "<" * 1_000_000, "<dl>" + "<dt><i>" * 140_000, "<a title='>" * 90_000, "<p>x</p>" * 120_000, "<script>" * 120_000],
)
def test_a_megabyte_takes_seconds(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 10


REMARKS = [f"Remark {i}: I read all of it, twice, and I do not agree with a word, sorry, not even with the commas." for i in range(12)]
HAND = '<li class="entry"><span class="user">anna{i}</span> <time>May {i}</time><p>{r}</p></li>'
ARTICLE = [
    '<div class="post"><h1>{h}</h1>{t}</div>', "<article><h1>{h}</h1>{t}</article>", "<main><h1>{h}</h1>{t}</main>", '<div class="entry-content"><h1>{h}</h1>{t}</div>', "<div><h1>{h}</h1>{t}</div>",
    '<table><tr><td class="body"><h1>{h}</h1>{t}</td></tr></table>',
]
COMMENTS = [
    '<div class="comments">{c}</div>', '<section id="discussion"><h2>What you say</h2>{c}</section>', '<div class="user-reviews">{c}</div>', '<div class="thread-list">{c}</div>', '<div id="disqus_thread">{c}</div>', '<ol class="commentlist">{i}</ol>',
    "<ul>{i}</ul>", "<div>{d}</div>", '<div class="x1">{a}</div>',
]


def remarks(form):
    c = "".join(f"<p>{r}</p>" for r in REMARKS)
    i = "".join(HAND.format(i=k, r=r) for k, r in enumerate(REMARKS))
    d = "".join(f'<div class="row"><p>{r}</p><a href="#">Reply</a></div>' for r in REMARKS)
    a = "".join(f'<article><b class="author-name">ben</b><span class="date">yesterday</span><p>{r}</p></article>' for r in REMARKS)
    return form.format(c=c, i=i, d=d, a=a)


@pytest.mark.parametrize("comments", COMMENTS)
@pytest.mark.parametrize("article", ARTICLE)
def test_comments_longer_than_the_text(article, comments):
    """Beside the article and in it, with names and without."""
    for text in (TEXT, f"<p>{PARAS[0]}</p>"):
        whole = "\n\n".join([HEAD, *(PARAS if text is TEXT else PARAS[:1])])
        beside = article.format(h=HEAD, t=text) + remarks(comments)
        inside = article.format(h=HEAD, t=text + remarks(comments))
        for body in (beside, inside):
            assert html_extract.main_text(f"<html><body>{SIDE}{body}{END}</body></html>") == whole


def test_a_page_of_comments_alone_keeps_them():
    page = f'<body>{SIDE}<div class="comments">{"".join(f"<p>{r}</p>" for r in REMARKS)}</div>{END}</body>'
    assert html_extract.main_text(page) == "\n\n".join(REMARKS)


def test_short_articles_win():
    side = "<div><p>Another story, which is longer, with commas, and tells of something else, far away, and long ago, and so on.</p></div>"
    for tag in ("article", "main"):
        assert html_extract.main_text(f"<body><{tag}><h1>Hi</h1><p>Short note.</p></{tag}>{side}</body>") == "Hi\n\nShort note."
    two = f"<body><article><p>One.</p></article><article><h1>{HEAD}</h1>{TEXT}</article></body>"
    assert html_extract.main_text(two) == WHOLE


def test_lists_of_links_in_the_text_stay():
    towns = "".join(f'<li><a href="/{t}">{t}</a></li>' for t in ("Wien", "Linz", "Graz"))
    want = "\n\n".join([HEAD, PARAS[0], "Wien", "Linz", "Graz", PARAS[1]])
    for form in ("<article>{x}</article>", "<main>{x}</main>", '<div class="post">{x}</div>', "<div>{x}</div>"):
        body = f"<h1>{HEAD}</h1><p>{PARAS[0]}</p><ul>{towns}</ul><p>{PARAS[1]}</p>"
        assert html_extract.main_text(f"<body>{SIDE}{form.format(x=body)}{END}</body>") == want, form
    end = f"<article><h1>{HEAD}</h1>{TEXT}<ul>{towns}</ul></article>"
    assert html_extract.main_text(f"<body>{SIDE}<ul>{towns}</ul>{end}{END}</body>") == "\n\n".join([WHOLE, "Wien", "Linz", "Graz"])
