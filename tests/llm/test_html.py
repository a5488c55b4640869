"""Main text of pages of several layouts, broken markup and odd rows."""

import random
import time

import pytest

from maskwright.llm import html

PARTS = ["First paragraph, with some words in it; and more.", "Second one: a & b < c, “quoted”.", "Third."]
NOISE = {
    "<nav>{}</nav>": "Home About us Contact",
    '<div class="sidebar left">{}</div>': "Popular now: a long list of other stories, with commas, and dots.",
    '<div id="cookie-notice">{}</div>': "We use cookies. They are good, really.",
    "<header>{}</header>": "The Daily Site",
    "<footer>{}</footer>": "Copyright, all rights reserved.",
    "<aside>{}</aside>": "Related: this, that.",
    '<section id="comments"><article class="comment">{}</article></section>': "Great article, thanks! I read it twice, and again.",
    "<form><p>{}</p><input></form>": "Subscribe here. Your mail, please.",
    "<script>if (a < b) document.write('<p>{}</p>')</script>": "no",
    "<style>p:after{{content:'{}'}}</style>": "no",
    '<div class="ad-slot"><p>{}</p></div>': "Buy now, cheap.",
    "<!-- <p>{}</p> -->": "hidden",
    '<div role="navigation"><ul><li><a href="/">{}</a></li></ul></div>': "Next page",
    "<ul><li><a href=x>{}</a></li><li><a href=y>More</a></li></ul>": "Elsewhere",
}


def escaped(t):
    return t.replace("&", "&amp;").replace("<", "&lt;").replace("“", "&ldquo;").replace("”", "&#8221;")


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div class=post>{}</div></main>", "<div class='content'>{}</div>"])
@pytest.mark.parametrize("seed", range(4))
def test_article_is_kept_and_nothing_else(frame, seed):
    rng = random.Random(seed)
    noise = [k.format(v) for k, v in NOISE.items()]
    rng.shuffle(noise)
    body = "<h1>A  title\n here</h1>" + "".join(f"<p>{escaped(p)}" + ("</p>" if rng.random() < 0.5 else "") for p in PARTS) + "<ul><li>item <b>one</b><li>item two</ul>"
    page = f"<!DOCTYPE html><html><head><title>T</title></head><body class=has-sidebar>{''.join(noise[:7])}{frame.format(body)}{''.join(noise[7:])}</body></html>"
    assert html.main_text(page) == "\n".join(["A title here", *PARTS, "item one", "item two"])


def test_noise_inside_an_article_goes():
    page = "<article><header><h1>Title</h1></header><p>One, two.</p><aside>no</aside><div class='share'>Tweet</div><p>Three&nbsp;<br>four &copy</p></article>"
    assert html.main_text(page) == "Title\nOne, two.\nThree four ©"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div class=wrap>{}</div>", "<main>{}</main>", "{}"])
@pytest.mark.parametrize("chars", [300, 3000, 60_000])
def test_title_beside_a_body_container_stays(around, chars):
    body = ("Some words, and more. " * chars)[:chars].strip()
    page = f"<html><body><nav>Home</nav>{around.format(f'<h1>Title</h1><div class=body><p>{body}</p></div>')}<ul><li><a href=x>Elsewhere</a></ul></body></html>"
    assert html.main_text(page) == f"Title\n{body}"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<div>{}</div>", "{}"])
@pytest.mark.parametrize("part", ["section", "div"])
@pytest.mark.parametrize("chars", [60, 300])
def test_short_parts_beside_a_long_one_stay(around, part, chars):
    texts = [("Short words, few. " * 20)[:chars].strip(), ("Long words, many. " * 400)[:5000].strip(), ("Last words, few. " * 20)[:chars].strip()]
    page = f"<html><body>{around.format(''.join(f'<{part}>{t}</{part}>' for t in texts))}<footer>no</footer></body></html>"
    assert html.main_text(page) == "\n".join(texts)


def test_text_between_and_beside_kept_blocks_stays_and_links_go():
    long = ("Long words, many. " * 200).strip()
    page = f"<body><div><div><ul><li><a href=x>All news</a></ul></div><div><h2>Head</h2></div><div>Lead, short.</div><div><p>{long}</p></div><div><pre>x = 1</pre></div><div><p>{long}</p></div></div><div>Loose</div></body>"
    assert html.main_text(page) == f"Head\nLead, short.\n{long}\nx = 1\n{long}"


TEXT = "Some sentence of the article, of usual length and with marks. "


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>"])
@pytest.mark.parametrize("part", [
    "<h2 id=search-algorithms>{}</h2>", "<section id=related-work>{}</section>", "<p class=share-price>{}</p>",
    "<section id=copyright-law><p>{}</p></section>", "<div id=login-flow>{}</div>", "<p>a <span class=ad-rate>{}</span> b</p>",
])
def test_names_that_sound_like_noise_lose_no_text(around, part):
    own = TEXT.strip()
    assert own in html.main_text(f"<body>{around.format(f'<h1>T</h1><p>{TEXT * 5}</p>{part.format(own)}<p>{TEXT * 5}</p>')}</body>")


def test_ids_that_repeat_the_title_and_sure_names_inside_an_article():
    page = f"<article><p>{TEXT * 9}</p><section id=search><h2>Search</h2><p>{TEXT}</p></section><h2 id=search>Search again</h2><div class='share-buttons'>Share this, now.</div><ul class='related-posts'><li>{TEXT}</ul><div class=comments><p>{TEXT}</p></div></article>"
    assert html.main_text(page) == "\n".join([(TEXT * 9).strip(), "Search", TEXT.strip(), "Search again"])


@pytest.mark.parametrize("page", ["", None, "<", "<p", "<p>a<b", "</p></div>x", "<script>", "<!--", "<a href='x>y", "<" * 5000, "<p>" * 3000 + "deep", "&am", "a" * 100_000])
def test_broken_markup_does_not_fail(page):
    assert isinstance(html.main_text(page), str)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a  b</p>", "z"), (1, "u", "<p>a  b</p>", "z"), (None, None, None, "q"), (2, "", "<nav>x</nav>", "")], "page_id long, url string, html string, text string")
    rows = sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(pages).collect())
    assert rows == [("1", "a b", 3), ("1", "a b", 3), ("2", "", 0), ("None", "", 0)]
    assert html.extract(pages.where("false")).count() == 0


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>"])
@pytest.mark.parametrize("chars", [200, 6000])
@pytest.mark.parametrize("noise", [
    "<div>Imprint, contact.</div>", "<div><p>Great read, thanks! I saw it twice, and again.</p><p>Me too, it was good.</p></div>",
    "<div><p>Weather: 20 degrees.</p><p>Stocks: up, a bit.</p></div>", "<div>All rights kept by us, 2024.</div>",
])
def test_plain_blocks_outside_the_article_go(around, chars, noise):
    body = (TEXT * 200)[:chars].strip()
    page = f"<html><body>{noise}<h1>Title</h1>{around.format(f'<p>{body}</p><p>{body}</p>')}{noise}</body></html>"
    assert html.main_text(page) == f"Title\n{body}\n{body}"


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class=content>{}</div>", "{}"])
@pytest.mark.parametrize("menu", ["<div><a href=/>Home</a> <a href=/n>News</a> | <a href=/s>Sport</a></div>", "<ul><li><a href=/>Home</a></li><li><a href=/n>News of the day</a></li></ul>"])
def test_menus_of_links_alone_go_wherever_they_are(around, menu):
    body = f"<p>{TEXT * 6}</p>{menu}<p>See <a href=x>this page</a>, too. {TEXT}</p>{menu}<p>{TEXT * 3}</p>"
    want = "\n".join([(TEXT * 6).strip(), f"See this page, too. {TEXT.strip()}", (TEXT * 3).strip()])
    assert html.main_text(f"<html><body>{menu}{around.format(body)}{menu}</body></html>") == want


def test_side_column_of_the_main_part_and_paragraphs_named_as_adverts_go():
    side = "<div><p>Weather: 20 degrees.</p><p>Stocks: up.</p></div>"
    page = f"<main><div><h1>Title</h1><p>{TEXT * 6}</p><p class=ad>Buy now, cheap.</p><p class='notice'>We moved.</p><p>{TEXT * 6}</p></div>{side}</main>"
    assert html.main_text(page) == "\n".join(["Title", (TEXT * 6).strip(), (TEXT * 6).strip()])


@pytest.mark.parametrize("tag", ["div", "b", "a", "li", "section", "p"])
def test_work_grows_with_length_however_deep(tag):
    """50,000 levels, with text and stray ends on each, in about twice the time of 25,000."""
    deep = lambda n: f"<{tag}>x.</i></h9>" * n + f"<article><p>{TEXT * 400}</p></article>"
    def seconds(n):
        page, began = deep(n), time.process_time()
        assert "Some sentence" in html.main_text(page) or tag == "a"
        return time.process_time() - began

    seconds(1000)
    assert seconds(50_000) < 4 * seconds(25_000) + 1
