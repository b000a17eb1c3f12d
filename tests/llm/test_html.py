import re
import time
from html import unescape

import pytest

from plumbline.llm import queries
from plumbline.llm.html import extract, main_text

LONG = "The council met on Tuesday, heard the plans, and voted for the bridge, which will open in spring after long debate."
MORE = "Residents said, in letters and at the meeting, that the road was too narrow, too busy, and too old for the traffic."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"<nav><a href=x>Home</a></nav><article><p>{LONG}</p><p>{MORE}</p></article><footer>(c), all rights, reserved, by us, for ever and ever</footer>",
        f"<div class=menu><ul><li><a href=x>{LONG}</a></ul></div><div id=content><p>{LONG}<p>{MORE}</div><div class='sidebar'><p>{LONG}</p></div>",
        f"<div class=cookie-notice><p>We use cookies, many cookies, and more cookies, for all of the purposes you like.</p></div><main><p>{LONG}</p><aside><p>{MORE}</p></aside><p>{MORE}</p></main>",
        f"<div><div><p>{LONG}</p><p>{MORE}</p></div></div><div id='comments'><h2>Comments</h2><p>{LONG} {LONG}</p><div class=comment-body><p>{LONG}</p></div></div>",
        f"<form><p>{LONG}</p></form><section><p>{LONG}</p></section><section><p>{MORE}</p></section><div class='advert'>Buy, buy, buy, buy, buy, buy, buy, buy, buy!</div>",
        f"<article><div class='section'><p>{LONG}</p></div><div class='section'><p>{MORE}</p></div></article><div class='related'><p>{LONG}</p></div>",
        f"<div>{LONG}<br></div><div>{MORE}</div><ul><li><a href=a>one, two, three, four, five, six</a></li></ul>",
        f"<article><p>{LONG}</p><p hidden>secret, secret, secret, secret, secret</p><div style='display: none'>{LONG}</div><p>{MORE}</article>",
    ],
)
def test_article_is_kept_and_the_rest_left_out(body):
    assert main_text(page(body)).split("\n") == [LONG, MORE]


SIX = [f"Part {i}. {LONG if i % 2 else MORE}" for i in range(6)]
PARTS = "".join(f"<p>{p}</p>" for p in SIX)
COOKIES = "<div class=x1><p>We use cookies, many cookies, for all the purposes you like, and more.</p></div>"
OTHERS = "<div class=q7><p>You may also like this, and that, and one more thing today.</p></div>"


@pytest.mark.parametrize(
    "body",
    [
        f"<div class='has-sidebar'>{PARTS}</div>", f"<div class='layout sidebar-right' id='page'>{PARTS}</div>", f"<div class='social-science'>{PARTS}</div>", f"<div class='with-banner'><article>{PARTS}</article></div>",
        f"<div class='comments'><main>{PARTS}</main><div class='comments'><p>{LONG}</p></div></div>", f"<div class='sidebar'>{PARTS}</div>", f"<div class='no-comments ad-free'>{PARTS}</div>", f"<div id='banner-layout' class='wrapper'>{PARTS}</div><div class='ad-slot'><p>{LONG}</p></div>",
    ],
)
def test_names_that_mislead_lose_nothing(body):
    assert main_text(page(body)).split("\n") == SIX


def test_a_paragraph_stays_whatever_it_is_called():
    price = "The share price was 12 today, up from ten."
    assert main_text(page(f"<article>{PARTS}<p class='share-price'>{price}</p></article>")).split("\n") == [*SIX, price]


@pytest.mark.parametrize("around", ["main", "div"])
@pytest.mark.parametrize("inner", ["article", "div class=z", "section"])
def test_boxes_without_names_go_by_their_points(around, inner):
    """Notices and adverts beside the article, below one container, with names that say nothing."""
    body = f"<{around}>{COOKIES}<{inner}>{PARTS}</{inner.split()[0]}>{OTHERS}</{around}>"
    assert main_text(page(body)).split("\n") == SIX


def test_blocks_references_and_white_space():
    got = main_text(page(f"<article><h1>A &amp; B</h1><p>  {LONG}\n\t x&nbsp;y &lt;b&gt; <b>bold</b>ly</p><p></p><p>Short.</p><ul><li>one</li><li>two</li></ul></article>"))
    assert got == f"A & B\n{LONG} x y <b> boldly\nShort.\none\ntwo"


@pytest.mark.parametrize("raw", [None, "", "<html></html>", "<script>x</script>", "<!-- only", "<"])
def test_pages_without_text(raw):
    assert main_text(raw) in ("", "<")


def test_short_article_is_found_without_points():
    assert main_text(page("<nav>Menu</nav><article><h1>Hi</h1><p>Short.</p></article><footer>foot</footer>")) == "Hi\nShort."
    assert main_text("plain text, no markup") == "plain text, no markup"


def test_broken_and_huge_pages_take_linear_time():
    began = time.time()
    for raw in ("<a " * 200_000, "<!--" * 200_000, "<div>" * 50_000 + LONG, '<a b="' * 100_000, f"<p>{LONG}" * 5_000, "<" * 200_000, f"<div><p>{LONG}</p>" * 20_000):
        main_text(raw)
    assert time.time() - began < 30


def test_operator_keeps_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", f"<article><p>{LONG}</p></article>"), (2, "u", f"<article><p>{LONG}</p></article>")], "page_id long, text string, html string")
    assert sorted((r.page_id, r.text) for r in extract(df).collect()) == [(1, ""), (2, LONG), (2, LONG)]
    assert extract(df.limit(0)).count() == 0


def test_query_finds_the_articles(spark, sf_dir):
    def wanted(raw):
        part = raw[raw.find("<article>") :]
        part = part[: part.find("</article>")] if "</article>" in part else part.split("<footer")[0]
        part = re.sub(r"</?(b|br|i|a)\b[^>]*>", "", part)
        return "\n".join(x for x in (" ".join(unescape(p).split()) for p in re.split(r"</?(?:p|h1|article|div)\b[^>]*>", part)) if x)

    pages = {p.page_id: p for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op2_html_text"](spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text) == (pages[r.page_id].url, wanted(pages[r.page_id].html)) and r.n_chars == len(r.text)


def test_points_decide_where_no_name_helps():
    """No element or name says what the article is: link density and length do."""
    linked = f"<div><p><a href=a>{LONG}</a></p><p><a href=b>{MORE} {LONG}</a></p><p><a href=c>{LONG} {MORE}</a></p></div>"
    assert main_text(page(f"{linked}<div><p>{LONG}</p><p>{MORE}</p></div>")) == f"{LONG}\n{MORE}"
    deep = f"<div>{linked}<div><div><div><p>{LONG}</p></div><div><p>{MORE}</p></div></div></div></div>"
    assert main_text(page(deep)) == f"{LONG}\n{MORE}"


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, f"<p>{LONG}</p>", "old", 5, None)], "page_id long, html string, text string, main int, c0 string")
    assert [r.asDict() for r in extract(df).collect()] == [{"page_id": 1, "html": f"<p>{LONG}</p>", "text": LONG, "main": 5, "c0": None}]
