import html as entities
import re

import pytest

from docvec.llm import html


def test_tree_knows_its_table():
    x, y = html.labelled_table()
    assert (html.classify(x) == y).all() and 0.3 < y.mean() < 0.7 and len(y) < 200


W = "word " * 30


@pytest.mark.parametrize("page, text", [
    ("", ""),
    (f"<body><div>{W}</div></body>", W.strip()),
    ("<nav><a>x</a></nav><article><p>Hi.<p><a href=1>l</a>", "Hi.\nl"),
    (f"<header><h1>Site</h1></header><div class='notice'>{W}</div><main><p>Hi</p><p>{W}</p></main>"
     f"<section id=comments><article><p>{W}</p></article></section>", f"Hi\n{W.strip()}"),
    ("<article><!-- x > y --><p>a<script>if(a<b){'</p>'}</script>b</p><style>p{}</style><p>c<form><input>q</form><p>d",
     "ab\nc\nd"),
    ("<article><p>a &lt;b&gt; &amp;amp; &#233;&nbsp;\n\n  c<br>d</article><footer>&copy; x</footer>", "a <b> &amp; é c d"),
    (f"<article><aside>{W}</aside><p>x</p><div class='share-bar'>{W}</div></article><div class=ad>{W}</div>", "x"),
])
def test_pages(page, text):
    assert html.main_text(page) == text


def article_of(page):
    body = page[page.find("<article>") + 9:page.rfind("</article>")]
    parts = [entities.unescape(re.sub("<[^>]+>", "", p.replace("<br>", " "))) for p in re.split("</?(?:p|h1|div)>", body)]
    return "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_query(spark, sf):
    from docvec.llm.queries import QUERIES

    pages = {r["page_id"]: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op5_html"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r["text"] == article_of(pages[r["page_id"]]["html"])
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_rows_of_all_kinds(spark):
    rows = [(1, "u", "<article>a</article>", "x"), (1, "u", "<article>a</article>", "y"), (None, None, None, "z"), (2, "v", "", None),
            (3, "w", "<article>" + "<p>é x</p>" * 20_000, "q"), (4, "w", "<div <p <<", "q")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"], r["n_chars"]) for r in html.extract(pages).collect()}
    assert got == {(1, "u", 1), (None, None, 0), (2, "v", 0), (3, "w", 79_999), (4, "w", 0)}
    assert html.extract(pages.where("false")).count() == 0


def test_wrappers_that_hold_the_main_text_are_no_marks():
    first, second = "The bridge was closed for the whole of the winter. " * 4, "It opened again in spring to the joy of all. " * 4
    body = f"<p>{first}</p><p>{second}</p>"
    for page in (
        f"<body class='single no-sidebar'><div>{body}</div></body>",
        f"<body class='sidebar'><div>{body}</div></body>",
        f"<body><div class='content with-sidebar'>{body}</div></body>",
        f"<body><div class='has-banner'>{body}</div></body>",
        f"<body><div id='search-results-page'>{body}</div></body>",
        f"<body><div class='widget-area'><article>{body}</article></div></body>",
        f"<body><form><div class='share'><main>{body}</main></div></form></body>",
    ):
        assert html.main_text(page) == f"{first.strip()}\n{second.strip()}", page
    for page in (
        f"<body><main>{body}</main><div class=related><article><p>{first}</p></article></div></body>",
        f"<body><article>{body}</article><div class=sidebar><p>{first}</p></div></body>",
        f"<body><article>{body}</article><aside><p>{first}</p></aside></body>",
        f"<body><div>{body}</div><div class=page-footer><p>{first}</p></div></body>",
    ):
        assert html.main_text(page) == f"{first.strip()}\n{second.strip()}", page


L = ("The bridge was closed for the whole of the winter. " * 3).strip()
A = f"<p>{L}</p>"


@pytest.mark.parametrize("page, text", [
    # tags inside a line
    ("<article><p>See the <svg><path/><text>z</text></svg> icon</p></article>", "See the icon"),
    ("<article>It cost <data>three</data> and <x-tip>four</x-tip> coins.</article>", "It cost three and four coins."),
    ("<article><p>a <ruby>b<rp>(</rp><rt>c</rt><rp>)</rp></ruby> d</p></article>", "a b(c) d"),
    ("<article><p>a <picture><source srcset=x><img src=y></picture> b</p></article>", "a b"),
    ("<article><p>a <select><optgroup label=x><option>q<option>r</optgroup></select> b</p></article>", "a b"),
    ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p></article>", "so x=2 holds"),
    ("<article><p>press <button>Go</button> now</p></article>", "press Go now"),
    ("<article><p>a <output>b</output> <meter>c</meter> d<wbr>e</p></article>", "a b c de"),
    ("<article><p>a <object><p>q</p></object> b</p></article>", "a b"),
    ("<article><p>a<custom-break/>b</p><hr><p>c</p></article>", "ab\nc"),
    # wrappers with the names of notices
    *[(f"<body><div class='{c}'><article><h1>T</h1>{A}</article><article>{A}</article></div><footer>x</footer>", f"T\n{L}\n{L}")
      for c in ("elementor-widget", "post-body social-share-enabled", "legal-text", "promo-theme", "widgetArea main-col")],
    (f"<main><div class=elementor-widget><h1>T</h1></div><div class=elementor-widget>{A}{A}</div></main>", f"T\n{L}\n{L}"),
    (f"<article>{A}<p>x</p><div class=social><p>Tell a friend</p><p>Or two</p></div></article>", f"{L}\nx"),
    (f"<article>{A}</article><div class=widget>{A}{A}{A}</div>", L),
    (f"<article>{A}</article><div class='cookieBanner'>{A}</div>", L),
    # notices and comments in an article
    (f"<article>{A}<div class=alert>Beware of it all</div><p>End</p></article>", f"{L}\nEnd"),
    (f"<article>{A}<section><h3>3 Comments</h3>{A}<p>no</p></section></article>", L),
    (f"<article>{A}<div><h4>Leave a reply</h4><p>q</p><div>{A}</div></div><p>End</p></article>", f"{L}\nEnd"),
    (f"<article>{A}<h2>Comments on the law</h2>{A}</article>", f"{L}\nComments on the law\n{L}"),
    # no article
    (f"<body><div><a href=x>Home</a></div><h1>Title</h1><p>Short one.</p>{A}{A}</body>", f"Title\nShort one.\n{L}\n{L}"),
    (f"<body><h1>Title</h1><p>Short one.</p>{A}<div>Top</div></body>", f"Title\nShort one.\n{L}"),
    # parts that are not closed
    (f"<body><nav><a href=x>Home</a><div><h1>T</h1>{A}</div></body>", f"T\n{L}"),
    (f"<body><nav><ul><li><a href=x>Home</a></ul><article><h1>T</h1>{A}</article></body>", f"T\n{L}"),
    (f"<body><nav><ul><li><a href=x>Home</a></ul><div>{A}{A}</div></body>", f"{L}\n{L}"),
    (f"<head><meta x><body><article>{A}</article>", L),
    (f"<head><link x><article>{A}</article>", L),
    (f"<article><div>{A}<p>x <svg><path></div><p>y</p></article><footer>x</footer>", f"{L}\nx\ny"),
    (f"<div class=col><nav><a href=x>A</a></div><article>{A}</article>", L),
    # hidden parts are not on the list of what goes
    (f"<article><p hidden>{L}</p><div style='display:none'>x</div></article>", f"{L}\nx"),
    ("<article><nav><h2>Contents</h2><a href=x>One</a></nav><p>x</p></article>", "x"),
])
def test_shapes(page, text):
    assert html.main_text(page) == text
