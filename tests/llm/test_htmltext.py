"""Main text extraction: hand-made pages, and the whole test table against a plain rule for its markup."""

import html as h
import re

from lexiflow.llm import htmltext


def page(main, n=0):
    return (
        f'<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav>'
        f'<div class="cookie-notice">We use cookies {n}</div><!-- x --><div class="ad">Buy {n}</div>{main}<aside>Other {n}</aside>'
        f'<div id="comments"><p>Nice post {n}, I really liked it and would read more of this</p></div><form><label>Mail</label><input></form><footer>&copy; me {n}</footer></body></html>'
    )


def extract(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as main", "3 as text", "4 as _html")
    return {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(df).collect()}


def test_template_without_semantic_container(spark):
    body = "<div class='x1'><h1>Title {0}</h1><div class=x2><p>First  &amp;\n second {0} " + "word " * 60 + "<p>Third<br>line &#233;</p></div></div><div class='x9'>plain advert {0}</div>"
    rows = [(k, f"http://a.example/p/{k}", page(body.format(k), k)) for k in range(6)]
    got = extract(spark, rows)
    for k in range(6):
        assert got[k][0].split("\n") == [f"Title {k}", f"First & second {k} " + ("word " * 60).strip(), "Third line é"]
        assert "advert" not in got[k][0] and "cookies" not in got[k][0] and got[k][1] == len(got[k][0])


def test_names_of_wrappers_and_article_parts():
    text = lambda html: htmltext.Page(html).text_in()
    article = "<h1>T</h1><p>Article " + "word " * 30
    for wrapper in ('<div class="layout with-sidebar">', '<div id="wrap" class="no-comments">', '<form id="aspnet">', '<div class="promo">', '<div id="search">'):
        assert text(f"<body>{wrapper}{article}") == "T\nArticle " + ("word " * 30).strip(), wrapper
    assert text("<article><h1>T</h1><p>a</p><div class='share-price'>12</div><div class='site-nav'>n</div><div class='comments'>c</div><div class='share'>s</div></article>") == "T\na\n12"
    assert text("<div class='cookie-notice'>all there is</div>") == "all there is"


def plain(k, host_text="Menu entry one", advert=None):
    """Nothing tells boilerplate but its repetition."""
    body = f"<div class=a1><h1>Title {k}</h1><p>Text {k} of the article " + f"w{k} " * 30 + "<p>" + f"second {k} " * 20 + "</p><div class=a2>Posted by our desk</div></div>"
    return f"<body><div class=b1><div class=b2><span>{host_text}</span><span>Menu entry two</span></div><div class=b3><p>{host_text} and more of it, the same on all pages of this host</p></div>{body}<div class=b4><p>{advert or f'Buy {k}'}</p></div></div>"


def test_the_template_alone_tells_boilerplate(spark):
    rows = [(k, f"http://e.example/{k}", plain(k)) for k in range(5)]
    # a host whose pages are copies of two, and one with too few
    rows += [(10 + k, f"http://f.example/{k}", plain(k % 2)) for k in range(8)] + [(20, "http://g.example/", plain(7))]
    rows += rows[:2]
    got = extract(spark, rows)
    for k in range(5):
        assert got[k][0].split("\n") == [f"Title {k}", f"Text {k} of the article " + (f"w{k} " * 30).strip(), (f"second {k} " * 20).strip()]
    alone = htmltext.Page(plain(7)).text_in()
    assert "Menu" in alone and got[20][0] == alone and got[11][0] == got[13][0] == htmltext.Page(plain(1)).text_in()


def test_classes_nest():
    import pandas as pd

    row = lambda path, vector, kind, up, chars=0, depth=1, pages=4.0: {"host": "h", "path": path, "low": vector, "high": 1, "kind": kind, "up": up, "chars": chars, "depth": depth, "pages": pages}
    tag, box, text = htmltext.TAG, htmltext.CONTAINER_TAG, htmltext.TEXT
    rows = [row(1, 7, box, 1, 1000, 0), row(2, 7, box, 1, 950), row(3, 7, text, 2, 100, 2), row(4, 9, tag, 2, 30, 2), row(5, 9, tag, 4, 30, 3), row(6, 9, text, 5, 30, 4)]
    assert htmltext.nested(pd.DataFrame(rows)) == (2, [3, 6])  # the second class lies in a slot of the first
    rows[3] = row(4, 9, tag, 99, 30, 2)
    assert htmltext.nested(pd.DataFrame(rows)) == (2, [3])  # below no template token
    assert htmltext.nested(pd.DataFrame([row(1, 7, box, 1, 100, 0), row(2, 7, box, 1, 100), row(3, 7, text, 2, 100, 2)])) is None


def test_edge_cases(spark):
    article = "<article><header><h1>A &lt;b&gt;</h1></header><p><b>one<p>two <i>in</i>line<ul><li>x<li>y</ul><div class=share>Share</div><table><tr><td>c1<td>c2</table></article>"
    rows = [(k, "http://b.example/", page(article, k)) for k in range(4)]
    rows += [(10, None, page(article)), (11, "nourl", None), (12, "http://c.example", ""), (13, "http://b.example/q", "just text &amp; more"), (14, "http://b.example/", page("<p>" + "long " * 50_000 + "</p>")), (None, "http://b.example/", "<p>x")]
    rows += [(15, "http://d.example", "<div>" * 3000 + "deep" + "</span>" * 10)]
    got = extract(spark, rows)
    want = "A <b>\none\ntwo inline\nx\ny\nc1\nc2"
    assert all(got[k] == (want, len(want)) for k in (0, 1, 2, 3, 10))
    assert got[11] == ("", 0) and got[12] == ("", 0) and got[13][0] == "just text & more" and got[None][0] == "x" and got[15][0] == "deep"
    assert got[14][0] == ("long " * 50_000).strip()
    assert extract(spark, []) == {}


def slow(text):
    """The tables' pages have one article of h1 and p."""
    article = re.search(r"<article>(.*?)(</article>|$)", text, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", article)
    return "\n".join(x for x in (" ".join(h.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks) if x)


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: slow(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in htmltext.extract(pages).collect()} == want
