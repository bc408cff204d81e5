import re
from html import unescape

from matricula.llm import html


def test_pages_give_their_article(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    got = html.extract(pages).collect()
    assert len(got) == len(raw)
    for r in got:
        article = re.search(r"<article>(.*?)(</article>|$)", raw[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        want = [" ".join(unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in parts]
        assert r.text == "\n".join(x for x in want if x)
        assert r.n_chars == len(r.text)


def test_page_without_article_element():
    page = """<html><head><title>T</title></head><body><div id="top-menu"><a href=x>Home</a> <a href=y>News</a></div>
    <header><h1>Site</h1></header><div class="cookie-notice">We use cookies, ok?</div>
    <div class="c"><h2>Head &amp; line</h2><p>First, with <i>in</i>line text.  Second&nbsp;sentence, here. <p>Unclosed, one.
    <ul><li>Point one, ok.<li>Point two.</ul><script>var a = "<p>no</p>";</script><!-- <p>no</p> --><style>p{}</style>
    <div class="comments"><p>Great article, thanks! I agree, fully, and then some.</p></div></div>
    <aside>Side, text.</aside><div class="ad">Buy, now.</div><form>Mail <input> <p>Sign up.</p></form><footer>&copy; us</footer></body></html>"""
    assert html.main_text(page) == "Head & line\nFirst, with inline text. Second sentence, here.\nUnclosed, one.\nPoint one, ok.\nPoint two."


_LONG = "A long sentence of the article, with commas, and with more words than others. Another one, just as long, follows here."


def test_article_in_parts():
    for part in ("<article>%s</article>", "<div class='story'>%s</div>", "<div class='part'>%s</div>", "<section><div class='a'>%s</div></section>"):
        one = part % f"<h1>Title</h1><p>{_LONG}</p><p>{_LONG}</p><p>Short.</p>"
        two = part % f"<h2>Second part</h2><p>{_LONG}</p><ul><li>Point one.<li>Point two.</ul>"
        page = f"<html><body><div class='q7'>Buy now</div>{one}<div class='q7'>Buy now</div>{two}<div class='z'>All rights</div></body></html>"
        assert html.main_text(page).split("\n") == ["Title", _LONG, _LONG, "Short.", "Second part", _LONG, "Point one.", "Point two."]


def test_content_beside_a_large_part_stays():
    page = f"<body><div id='a'><p>{_LONG}</p>{f'<p>{_LONG}</p>' * 8}</div><div id='b'><p>{_LONG} The end.</p></div></body>"
    assert html.main_text(page).split("\n") == [_LONG] * 9 + [_LONG + " The end."]


def test_neutral_names_in_the_container():
    page = f"<article><div class='x1'>By us</div><h1>Title</h1><p>{_LONG}</p><div class='x2'><span>Tap here</span></div><h2>Next</h2><p>{_LONG}</p><div class='x3'>Top</div></article>"
    assert html.main_text(page).split("\n") == ["Title", _LONG, "Next", _LONG]


def test_classed_parts_of_the_article_stay():
    body = f"<p>{_LONG}</p>" * 3
    cases = [
        (f"<article>{body}<p class='end'>The end</p></article>", ["The end"]),
        (f"<article>{body}<table class='data'><tr><th>Year<td>1900<tr><th>Size<td>12 km</table></article>", ["Year", "1900", "Size", "12 km"]),
        (f"<article>{body}<ul class='specs'><li>Weight 3 kg</li><li>Blue</li></ul></article>", ["Weight 3 kg", "Blue"]),
        (f"<div class='post'>{body}<blockquote class='q'>So said she</blockquote></div>", ["So said she"]),
    ]
    for page, more in cases:
        assert html.main_text(f"<body><div class='m'>Top</div>{page}<div class='z'>All rights</div></body>").split("\n") == [_LONG] * 3 + more
    page = f"<article><p>{_LONG}</p><div class='code'>x = f(1)</div><p>{_LONG}</p><div class='btn'>Tap here</div><p>{_LONG}</p></article>"
    assert html.main_text(page).split("\n") == [_LONG, "x = f(1)", _LONG, _LONG]


def test_deep_and_unclosed_pages_take_linear_time():
    import time

    for page in ("".join(f"<div>text {i}, more." for i in range(20_000)), "<p>" * 20_000 + "end, here.", "</b></div>" * 20_000 + "x", "<div><b>" * 10_000 + "y</i>" * 10_000,
                 "".join(f"<li>point {i}, more." for i in range(20_000)), "".join(f"<ul><li>point {i}, more." for i in range(10_000))):
        t = time.perf_counter()
        html.main_text(page)
        assert time.perf_counter() - t < 4
    text = html.main_text("".join(f"<div>text {i}, more." for i in range(5000)))
    assert text.count("\n") == 4999


def test_pages_without_an_article_element(spark, sf):
    """The fixture's pages with a plain container instead of ``article``: the same text."""
    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(60).collect():
        plain = r.html.replace("<article>", "<div class='k1'>").replace("</article>", "</div>")
        assert html.main_text(plain) == html.main_text(r.html), r.page_id


def test_small_part_with_a_main_name_is_not_the_article():
    page = f"<body><div class='entry'>3 min</div><div class='t'><p>{_LONG}</p><p>{_LONG}</p></div></body>"
    assert html.main_text(page).split("\n") == [_LONG, _LONG]


def test_self_closed_svg_and_math():
    for tag in ("<svg/>", "<svg />", "<svg viewBox='0 0 1 1'/>", "<math/>", "<svg><path d='x'/></svg>", "<svg id=a/><path></svg>"):
        assert html.main_text(f"<article><p>One, two.</p>{tag}<p>Three, four.</p></article>") == "One, two.\nThree, four."


def test_odd_input():
    assert html.main_text(None) == html.main_text("") == html.main_text("<p> </p>") == ""
    assert html.main_text("plain text, no tags") == "plain text, no tags"
    assert html.main_text("<p>a &lt; b</p><p>c<") == "a < b\nc<"
    assert html.main_text("<div hidden><p>x</p></div><p>Seen, text.</p>") == "Seen, text."
    assert len(html.main_text("<p>" + "word, " * 200000 + "</p>")) == 1199999
    html.main_text("<" * 50000)
    html.main_text("<div>" * 3000 + "deep, text.")


def test_edge_rows(spark):
    rows = [(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>One, two.</p>", "x"), (3, "u", "", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "One, two.", 9), (1, "", 0), (1, "", 0), (3, "", 0)]
    assert html.extract(df.limit(0)).count() == 0
