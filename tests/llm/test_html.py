import html as _html
import re

from quire.llm import html

from .helpers import SF


def simple(source):
    """The generated pages hold one article of plain elements."""
    article = re.search(r"<article>(.*)</article>", source or "", re.S)
    blocks = re.sub(r"</?(?:b|i|em|a)\b[^>]*>", "", article[1]) if article else ""
    return " ".join(_html.unescape(re.sub(r"<[^>]*>", "\n", blocks)).split())


def test_whole_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = {r.page_id: r for r in html.extract(pages).collect()}
    want = {r.page_id: (r.url, simple(r.html)) for r in pages.collect()}
    assert {k: (r.url, r.text) for k, r in rows.items()} == want
    assert all(r.n_chars == len(r.text) for r in rows.values())


PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>if (a<b) document.write("<p>no</p>")</script></head>
<body class="x"><header><h1>Site</h1></header><nav><ul><li>Menu<li>More</ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sideBar">side</div>
<main><article><header>by line</header><h1>Head&nbsp;&lt;1&gt;</h1><p>One <b>bo</b>ld<br>two <!-- <p>gone</p> --> three<p title="a>b">f&eacute;&#x26;&amp;amp; <a href="#">li</a>nk
<form><input value="q">search</form><aside>aside</aside><ul><li>x<li>y</ul><script>z()</script>
<section class="comments"><p>reader says</p></section><div class="ad">buy</div>end</article></main><footer>foot</footer><p>after"""


def test_page_by_hand(spark):
    frame = spark.createDataFrame([(1, "http://a.example/x", PAGE)], "page_id long, url string, html string")
    assert html.extract(frame).head().text == "Head <1> One bold two three fé&&amp; link x y end"


def other(i, body):
    return f"<html><body><div class='top'><p>Our site</p><p>Call us</p></div><div class=content><div class=story>{body}</div></div><div class=sidebar>s{i}</div><p>All rights kept</p></body></html>"


def test_template_without_article(spark):
    bodies = [f"<h2>Title {i}</h2><p>{' '.join(f'word{i}x{j}' for j in range(30 + i))}</p><p>tail {i}</p>" for i in range(12)]
    rows = [(i, "https://b.example/%d" % i, other(i, b)) for i, b in enumerate(bodies)]
    found = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert found == {i: " ".join(re.sub(r"<[^>]*>", " ", b).split()) for i, b in enumerate(bodies)}


WORDS = "amber birch cedar delta ember frost grove heron iris jade".split()


def story(i, n=40):
    return " ".join(f"{WORDS[(i * 7 + j * 3) % 10]}{i}x{j}" for j in range(n))


def layout(i, notice="<p>Read our house rules</p>", at=0):
    body = [f"<p>{story(i)}</p>", f"<h2>part {i}</h2>", f"<p>{story(i + 500)}</p>"]
    body.insert(at, notice)
    return f"<html><body><div class=top><p>Our site</p></div><article><h1>title {i}</h1>{''.join(body)}</article><div class=low><span>All rights kept</span></div></body></html>"


def texts_of(spark, sources, url="https://d.example/x"):
    rows = [(i, url, h) for i, h in enumerate(sources)]
    found = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_constants_of_a_valid_class_go_from_articles(spark):
    plain = lambda i: f"title {i} {story(i)} part {i} {story(i + 500)}"
    assert texts_of(spark, [layout(i) for i in range(8)]) == [plain(i) for i in range(8)]
    # Another vector: a text that only some pages of the layout hold is no token of its class.
    some = texts_of(spark, [layout(i, "<p>Read our house rules</p>" if i % 2 else "") for i in range(8)])
    assert all(("house rules" in t) == bool(i % 2) for i, t in enumerate(some))
    # Too few pages for a class.
    assert all("house rules" in t for t in texts_of(spark, [layout(i) for i in range(2)]))


def test_a_token_out_of_order_is_no_template(spark):
    rules = "<p>Read our house rules</p>"

    def page(i, moved):
        body = f"<h2>part {i}</h2><p>{story(i)}</p><h3>also {i}</h3>"
        return f"<body><article>{body + rules if moved else rules + body}</article><footer>foot</footer></body>"

    want = [f"part {i} {story(i)} also {i}" for i in range(12)]
    assert texts_of(spark, [page(i, False) for i in range(12)]) == want
    # On two pages it stands behind both headings, so it is no token of their class.
    found = texts_of(spark, [page(i, i > 9) for i in range(12)])
    assert found == [f"{w} Read our house rules" if i > 9 else f"Read our house rules {w}" for i, w in enumerate(want)]


def test_copies_are_no_layout(spark):
    copied = texts_of(spark, [layout(1).replace("Our site", f"Our site {i}") for i in range(6)] + [layout(i) for i in range(20, 22)])
    assert all(story(1) in t and story(501) in t for t in copied[:6])
    passage = "<p>" + story(77, 60) + "</p>"  # repeated on many pages, but text alone is no class
    shared = texts_of(spark, [layout(i, passage if i % 3 else "<p></p>") for i in range(9)])
    assert all((story(77, 60) in t) == bool(i % 3) for i, t in enumerate(shared))


def test_two_layouts_of_one_host(spark):
    other_layout = lambda i: f"<html><body><table><tr><td>Menu one<td>Menu two</table><div class=box><div class=story><p>{story(i)}</p><p>end {i}</p></div></div><div class=tail><em>Imprint here</em><p>see also {i}</p></div></body></html>"
    found = texts_of(spark, [layout(i) for i in range(30)] + [other_layout(100 + i) for i in range(4)])
    assert found[:30] == [f"title {i} {story(i)} part {i} {story(i + 500)}" for i in range(30)]
    assert found[30:] == [f"{story(100 + i)} end {100 + i}" for i in range(4)]


def test_names_yield_to_the_template(spark):
    page = lambda i, name: f"<body><section id='comment-on-method'><article><p>{story(i)}</p><div class='{name}'><b>x</b><p>earlier {i}</p></div></article></section></body>"
    assert texts_of(spark, [page(1, "related-work")]) == [f"{story(1)} x earlier 1"]
    assert texts_of(spark, [page(1, "related")]) == [story(1)]
    assert texts_of(spark, [page(i, "related-box") for i in range(6)]) == [story(i) for i in range(6)]  # on every page: the template's
    form = f"<body><form><div class=sidebar><article>teaser</article></div><article>{story(3)}</article></form></body>"
    assert texts_of(spark, [form]) == ["teaser " + story(3)]  # all main elements are in the form: it is spared, and the names with it


def test_vectors_orders_and_gaps_make_the_template():
    element = lambda t, parent, kind, c, i: [t, parent, kind, c, i]
    rows = [element(1, 0, html.PLAIN, 0, 0), element(2, 1, html.MAIN, 0, 1), element(3, 2, html.TEXT, 0, 2), element(4, 1, html.PLAIN, 0, 3), element(7, 1, html.PLAIN, 1, 0), element(8, 7, html.TEXT, 1, 1), element(9, 7, html.TEXT, 1, 2)]
    assert html.deduce(rows, []) == ([2], [1, 4, 7], [1, 2, 4, 7], [3, 8, 9])
    said = lambda what, key, a=1, b=0, low=0, high=0: {"what": what, "key": key, "other": 0, "a": a, "b": b, "low": low, "high": high}
    assert html.deduce(rows, [said(html.LEAVES, 3)]) == ([2], [1, 4, 7], [1, 2, 4, 7], [8, 9])
    assert html.deduce(rows, [said(html.BROKEN, 1)]) == ([2], [1, 4], [1, 2, 4], [3])
    assert html.deduce(rows, [said(html.GAP, 1, low=0, high=2)]) == ([2], [1, 4], [1, 2, 4], [3])
    assert html.deduce(rows, [said(html.CONSTANT, 1, 30, 100)]) == ([2], [1, 4, 7], [1, 2, 4, 7], [3])
    assert html.deduce(rows, [said(html.LEAVES, 1), said(html.LEAVES, 2)])[0] == []
    assert html.deduce(rows, [said(html.SLOT, 4, 90), said(html.SLOT, 7, 10)])[1] == [4]


def test_order_is_a_longest_increase():
    assert html.longest_increase([0, 1, 5, 2, 3, 4]) == {0, 1, 2, 3, 4}
    assert html.longest_increase([]) == set()


def test_odd_rows(spark):
    odd = [None, "", "plain text only", "<", "<p", "<article>" * 3000 + "deep", "<script>never closed " + "x" * 10, "<!-- never closed", "<a b='" * 2000, "<p>" * 50_000, "<div>" * 50_000 + "t", "&" * 50_000, "<article>\n a\tb\u00a0c \n</article>", "</div></p>x"]
    rows = [(i, None if i % 2 else "u", h, "clash") for i, h in enumerate(odd)] + [(None, "u", "<p>x</p>", "c")] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = {r.page_id: r.text for r in found.collect()}
    assert got[0] == got[1] == got[6] == got[7] == "" and got[2] == "plain text only" and got[12] == "a b c" and got[5] == "deep"
    assert found.count() == len(rows) and html.extract(frame.limit(0)).count() == 0


def test_any_depth_closes():
    for n in (260, 5000):
        page = html.Page(f"<article>start{'<font>' * n}deep<nav>menu</nav></article><footer>foot</footer><script>s()</script><div class=comments>said</div>")
        assert html.main_text(page) == "startdeep"
        under = html.Page(f"<article>{'<div>' * n}in<aside>beside</aside>{'</div>' * n}after</article>out")
        assert html.main_text(under) == "in after"
    assert html.Page("<p>a" + "<b>" * 20 + "<div>c").parents == html.Page("<p>a" + "<b>" * 20 + "</p><div>c").parents


def test_deep_template_in_linear_time():
    n = 20_000
    rows = [[k, k - 1, html.PLAIN, 0, k] for k in range(1, n + 1)]
    assert html.deduce(rows, [{"what": html.SLOT, "key": n, "other": 0, "a": 100, "b": 0, "low": 0, "high": 0}])[1] == [n]
