import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from gridweave.llm import wrappers
from gridweave.llm.queries import QUERIES

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="x">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">A</a></li><li><a>B</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div id=sidebar><p>side</p></div>
<article><h1>Head &amp; line</h1><p>One  two
three<br>four</p><p>Un<b>bold</b>ed &lt;x&gt;<p>open <em>end</em><div class="ad">buy</div><form><p>mail?</p></form><ul><li>i</li><li>j</li></ul>
<pre>a  b</pre></article><section class="comments"><p>first!</p></section><footer>&copy; me</footer></body></html>"""
TEXT = "Head & line\nOne two three four\nUnbolded <x>\nopen end\ni\nj\na b"


def test_query_against_documents(spark, sf_dir):
    """The pages show documents: after the headline, each line is a block."""
    got = QUERIES["op8_page_text"](spark, sf_dir).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    for r in got:
        doc = docs[int(re.search(r"/(\d+)", re.sub("^.*?://[^/]*", "", r.url))[1])]
        lines = [" ".join(x.split()) for x in doc.split("\n")]
        assert r.text.split("\n")[1:] == [x for x in lines if x] and r.n_chars == len(r.text)


def test_boilerplate_and_malformed_markup():
    assert wrappers.read(PAGE, None) == TEXT
    assert wrappers.read(PAGE, wrappers.infer([PAGE, PAGE.replace("<pre>a  b</pre>", "")])) == TEXT
    assert wrappers.read("<html><body><div class=menu>m</div><div class=story><p>Long text of a page without article.</p><p>More of it.</p></div></body>", None) == "Long text of a page without article.\nMore of it."
    for page in ("", "plain", "<", "<p", "<article", "<article><p>x", "</p></div>x", "<a href='>x", "<!-- open"):
        wrappers.read(page, None)
    assert wrappers.read("<article><p>x", None) == "x" and wrappers.read("plain  text", None) == "plain text"
    # an open quote ends with its tag, a head without end tag ends where the body begins, apostrophes in attributes are no quotes
    assert wrappers.read("<article><a href='>x</a><p>y</article>", None) == "x\ny" and wrappers.read("<head><title>t</title><p>x", None) == "x"
    assert wrappers.read("<article><p don't>it's</p><p title=\"a>b\">c</p></article>", None) == "it's\nc"


def test_class_words_count_by_their_head():
    page = "<article><p>a</p><div class='notice-board'>b</div><div class='cookie-notice'>n</div><div class='story-social'>s</div><div class='comment-list'>c</div><div class='ad_slot1'>d</div></article>"
    assert wrappers.read(page, None) == "a\nb"
    # never for the page, the body or the main element
    assert wrappers.read("<html class=ad><body class='search'><main class='widget'><p>x</p></main></body></html>", None) == "x"


def page_of(k, inner="", host="div class=post"):
    return f"<body><div class=top>Our site</div><{host}><h1>Title {k}</h1>{inner}" + "".join(f"<p>Text {k} of paragraph {i}.</p>" for i in range(k % 5 + 1)) + f"<div class=tell>Tell a friend</div></{host.split()[0]}><div class=more><a>Another {k}</a></div></body>"


def want_of(k):
    return "\n".join([f"Title {k}", *(f"Text {k} of paragraph {i}." for i in range(k % 5 + 1))])


def test_the_template_is_no_text():
    """Neither the head line of a site nor a line in every article is named by a class word; that it is the same on all pages tells."""
    for host in ("div class=post", "article"):
        pages = [page_of(k, host=host) for k in range(24)]
        wrapper = wrappers.infer(pages)
        assert [wrappers.read(p, wrapper) for p in pages] == [want_of(k) for k in range(24)]
        assert "Tell a friend" in wrappers.read(pages[3], None)
    # pages that are copies of one another tell nothing
    same = [page_of(3, host="article")] * 24
    assert wrappers.read(same[0], wrappers.infer(same)) == want_of(3) + "\nTell a friend"


def test_the_expression_decides():
    pages = [page_of(k) for k in range(24)]
    expression, keep = wrappers.infer(pages)
    assert wrappers.read(pages[3], (expression, keep)) == want_of(3)
    assert wrappers.read(pages[3], (expression, [not k for k in keep])) != want_of(3)
    # one that doesn't match is not used: the page is read by itself, and the template isn't known
    garbage = (wrappers.load('[["<x","",[["#","",[]]]]]'), [True])
    assert wrappers.read(pages[3], garbage) == wrappers.read(pages[3], None) != want_of(3)


def test_inference():
    a, b = "<ul><li>1</li><li>2</li></ul><p>x</p>", "<ul><li>1</li></ul><h2>n</h2><p>y</p>"
    e, keep = wrappers.infer([a, b])
    assert wrappers.show(e) == "<ul> <li> # </+ </ <h2> # </? <p> # </" and len(keep) == 3 and wrappers.load(wrappers.dump(e)) == e
    own = lambda x: wrappers.show(wrappers.expression(wrappers.parse(x)))
    assert own("<dl><dt>a<dd>b<dt>c<dd>d</dl>") .startswith("<dl>") and own("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>") == "(<h2> # </ <p> # </)+"
    assert own("<p>a</p><p></p><p><b>c</b></p>") == "<p> #? </+"
    wide = "".join(f"<{t}>x</{t}><p>y</p>" for t in ["div class=k" + chr(97 + i // 26) + chr(97 + i % 26) for i in range(200)])
    assert own(wide) == "(<div> # </? <p> # </?)*" and wrappers.read(wide, None) == "\n".join(["x", "y"] * 200)


TAGS = ["<div>", "</div>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "x", "y ", "<h2>", "</h2>", "<article>", "</article>", "<table>", "<tr>", "<td>", "</table>", "<b>", "</b>", "<div class=a>", "<br>", "<nav>", "</nav>", "<dt>", "<dd>", "<a href='", "<!--", "<", "&amp;"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(TAGS), max_size=80).map("".join), min_size=1, max_size=4))
def test_expressions_match_their_pages(pages):
    parsed = [wrappers.parse(p) for p in pages]
    own = [wrappers.expression(p) for p in parsed]
    for p, e in zip(parsed, own, strict=True):
        got = wrappers.Wrapper(e).match(p.kids)
        assert got is not None and sorted(got) == list(range(len(p.blocks)))
    wrapper = wrappers.infer(pages)
    for p in pages:
        assert set(wrappers.read(p, wrapper).split("\n")) <= {"", *wrappers.parse(p).blocks}


def test_long_malformed_pages_take_linear_time():
    n = 100_000
    for unit in ("<div>", "<p>x", "<a href='", '<a b="', "<div class=x", "<b>", "<ul><li>", "</div>", "<!--", "<script>", "<table><tr><td>a<td>b", "<", "<p>a<h2>b<div>c</div><p>d"):
        began = time.perf_counter()
        wrappers.read(unit * n, None)
        assert time.perf_counter() - began < 20, unit
    began = time.perf_counter()
    wrappers.read("<div>" * n, None)
    assert time.perf_counter() - began < 5


def test_wrappers_of_hosts(spark):
    """Two templates on one host, groups smaller than the host's expressions, and hosts that don't mix."""
    rows = [(k, f"http://a.example/{k}", page_of(k, f"<ul><li>x{k}</li></ul>" * (k % 3 == 0))) for k in range(60)]
    rows += [(100 + k, f"http://a.example/{k}", page_of(k, host="article")) for k in range(30)]
    rows += [(200 + k, f"http://b.example/{k}", "<main>Tell a friend</main>") for k in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    for group in (2, 200):
        got = {r.page_id: r.text for r in wrappers.extract(df, group=group).collect()}
        for k in range(60):
            lines = want_of(k).split("\n")
            assert got[k] == "\n".join([lines[0], *([f"x{k}"] * (k % 3 == 0)), *lines[1:]])
        assert [got[100 + k] for k in range(30)] == [want_of(k) for k in range(30)] and got[200] == got[201] == "Tell a friend"


def test_edge_cases(spark):
    rows = [(1, None, None, "x"), (2, "http://a/1", None, "x"), (3, "http://a/1", "", "x"), (4, "http://a/2", PAGE, "x"), (4, "http://a/2", PAGE, "x"), (None, None, PAGE, None), (6, "b", "<article>" + "<p>w</p>" * 20_000 + "</article>", "x")]
    got = wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    out = {r.page_id: r.text for r in got.collect()}
    assert got.count() == 7 and out[1] == out[2] == out[3] == "" and out[4] == out[None] == TEXT and out[6] == "\n".join("w" * 20_000)
    assert wrappers.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
