import json
import random

import pytest

from siltstone.llm import html_extraction as h
from siltstone.llm.html_pages import read
from tests.llm.helpers import words

PAGES = "page_id long, url string, html string"


def text_of(*pages):
    """The text of the last page by the wrapper of all."""
    whole = h.of_page(read(pages[0]))
    for p in pages[1:]:
        h.merge(whole, h.of_page(read(p)), h.PARTS)
    return h.main_text(read(pages[-1]), h.Wrapper(h.load(h.dump(whole))))


def inferred(*pages):
    whole = h.of_page(read(pages[0]))
    for p in pages[1:]:
        h.merge(whole, h.of_page(read(p)), h.PARTS)
    return h.expression(whole)


def test_mismatches_become_slots_options_and_repeats():
    assert inferred("<h1>A</h1><p>x</p>", "<h1>A</h1><p>y</p>") == "<page> <h1> text </> <p> # </> </>"
    assert inferred("<p>x</p>", "<p>x</p><p>y</p><p>z</p>") == "<page> (<p> # </>)+ </>"
    assert inferred("<h1>A</h1><p>x</p>", "<h1>B</h1><ul><li>1<li>2</ul><p>y</p>") == "<page> <h1> # </> (<ul> (<li> # </>)+ </>)? <p> # </> </>"
    assert inferred("<h2>a</h2><p>1</p><h2>b</h2><p>2</p><h2>c</h2><p>3</p><p>4</p>") == "<page> ((<h2> # </> (<p> # </>)+))+ </>"
    assert inferred("<h2>a</h2><p>1</p>", "<h2>b</h2><p>2</p><h2>c</h2><p>3</p>") == "<page> ((<h2> # </> <p> # </>))+ </>"
    assert inferred("<div class=x1>a</div>", "<p>b</p><div class=x2>c</div>") == "<page> (<p> text </>)? <div.x> # </> </>"


def test_merging_does_not_depend_on_how_pages_are_dealt():
    rng = random.Random(1)
    pages = [f"<h1>T{k}</h1>" + "".join(rng.choice([f"<p>{i}</p>", "<ul><li>a<li>b</ul>", f"<table><tr><td>{i}<td>x</table>"]) for i in range(rng.randint(1, 6))) + "<footer>F</footer>" for k in range(60)]
    parts = []
    for at in range(0, 60, 10):
        whole = h.of_page(read(pages[at]))
        for p in pages[at + 1 : at + 10]:
            h.merge(whole, h.of_page(read(p)), h.PARTS)
        parts.append(h.dump(whole))
    whole = h.load(parts[0])
    for p in parts[1:]:
        h.merge(whole, h.load(p), h.PARTS)
    assert whole.n == 60 and [p.key for p in whole.inside if not p.optional] == [" h1", "-footer"]
    w = h.Wrapper(whole)
    assert [h.main_text(read(p), w).split("\n")[0] for p in pages] == [f"T{k}" for k in range(60)]


@pytest.mark.parametrize(
    "page,text",
    [
        ("<article><h1>A &amp; B</h1><p>one\n two<b>three</b></p>tail</article>", "A & B\none twothree\ntail"),
        ("<body><header>site</header><nav><a href=x>menu</a></nav><main><h1>T</h1><p>x<p>y</main><aside>s</aside><footer>f</footer>", "T\nx\ny"),
        ("<article><header><h1>T</h1><nav>n</nav></header><p>x</p><form>mail <input></form><footer>f</footer><div class='ad box'>buy</div><p>y</article>", "T\nx\ny"),
        ("<article><p>x</p><section id=comments><article><p>first!</p></article></section></article><div class=comment-list><article>me too</article></div>", "x"),
        ("<div class='ad'>buy<article><p>x</p></article>", "x"),
        ("<form action=/><div id=content><h1>T</h1><p>x</p></div></form>", "T\nx"),
        ("<div class=sidebar>s</div><div class='entry-content'><p>x</p><div class=cookie-notice>c</div></div>", "x"),
        ("<script>var a = '<article>no</article>';</script><style>p{}</style><article><script>b</script>x<!-- c --><p>y", "x\ny"),
        ("<article><p>a &lt;b&gt; &#233;&#x4e2d;&nbsp;&copy; &unknown; &am</p></article>", "a <b> é中 © &unknown; &am"),
        ("<article><p title=\"a>b\" data-x='1'>x</p><p title=don't>isn't</p></article>", "x\nisn't"),
        ("<article><ul><li>1<li>2<ul><li>3</ul></ul><table><tr><td>a<td>b<tr><th>c</table><pre> d\n e </pre><blockquote>q</article>", "1\n2\n3\na\nb\nc\nd e\nq"),
        ("<article>a<br>b<hr>c<p hidden>no<p style='display: none'>no<p>d</article>", "a b\nc\nd"),
        ("<article>one</article><p>between</p><article>two</article>", "one\ntwo"),
        ("<ARTICLE><P>x < y & z</P></ARTICLE", "x < y & z"),
        ("<article></article>", ""),
        ("plain text\nwith lines", "plain text with lines"),
        ("", ""),
        (None, ""),
    ],
)
def test_single_pages(page, text):
    assert text_of(page) == text


def test_unmarked_pages_lose_what_all_pages_share():
    rng = random.Random(2)
    page = lambda i: f"<div class=a><a href=1>Home</a><a href=2>News</a></div><div class=b><div class=c><h1>{words(rng, 5)}</h1><p>{words(rng, 60)}</p><p>Read on.</p></div><div class=d><p>About this site</p><p>{i}</p></div></div>"
    pages = [page(i) for i in range(8)]
    got = text_of(*pages).split("\n")
    assert len(got) == 3 or len(got) == 2 and "About this site" not in got and "Home News" not in got
    assert got[1] in pages[-1]
    assert text_of(*[pages[0]] * 5).count("\n") >= 2  # copies only: nothing varies, nothing is taken for a template


def test_odd_pages_never_fail():
    rng = random.Random(3)
    bits = ["<", ">", "</", "<p", "<article>", "</article>", "<div class=", "'", '"', "&", "&#", "&#x110000;", "text ", "<!--", "-->", "<script>", "</script>", "<td>", "<table>", "</p>", "<![CDATA[", "\0", "<a href=x>", "</a>", "<h1>", "<svg/>", "<br/>", "=", "/"]
    for _ in range(3000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert isinstance(text_of(page, page[::2], page), str)
    deep = text_of("<article>" + "<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y</p></article>")
    assert deep == "x\ny"
    wide = "".join(f"<p class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>w{i}</p>" for i in range(20_000))
    assert text_of(f"<article>{wide}</article>", "<article><p>x</p></article>", f"<article>{wide}</article>").count("\n") == 19_999


def test_on_spark(spark, monkeypatch):
    """Whole tables: nulls, repeats, clashing columns; many partitions, hosts that leave a task's memory, merging in rounds."""
    rng = random.Random(4)
    rows = []
    for i in range(300):
        host = f"http://{'hot' if i % 3 else f'h{i % 40}'}.example.com:80/p?{i}"
        body = "".join(f"<p>{words(rng, 12)}</p>" for _ in range(rng.randint(1, 5)))
        rows.append((i, host, f"<html><head><title>t</title></head><body><nav>menu {i}</nav><article><h1>{i}</h1>{body}</article><footer>f</footer>"))
    rows += [(None, None, "<article>x</article>"), (900, "no address", None), (901, None, ""), rows[0], (902, "HTTP://HOT.example.com", "<article>" + "long " * 100_000 + "</article>")]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "'clash' AS host", "'clash' AS wrapper", "1 AS slot", "'clash' AS text").repartition(9)
    monkeypatch.setattr(h, "FAN_IN", 2)
    monkeypatch.setattr(h, "BROADCAST_BYTES", 0)
    wrappers = h.infer(pages).cache()
    found = {r.host: r for r in wrappers.collect()}
    assert len(found) == wrappers.count() and sum(r.n_pages for r in found.values()) == len(rows)
    assert found["hot.example.com"].n_pages == 201 and json.loads(found["hot.example.com"].wrapper)[0] == " page"
    got = sorted((repr(r.page_id), r.url or "", r.text, r.n_chars) for r in h.extract(pages, wrappers).collect())
    want = sorted((repr(i), u or "", text_of(p), len(text_of(p))) for i, u, p in rows)
    assert got == want
    assert h.extract(pages.limit(0), h.infer(pages.limit(0))).count() == 0


def test_parts_are_learnt_however_many_there_are(spark, monkeypatch):
    """A page of more parts than PARTS comes first; what the others share is learnt all the same, on Spark too."""
    rng = random.Random(5)
    wide = "".join(f"<p class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}>w{i}</p>" for i in range(h.PARTS + 1))
    pages = [f"<div class=b><div class=c><h1>{words(rng, 5)}</h1><p>{words(rng, 60)}</p></div><div class=d><p>About this site</p></div></div>" for _ in range(8)]
    assert text_of(*pages).count("\n") == 1 and text_of(wide, *pages) == text_of(*pages)
    rows = [(i, "http://a.b/", p) for i, p in enumerate([wide, *pages, wide, *pages])]
    monkeypatch.setattr(h, "FAN_IN", 2)
    wrapper = h.infer(spark.createDataFrame(rows, PAGES).coalesce(1)).collect()
    assert len(wrapper) == 1 and wrapper[0].n_pages == len(rows)
    inside = {p.key: p.n for p in h.load(wrapper[0].wrapper).inside}
    assert inside[" div.b"] == 16 and len(inside) == h.PARTS + 2
