import html
import random
import re
from collections import Counter

import pytest

from quarrylane.llm.html_blocks import article_of, blocks_of
from quarrylane.llm.html_extract import WIDTH, Page, Streams, host_of, main_texts, op12_html_extract, repeated


def text_of(page):
    return "\n".join(b.text for b in article_of(blocks_of(page))[0])


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""), ("plain <b>te</b>xt &amp; more", "plain text & more"), ("<p>one<p>two<br>three", "one\ntwo three"), ("<p>a\n\t b &nbsp; c</p>", "a b c"),
        ("<!-- <p>no</p> --><p>yes<script>var t='</p>';</script><style>p{}</style>", "yes"), ("<p>cut off <b>here <a hre", "cut off here"), ("<p>5 &lt; 6 &#233;&#x41;&am", "5 < 6 éA&am"),
        ("<title>t</title><nav>menu</nav><header>top</header><article><h1>H</h1><p>x</p><footer>by</footer></article><aside>side</aside><footer>foot</footer>", "H\nx"),
        ("<main><article><header><h1>H</h1></header><p>text</p><div class='share-buttons'>share</div><section id=comments><article>nice</article></section></article></main>", "H\ntext"),
        ("<div class='site-header'>S</div><ul class=main-menu><li><a href=/>Home</a></ul><div class=post-content><h2>H</h2><p>long text here</div><div class=cookie-notice>cookies</div>", "H\nlong text here"),
        ("<body class='has-sidebar no-ads'><div><p>kept</p></div><div role=navigation>gone</div><div aria-hidden=true>gone</div><p style='display: none'>gone</p>", "kept"),
        ("<article><p>buy <span class=ad>NOW <b>!</b></span> later</p><ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table><pre>x\n  y</pre></article>", "buy later\none\ntwo\na b\nc\nx y"),
        ("<form id=aspnet><p>a page within a form, as some servers make them</p><button>Go</button></form>", "a page within a form, as some servers make them"),
        ("<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><p>Words with <a href=c>a link</a> in them</p>", "Words with a link in them"),
        ("<article>teaser</article><article>" + "the long one " * 9 + "</article><article>other</article>", ("the long one " * 9).strip()),
    ],
)
def test_markup(page, want):
    assert text_of(page) == want


def test_repeated_substrings_equal_counting():
    rng = random.Random(3)
    for _ in range(30):
        pages = [Page.of("".join(f"<p>{' '.join(rng.choices('ab', k=rng.randrange(1, 30)))}" for _ in range(rng.randrange(5)))) for _ in range(rng.randrange(1, 9))]
        s = Streams.of(pages)
        want, named = Counter(), {}
        for a, b in zip(s.pages[:-1], s.pages[1:]):
            seen = {tuple(s.tokens[i : i + WIDTH].tolist()) for i in range(a, b - WIDTH + 1)}
            want.update(seen)
        at, h = s.windows()
        for i, x in zip(at.tolist(), h.tolist()):
            named[x] = tuple(s.tokens[i : i + WIDTH].tolist())
        found, n = repeated(s)
        assert {named[x]: k for x, k in zip(found.tolist(), n.tolist())} == want


def sentence(rng, k=14):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(k))


def site(rng, pages, marked):
    """Pages of a template whose classes say nothing, with what their text should be."""
    menu = [sentence(rng, 2) for _ in range(6)]
    foot, promo = sentence(rng, 12), sentence(rng, 10)
    out = []
    for _ in range(pages):
        body = [sentence(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(1, 6))]
        inner = "".join(f"<p>{p}</p>" for p in body[:1]) + f"<div>{promo}</div>" + "".join(f"<p>{p}</p>" for p in body[1:])
        inner = f"<article>{inner}</article>" if marked else f"<div>{inner}</div>"
        out.append(("".join(f"<div>{m}</div>" for m in menu) + inner + f"<div>{foot}</div>", "\n".join(body)))
    return out


@pytest.mark.parametrize("shard", [1 << 20, 6000, 700])
def test_boilerplate_of_hosts_whatever_the_shards(spark, shard):
    rng = random.Random(11)
    rows, want = [], {}
    for h, (n, marked) in enumerate([(40, False), (25, True), (3, False), (2, False), (1, True), (60, False)]):
        for page, text in site(rng, n, marked):
            rows.append((len(rows), f"https://u@Host{h}.example.org:80/{len(rows)}?q", page))
            if n > 2:
                want[len(rows) - 1] = text
    copies = rows[0][2].replace("<div>", "<section>", 1)
    rows += [(1000 + i, f"http://host0.example.org/copy{i}", copies) for i in range(3)] + [(None, None, "<p>no host</p>"), (2000, "not a url", None), (2001, "http://host0.example.org/e", ""), (2001, "http://host0.example.org/e", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS windows", "2 AS pages", "3 AS host", "4 AS text", "5 AS counts").repartition(5)
    got = main_texts(df, shard=shard).collect()
    assert sorted((r.id or -1, r.url or "") for r in got) == sorted((r[0] or -1, r[1] or "") for r in rows)
    by = {r.id: r.text for r in got}
    assert {k: by[k] for k in want} == want
    assert by[1000] == by[1001] == want[0] and by[None] == "no host" and by[2000] == by[2001] == ""


def test_copies_on_a_small_host_stay(spark):
    page = "<div>menu one two three four five six seven eight</div><div>the article, which three pages of this host have, all of them copies</div>"
    marked = "<article>" + "".join(f"<p>{sentence(random.Random(k))}</p>" for k in range(5)) + "</article>"
    rows = [(i, f"http://a.org/{i}", page) for i in range(3)] + [(i, f"http://b.org/{i}", marked) for i in range(10, 16)]
    got = {r.id: r.text for r in main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == text_of(page) and got[10] == text_of(marked)


def test_hosts(spark):
    urls = [("http://User:pw@Www.Ex.org:8080/a?b#c", "www.ex.org"), ("//cdn.ex.org/x", "cdn.ex.org"), ("/path", ""), ("", ""), (None, ""), ("https://[bad", "[bad")]
    df = spark.createDataFrame([(u, w) for u, w in urls], "url string, want string")
    assert all(r.got == r.want for r in df.select(host_of(df.url).alias("got"), "want").collect())


def test_empty_table(spark):
    assert main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_query_equals_the_marked_articles(spark, sf):
    """The given pages mark their articles: all of the element, block by block, by plain expressions."""
    rows = {r.page_id: r for r in op12_html_extract(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(</article>|\Z)", p.html or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner[1]).replace("<br>", " ")) if inner else []
        want = "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want) and rows[p.page_id].url == p.url
