"""Main texts of pages: the array against all substrings, blocks against markup written by hand, hosts in blocks against hosts whole."""

from __future__ import annotations

import html
import random
import re

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import host_suffix_array as hsa
from factloom.llm import page_parts as pp
from factloom.llm import queries

FIELDS = "page_id long, url string, html string, host string, block string, gram long"


def texts(source):
    page, main = pp.page_parts(source)
    return [b.text for b in page.blocks if b.main or not main]


def test_suffixes_are_sorted_and_share_what_they_share():
    rng = random.Random(1)
    for _ in range(150):
        x = np.array([rng.randrange(3) for _ in range(rng.randrange(2, 70))])
        order, shared = hsa.suffix_array(x)
        assert [x[i:].tolist() for i in order] == sorted(x[i:].tolist() for i in range(len(x)))
        for a, b, n in zip(order, order[1:], shared, strict=False):
            assert x[a : a + n].tolist() == x[b : b + n].tolist()
            assert max(a, b) + n == len(x) or x[a + n] != x[b + n]


def by_hand(pages, long):
    held = {}
    for at, p in enumerate(pages):
        for i in range(len(p) - long + 1):
            held.setdefault(tuple(p[i : i + long]), set()).add(at)
    out = [np.zeros(len(p), dtype=bool) for p in pages]
    for p, own in zip(pages, out, strict=True):
        for i in range(len(p) - long + 1):
            own[i : i + long] |= len(held[tuple(p[i : i + long])]) > 1
    return out


def test_what_two_pages_hold_is_covered():
    rng = random.Random(2)
    for _ in range(150):
        pages = [[rng.randrange(4) for _ in range(rng.randrange(0, 40))] for _ in range(rng.randrange(1, 6))]
        x, page = [], []
        for i, p in enumerate(pages):
            x += [*p, 1000 + i]
            page += [i] * (len(p) + 1)
        got, at = hsa.repeated(np.array(x), np.array(page), 4), 0
        for p, want in zip(pages, by_hand(pages, 4), strict=True):
            assert got[at : at + len(p)].tolist() == want.tolist()
            at += len(p) + 1


def test_blocks_of_markup():
    assert texts("<article><h1>A &amp; B</h1><p>one\n  two<b>three</b> <i>four</i><p>five<br>six</article><p>out") == ["A & B", "one twothree four", "five six"]
    assert texts("<main><p>x</p><aside>no</aside><div class='post-comments'><p>no</p></div><div class='with-sidebar'>y</div></main>") == ["x", "y"]
    assert texts("<div>a<span class=ad>buy</span> b</div><form>no<input></form><header>no</header><footer>no</footer>") == ["a b"]
    assert texts("<article><header><h1>T</h1></header><nav>no</nav>x<footer>no</footer></article>") == ["T", "x"]
    assert texts("<article class=comment>no</article><p>text</p>") == ["text"]
    assert texts("<article class='post category-social has-sidebar'><div class='article-header'><h1>T</h1></div><div class='entry-content'>x</div><ol class='comment-list'><li>no</ol><div class='share-buttons'>no</div></article>") == ["T", "x"]
    assert texts("<div class='site-header'>no</div><div class='cookie-bar'>no</div><div class='ad-slot'>no</div><div class='footer-widgets'>no</div><div class='platform'>yes</div>") == ["yes"]
    assert texts("<script>var a='</p><article>no</article>'</script><!-- <article>no --><article>yes</article>") == ["yes"]
    assert texts("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == ["a", "b", "c", "d"]
    assert texts("a < b &lt; c &#233;&nbsp;&unknown; <p title=\"x>y\">z</p><p t='unclosed>w</p>") == ["a < b < c é &unknown;", "z", "w"]
    assert texts("<div role=navigation>no</div><div id='cookie-notice'>no</div><div hidden>no</div><p>yes") == ["yes"]
    assert texts("") == [] and texts("<article>") == [] and texts("<p>cut <b") == ["cut"] and texts("<style>p{") == []


def test_unclosed_markup_takes_linear_time():
    for source in ("<div>" * 30_000 + "x", "<p><b>" * 30_000 + "x", "<" * 200_000, "<!--" * 50_000, "&amp" * 50_000, "<a b=c " * 30_000):
        assert len(texts(source)) <= 1


def page(i, words, foot="", article=False):
    body = f"<article><p>{words}</p></article>" if article else f"<p>{words}</p><p>{foot}</p>"
    return f"<html><body><nav><a>m{i}</a></nav>{body}<footer>f</footer></body></html>"


FOOT = "this line of many words stands at the end of two pages of the host and of no others"


def site():
    words = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, f"http://Hot.example/{i}?q", page(i, words(i), f"own foot {i} " + " ".join(f"z{i}y{k}" for k in range(9)))) for i in range(60)]
    rows += [(60 + i, f"http://hot.example/f{i}", page(60 + i, words(60 + i), FOOT)) for i in range(2)]
    rows += [(70, "http://other.example/", page(70, words(70), FOOT)), (71, None, None), (72, "no scheme", ""), (73, "http://one.example", page(73, FOOT, article=True)), (74, "http://one.example/2", page(74, FOOT, article=True))]
    rows += [(75, "http://two.example/a", page(75, words(75), FOOT)), (76, "http://two.example/b", page(75, words(75), FOOT)), (None, "http://one.example/2", page(74, FOOT, article=True)), (2**53 + 1, "http://u.example", "<p>" + "long " * 300_000)]
    return [(i, u, h, "x", "y", 1) for i, u, h in rows]


def test_repeated_stretches_go_alike_however_a_host_is_dealt(spark):
    df = spark.createDataFrame(site(), FIELDS).repartition(3)
    told = []
    for size in (hsa.BLOCK_BYTES, 20_000, 2_000):
        told.append({(r["page_id"], r["url"]): (r["text"], r["n_chars"]) for r in hsa.extract(df, block_bytes=size).collect()})
        assert len(told[-1]) == df.count()
    assert told[0] == told[1] == told[2]
    lines = {k[0]: t.split("\n") for k, (t, _) in told[0].items()}
    assert all(len(lines[i]) == 2 for i in range(60))
    assert len(lines[60]) == len(lines[61]) == 1 and FOOT not in lines[60]
    assert lines[70][1] == lines[73][0] == lines[74][0] == lines[75][1] == lines[76][1] == FOOT  # another host, articles, copies
    assert lines[71] == lines[72] == [""] and told[0][2**53 + 1, "http://u.example"][1] == 300_000 * 5 - 1
    assert hsa.extract(df.where("false")).count() == 0


def test_names_find_what_repetition_cannot(spark):
    df = spark.createDataFrame(site(), FIELDS)
    told = {r["page_id"]: r for r in hsa.extract(df.where("page_id in (70, 5, 6)"), counts=True).collect()}
    assert told[70]["n_named"] == 2 and told[70]["n_repeated"] == 0


def test_articles_of_the_smallest_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in queries.op12_host_suffix_array(spark, "/root/testdata/sf0.001").collect()}
    for r in df.collect():
        inside = re.sub("</?(?:b|br)>", " ", re.search("<article>(.*)</article>", r["html"], re.S)[1])
        blocks = [" ".join(html.unescape(b).split()) for b in re.split("<[^>]*>", inside)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"], got[r["page_id"]]["url"]) == (want, len(want), r["url"])
    assert df.count() == len(got)
    counts = hsa.extract(df.withColumn("url", F.lit("http://same.example/")), counts=True)
    assert counts.agg(F.min("n_repeated")).first()[0] > 20  # menus and adverts of one site's pages


def listed(*names):
    return "<ul class=x>" + "".join(f"<li><a href='/{n}'>{n}</a></li>" for n in names) + "</ul>"


MENU, REFS = listed("start", "politics", "sport", "weather", "contact"), listed("Adams", "Baker", "Clark", "Davis", "Evans")
COPIED = "<p>A paragraph that <a href=/a>two</a> articles <a href=/b>of one</a> site quote, <a href=/c>with links</a>, is text of both.</p>"


def articles():
    def row(i, inner, host="menus.example"):
        return i, f"http://{host}/{i}", f"<body><p>top {i}</p><article>{inner}</article></body>", "x", "y", 1

    told = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [row(i, f"<h1>Title {i}</h1><p>{told(i)}</p>{MENU}<p>end {i}</p>") for i in range(40)]
    rows += [row(40 + i, f"<h1>One title</h1>{REFS}<p>{told(40 + i)}</p>") for i in range(2)]
    rows += [row(50, f"<h1>Title 50</h1><p>{told(50)}</p>{listed('Fox', 'Gray', 'Hill', 'Irwin')}"), row(51, MENU)]
    rows += [row(52 + i, f"<h2><a href=/t>Same heading of some words in a link, on two pages here</a></h2><p>{told(52 + i)}</p>{COPIED}") for i in range(2)]
    rows += [row(54 + i, f"<p>{told(54 + i)}</p>{COPIED}<p><a href=/d>A paragraph all of whose many words stand in one link is no list of any links.</a></p>") for i in range(2)]
    return [*rows, row(60, f"<h1>Title 60</h1>{MENU}", "other.example")]


def test_menus_without_a_name_inside_articles_are_found_by_the_array_alone(spark):
    df = spark.createDataFrame(articles(), FIELDS).repartition(3)
    plain = {i: "\n".join(b.text for b in pp.page_parts(source)[0].blocks if b.main) for i, _, source, *_ in articles()}
    menu = "\nstart\npolitics\nsport\nweather\ncontact"
    want = {i: t.replace(menu, "") if i < 40 else t for i, t in plain.items()}
    assert all(menu in plain[i] for i in range(40)) and "Adams" in want[40] and "Fox" in want[50] and menu in want[60]
    for size in (hsa.BLOCK_BYTES, 4_000, 700):
        assert {r["page_id"]: r["text"] for r in hsa.extract(df, block_bytes=size).collect()} == want
    page, main = pp.page_parts(articles()[0][2])  # switched off, the array leaves the menu
    assert hsa.main_text(page, main, np.zeros(len(page.stream), dtype=bool))[0] == plain[0]


def test_links_of_blocks():
    links = lambda source: [b.links for b in pp.page_parts(f"<article>{source}</article>")[0].blocks]
    assert links("<p><a href=x>a</a> | <a href=y>b <i>c</i></a></p><p>no <a href=x>a</a></p><p><a name=x>a</a></p>***") == [2, None, None, None]
    assert links("<h2><a href=x>a</a></h2><p><a href=x>a<p>b</p>") == [None, 1, None]
    assert [b.links for b in pp.page_parts("<p><a href=x>a</a></p>")[0].blocks] == [None]
