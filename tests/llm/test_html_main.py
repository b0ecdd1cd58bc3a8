"""Main text of pages: markup, wrapper induction over one host, tree matching against brute force, awkward pages."""

import functools
import html
import random
import re

from corpusloom.llm import dom
from corpusloom.llm.html_main import host, main_text

SCHEMA = "page_id long, url string, html string, text string, host string, pages int"


def text_of(page):
    return dom.article(dom.runs(dom.parse(page), dom.Shape(dom.blob(dom.parse("")))))


def extracted(spark, pages, parts=3):
    rows = [(i, u, h, "x", "y", 1) for i, u, h in pages]
    return [(r.page_id, r.url, r.text, r.n_chars) for r in main_text(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()]


ARTICLE = "<article><h1>Head &amp; line</h1><p><b>One two<br>three<p>Four&nbsp;\n five <i>si</i>x</p><ul><li>a<li>b</ul><p>&lt;tag&gt; &#233;</article>"
WANT = "Head & line One two three Four five six a b <tag> é"


def test_parts_of_pages_that_markup_names():
    around = [
        "<nav><ul><li><a href=/a>Menu</a></ul></nav>", "<header><h1>Site</h1></header>", "<footer>&copy; foot</footer>", "<aside>side</aside>", "<form><label>Mail</label><input></form>",
        "<div class='ad'>buy</div>", '<div id="cookie-banner">cookies</div>', "<section class=comments><article class=comment><p>I say</p></article></section>", "<script>var a='</p>';</script>",
        "<style>p{}</style>", "<!-- <p>no</p> -->", "<noscript>no</noscript>", "<div class='siteNotice'>notice</div>", "<div role=navigation>go</div>", "<dialog>ask</dialog>",
        "<div class=sidebar><p>Links</div>", "<template><p>t</p></template>", "<iframe>f</iframe>", "<select><option>1<option>2</select>", "<div class='share social'>Share</div>", "<?php x ?>", "<!DOCTYPE html>",
    ]
    for part in around:
        assert text_of(f"<html><head><title>T</title></head><body>{part}{ARTICLE}{part}</body></html>") == WANT, part
    assert text_of("".join(around) + ARTICLE + "".join(around)) == WANT
    for part in around[:13]:  # comments, forms and adverts inside the article, too
        if "header" not in part:
            assert text_of(ARTICLE.replace("</ul>", "</ul>" + part)) == WANT, part


def test_elements_around_the_article_stay():
    for before, after in (("<form class=login>", "</form>"), ("<div class='content with-sidebar'>", "</div>"), ("<div class=widget><main>", "</main></div>"), ("<header>", "</header>")):
        assert text_of(before + ARTICLE + after) == WANT
    assert text_of("<main><h1>Title</h1><article><p>body</p></article><p>more</p></main>") == "Title body"
    assert text_of("<article><header><h1>Title</h1></header><p>body</p><footer>by me</footer></article>") == "Title body"
    assert text_of("<div class=x><p>plain</p> text</div>") == "plain text"
    assert text_of("<ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul><p>words <a href=4>link</a> words</p>") == "words link words"


def test_broken_markup():
    assert text_of("a < b and c > d") == "a < b and c > d"
    assert text_of("<p>one</div></b>two<p>three") == "one two three" or text_of("<p>one</div></b>two<p>three") == "onetwo three"
    assert text_of("<p>x <a title=\"a > b\" href='>'>y</a> z") == "x y z"
    assert text_of("<p>x<!-- never closed <p>y") == "x"
    assert text_of("<p>x<script>never closed <p>y") == "x"
    assert text_of("<p>x <a href='y") == "x"
    assert text_of("<p>1<!-->2<!--->3<![CDATA[4]]>5") == "1235"
    assert text_of("<td>loose</td><tr>row") == "loose row"
    assert text_of("") == text_of("<>") .replace("<>", "") == ""
    deep = "<div>" * 5000 + "deep" + "</div>" * 2000
    assert text_of(deep + "<p>end") == "deep end"
    wide = "".join(f"<p>w{i}</p>" for i in range(20_000))
    assert text_of(f"<article>{wide}</article>") == " ".join(f"w{i}" for i in range(20_000))
    assert text_of("<a<" * 20_000 + ">x") == "x"
    assert len(text_of("<p>" + "&amp; " * 300_000)) == 599_999


def test_matching_equals_the_plain_recursion():
    rnd = random.Random(8)

    def tree(depth=0):
        tags = ["div", "section", "ul", "article"]
        return "".join(f"<{t}>{tree(depth + 1)}</{t}>" if depth < 3 else "w" + str(rnd.randrange(3)) for t in rnd.choices(tags, k=rnd.randint(1, 3)))

    for _ in range(60):
        a, b = (dom.Shape(dom.blob(dom.parse(tree()))) for _ in range(2))

        @functools.cache
        def best(i, j):
            if a.label[i] != b.label[j]:
                return 0
            return 1 + (a.text[i] == b.text[j] != 0) + lists(tuple(a.kids[i]), tuple(b.kids[j]))

        @functools.cache
        def lists(left, right):
            if not left or not right:
                return 0
            return max(lists(left[1:], right), lists(left, right[1:]), (s := best(left[0], right[0])) and s + lists(left[1:], right[1:]))

        met = dom.match(a, b)
        assert len(set(met.values())) == len(met) and all(a.label[i] == b.label[j] for i, j in met.items())
        assert sum(1 + (a.text[i] == b.text[j] != 0) for i, j in met.items()) == best(0, 0)


def test_constant_texts_of_a_host_go(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    pages, want = [], {}
    for i in range(24):
        paragraphs = [" ".join(word() for _ in range(rnd.randint(5, 30))) for _ in range(rnd.randint(1, 6))]
        extra = "<div class=x><p>Only sometimes</p></div>" if i % 2 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        pages.append((i, f"https://Site.example/{i}", f"<div><p>All rights are ours</p></div><div class=y>{body}<p>Read us daily</p></div>{extra}<div>Imprint {'x' if i == 3 else ''}</div>"))
        want[i] = " ".join(paragraphs) + (" Imprint x" if i == 3 else "")
    # copies of one article aren't a template, nor is anything on a host of few pages
    copy = "<div><p>Copied words</p><p>" + " ".join(word() for _ in range(40)) + "</p></div>"
    for i in range(100, 110):
        pages.append((i, "http://copies.example/a", copy))
        want[i] = " ".join(re.sub("<[^>]+>", " ", copy).split())
    for i in range(200, 203):
        pages.append((i, "http://few.example", f"<p>Same</p><p>text {i}</p>"))
        want[i] = f"Same text {i}"
    got = extracted(spark, pages)
    assert {i: t for i, _, t, _ in got} == want and all(n == len(t) for _, _, t, n in got)
    assert sorted(extracted(spark, pages, 7)) == sorted(got)


def test_two_templates_on_a_host(spark):
    first = [(i, "http://two.example/", f"<article><h1>t{i}</h1><p>words {i} and more</p><p>Sign here</p></article>") for i in range(6)]
    second = [(i, "http://two.example/", f"<main><p>Shown below</p><p>other {i} words</p></main>") for i in range(10, 16)]
    got = {i: t for i, _, t, _ in extracted(spark, first + second)}
    assert got == {**{i: f"t{i} words {i} and more" for i in range(6)}, **{i: f"other {i} words" for i in range(10, 16)}}


def test_nulls_repeated_rows_and_empty_tables(spark):
    pages = [(1, None, None), (None, "http://a.example", "<p>x &amp; y"), (None, "http://a.example", "<p>x &amp; y"), (2, "nonsense", ""), (3, "http://a.example", "<p> \n </p>")]
    got = sorted(extracted(spark, pages), key=repr)
    assert got == sorted([(1, None, "", 0), (None, "http://a.example", "x & y", 5), (None, "http://a.example", "x & y", 5), (2, "nonsense", "", 0), (3, "http://a.example", "", 0)], key=repr)
    empty = main_text(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_hosts(spark):
    urls = [("http://User:pw@A.Example:80/x", "a.example"), ("https://b.example?q", "b.example"), ("//c", ""), (None, ""), ("ftp://d#e", "d")]
    df = spark.createDataFrame([(u,) for u, _ in urls], "url string")
    assert [r[0] for r in df.select(host(df.url)).collect()] == [h for _, h in urls]


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", body.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        want[r.page_id] = " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())
    assert {r.page_id: r.text for r in main_text(pages).collect()} == want
