"""Registered queries over small tables that hold the characters and lengths which their rows were once chosen to avoid."""

import datetime
import html
import re
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import stats
from corpusloom.plans import queries as plans

PAGES = [
    (1, "https://e.org/a", '<html><head><meta name="description" content="Q&amp;A &copy; x"></head><body><h1>Caf&eacute; &amp; bar</h1><a href="/x?a=1&amp;b=2">One &amp; two</a><a href="/y">Y</a><a href="/x?a=1&amp;b=2">Again</a></body></html>'),
    (2, "https://e.org/b", '<h1>Plain</h1><a href="/z">Z</a><a href="/w&quot;">W&middot;</a><a href="/none"></a>'),
    (3, "https://e.org/c", "<p>&copy; nothing</p>"),
]


LONG = "wort " * 90
DOCS = [
    (0, "Straße & Haus &amp; Hof. licensed <b>x</b> &lt;y&gt; " + LONG, "src0", "de"),
    (1, "İstanbul &eacute;t&eacute;. LICENSING " + LONG, "src1", "tr"),
    (2, "Plain title. No notice here. " + LONG, "src2", "en"),
    (3, "GROẞE Maße. License &copy; short", "src5", "de"),
    (4, "&amp;", "src4", "en"),
]


def documents(rows=DOCS):
    return {"documents": (rows, "doc_id long, text string, source string, lang string"), "labels": ([(r[0], 1) for r in rows], "doc_id long, quality int")}


def one_line(text):
    return " ".join(text.split())


def folded(text):
    return unicodedata.normalize("NFKC", text).casefold()


@pytest.fixture
def tables(spark, tmp_path):
    def write(**given):
        for name, (rows, schema) in given.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_pages_with_entities_are_read(spark, tables):
    d = tables(pages=(PAGES, "page_id long, url string, html string"))
    want = set()
    for i, _, h in PAGES:
        found = [html.unescape(x) for x, t in re.findall(r'<a href="([^"]*)">([^<]*)</a>', h) if t]
        want |= {(i, x, found.index(x)) for x in found}
    assert len(want) == 4
    assert sorted(map(tuple, plans.w2_s6_distinct_links(spark, d).collect())) == sorted(want)
    got = {r["page_id"]: (r["h1"], r["description"]) for r in plans.s7_page_metadata(spark, d).collect()}
    assert got == {1: ("Café & bar", "Q&A © x"), 2: ("Plain", ""), 3: ("", "")}


def test_texts_with_entities_and_special_letters_have_results(spark, tables):
    d = tables(**documents())
    clean = {i: one_line(html.unescape(re.sub("<[^>]+>", " ", t))) for i, t, _, _ in DOCS}
    title = {i: t.split(".")[0] for i, t, _, _ in DOCS}
    key = lambda t: "".join(c for c in folded(t) if unicodedata.category(c)[0] in "LN")[:220]

    got = {r["doc_id"]: r for r in plans.f1_f2_f17_f18_clean_text(spark, d).collect()}
    assert {i: r["cleaned"] for i, r in got.items()} == clean
    assert {i: r["title_key"] for i, r in got.items()} == {i: key(t) for i, t in title.items()}

    got = {r["doc_id"]: (r["search_text"], r["glossed"]) for r in plans.f16_f25_search_text_and_glossary(spark, d).collect()}
    gloss = lambda t: re.sub("licens", "LICENC", re.sub("license", "LICENCE", t, flags=re.I | re.A), flags=re.I | re.A)
    assert got == {i: (one_line(folded(f"{title[i]} {s} {lang}")), gloss(t)) for i, t, s, lang in DOCS}

    got = {r["id"]: (r["valid"], r["low"]) for r in plans.c9_c10_abstracts(spark, d).collect()}
    copy = lambda i: key(title[i]) != "" and (key(clean[i]) == key(title[i]) or (key(clean[i]).startswith(key(title[i])) and len(clean[i]) < len(title[i]) + 35))
    assert got == {i: (50 <= len(t) <= 20_000 and not copy(i), len(t) < 45) for i, t in clean.items()}

    assert {r["id"]: r["title"] for r in plans.j6_localize(spark, d).collect()} == {i: one_line(t.upper()) for i, t in title.items()}
    got = {r["id"]: r["search_text"] for r in plans.s18_search_index(spark, d).collect()}
    doi = lambda i: "" if i % 6 == 0 else f"10.2/{i % 700}"
    assert got == {i: one_line(folded(f"{title[i]} {t} {s} {doi(i)}")) for i, t, s, _ in DOCS}
    assert {r["id"] for r in plans.c3_notice_relevant(spark, d).collect()} == set(title)


def test_orders_of_all_years_have_dates(spark, tables):
    days = [datetime.date(1992, 3, 9), datetime.date(1999, 12, 31), datetime.date(2000, 1, 1), datetime.date(2024, 2, 29)]
    d = tables(orders=(list(enumerate(days)), "o_orderkey long, o_orderdate date"))
    got = {r["id"]: (r["mail"], r["number"], r["parts"], r["zh"]) for r in plans.f4_iso_dates(spark, d).collect()}
    # Notices only know years from 2000 on; the earlier day in front is then the last one that they know.
    assert got == {i: (str(x), str(x), f"{x:%Y-%m}-01", str(x) if x.year >= 2000 else "2001-01-01") for i, x in enumerate(days)}


def test_terms_and_dates_far_into_a_text_count(spark, tables):
    far = "Dies. " + "wort " * 400
    rows = [
        (0, far + "shth", "src0", "de"),
        (1, far, "src0", "de"),
        (3, far + "The end", "src5", "de"),
        (4, far, "src5", "de"),
        (5, far + "截止日期：2031年5月6日。", "src5", "de"),
        (6, far + "受理时间至2031年5月6日", "src5", "de"),
    ]
    d = tables(**documents(rows))
    assert {r["id"]: r["relevant"] for r in plans.c3_notice_relevant(spark, d).collect()} == {0: False, 1: True, 3: False, 4: False, 5: False, 6: False}
    assert [r["doc_id"] for r in plans.c13_directory(spark, d).collect()] == [3]
    days = {i: str(datetime.date(2001, 1, 1) + datetime.timedelta(i * 13 % 9000)) for i, *_ in rows}
    got = {r["doc_id"]: (r["published"], r["deadline_zh"], r["deadline_en"], r["english"]) for r in plans.f5_f6_f7_notice_dates(spark, d).collect()}
    # A Chinese deadline anywhere in the text goes before an English one.
    assert got == {i: (x, x, "2031-05-06" if i > 4 else x, x) for i, x in days.items()}


def test_selection_has_its_top_topics(spark):
    tags = {1: "ab", 2: "abc", 3: "cd", 4: "e", 5: "fg", 6: ""}
    papers = spark.createDataFrame([(i, list(t)) for i, t in tags.items()], "id long, categories array<string>")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    priorities = spark.createDataFrame([("c", 9), ("b", 3), ("g", 5), ("f", 1)], "name string, priority int")
    got = stats.selection_metrics(papers, ids(1, 1, 9), ids(2, 3), ids(), priorities).collect()
    assert [r.asDict() for r in got] == [{"results": 6, "favorites": 1, "keyword_hits": 2, "noted": 0, "topics": "c:2,b:2,a:2,g:1,f:1"}]
    assert stats.selection_metrics(papers.where("id = 6"), ids(), ids(), ids(), priorities).first()["topics"] == ""


def test_health_has_the_last_success_and_the_board_its_sources(spark):
    rows = [("notice", "a", True, 1), ("notice", "a", False, 5), ("notice", "b", False, 2), ("notice", "b", True, 3), ("news", "a", False, 9)]
    runs = spark.createDataFrame([(k, n, ok, t, 1, 1, t) for k, n, ok, t in rows], "kind string, name string, ok boolean, run_at long, count int, duration_ms int, seq long")
    got = {r["kind"]: (r["sources"], r["healthy"], r["last_success"]) for r in stats.source_health(runs).collect()}
    assert got == {"notice": (2, 1, 3), "news": (1, 0, None)}
    notices = spark.createDataFrame([("2024-01-05", "", "2024-01-01")], "first_seen string, deadline string, published string")
    for r, want in ((runs, (1, 2)), (runs.where("kind = 'news'"), (0, 0))):
        board = stats.notice_board(notices, r, F.lit("2024-01-05")).collect()
        assert [tuple(x) for x in board] == [(1, 0, 1, *want)]


def test_every_text_is_rebuilt_from_its_index(spark, tables):
    """Also empty, blank and null texts, rows that share an id, and words beyond the 100,000th."""
    long = " ".join(["z"] + ["ab"] * 100_050 + ["end"])
    rows = [(1, ""), (2, "a  b\n\nb a c"), (3, None), (4, " \n "), (5, "one"), (5, "one two"), (5, "one"), (6, long)]
    d = tables(documents=(rows, "doc_id long, text string"))
    want = [(1, ""), (2, "a b b a c"), (3, None), (4, ""), (5, "one"), (5, "one"), (5, "one two"), (6, long)]
    assert sorted(map(tuple, plans.s13_inverted_index(spark, d).collect()), key=lambda r: (r[0], r[1] or "")) == want


def test_backfill_of_odd_texts_is_what_its_sql_says(spark, tables):
    """Empty texts aren't a paper's own, null ones wait, and entities and phrases of blocked pages are text like any other."""
    body = "wort wörter " * 30
    kinds = ["T{}. " + body, "", "T &amp; {}. <i>x</i> " + body, None, " \n ", "T{}. access denied " + body, "T{} \x0b\x1c. " + body]
    rows = [(i, None if (t := kinds[i % 7]) is None else t.format(i)) for i in range(700, 1500)]
    d = tables(documents=([(i, t, "src0", "de") for i, t in rows], "doc_id long, text string, source string, lang string"), labels=([(r[0], r[0] % 2) for r in rows[::3]], "doc_id long, quality int"))
    got = sorted(map(tuple, plans.j3_j4_backfill(spark, d).collect()))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(f"select id, abstract_source, attempt_one, attempt_two, n from ({plans.ORACLE_SQL['j3_j4_backfill']})").fetchall())
    assert len(want) == 800 and {r[1] for r in want} == {"own", "one", "two", ""} and got == want
