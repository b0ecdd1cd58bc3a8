"""Steps whose memory, disk or time once grew faster than their tables."""

import base64
import gzip
import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import classify, merge, substrings
from corpusloom.plans import queries as plans
from corpusloom.sources import feeds, html_pages


def test_rows_far_down_a_queue_are_found_by_range(spark, monkeypatch):
    monkeypatch.setattr(merge, "NEAR_ROWS", 7)
    rows = spark.range(100).select(F.pmod(F.col("id") * 37, F.lit(10)).alias("a"), "id")
    order = sorted([(r.a, r.id) for r in rows.collect()], key=lambda r: (-r[0], r[1]))
    for place in (1, 7, 8, 50, 100):
        assert tuple(merge.row_at(rows, [F.desc("a"), F.asc("id")], place)) == order[place - 1]
    assert merge.row_at(rows, [F.desc("a"), F.asc("id")], 101) is None


def test_a_queue_without_end_holds_no_room_for_its_limit(spark):
    never = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("checked_at"))
    papers = spark.range(3).select("id", F.concat(F.lit("10.1/"), "id").alias("doi"), F.lit("").alias("title"), F.lit("").alias("abstract"), F.lit("2020-01-01").alias("published"), F.lit(1).alias("importance"), never.alias("checked"))
    table = papers.where("id > 0").select("doi", F.lit("A text that is long enough to count as an abstract of its paper.").alias("abstract"), F.col("id").alias("seq"))
    out = merge.backfill_abstracts(papers, [{"name": "one", "table": table, "limit": 2_000_000_000, "checked": "checked"}], F.lit("2026-01-01").cast("timestamp"))
    assert sorted((r.id, r.attempt_one) for r in out.collect()) == [(0, "not_found"), (1, "enriched"), (2, "enriched")]


def test_headings_decode_ended_references_once(spark, tmp_path):
    pages = [(1, "https://e.org/", "<h1>a&amp;&amp;&amp</h1>"), (2, "https://e.org/", "<h1>b &amp;lt; &ampx; &copy &#33; &eacute;</h1>"), (3, "https://e.org/", "<h1>c &lt;i&gt; & d</h1>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["h1"] for r in plans.s7_page_metadata(spark, str(tmp_path)).collect()}
    assert got == {1: "a&&&amp", 2: "b &lt; &ampx; &copy ! é", 3: "c <i> & d"}


def test_many_terms_of_all_lengths_are_found_without_trigrams(spark, monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aбb𝒳 ") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    terms = sorted({t[i : i + n] for t in texts for n in (1, 2, 3, 5, 6, 8, 9, 14) if len(t) > n for i in (0, len(t) // 2) if len(t[i : i + n]) == n} | {"absent", "abababababab"})
    monkeypatch.setattr(substrings, "AT_ONCE", 25)
    hay, words = spark.createDataFrame(list(enumerate(texts)), "id int, hay string"), spark.createDataFrame([(t,) for t in terms], "word string")
    found = substrings.contained_terms(hay, words)
    assert sorted(map(tuple, found.collect())) == sorted((i, t) for i, x in enumerate(texts) for t in terms if t in x)
    # what waits is broadcast, and texts aren't shuffled
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hay" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_inverted_index_sorts_its_words_once(spark):
    words = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.struct(F.concat(F.lit("w"), i.cast("string")), F.array(2999 - i))).alias("e"))
    x = words.select(feeds.abstract_from_inverted_index(F.map_from_entries("e")).alias("t"))
    assert x.first()[0] == " ".join(f"w{2999 - i}" for i in range(3000))
    assert x._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 1


def test_pages_are_parsed_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(html_pages, "PAGES", 2)
    pages = spark.createDataFrame([(i, "https://e.org/", f'<a href="/{i}">page {i}</a>' * (i % 3)) for i in range(7)] + [(7, None, None)], "page_id long, url string, html string").coalesce(1)
    got = sorted((r.page_id, r.pos, r.url) for r in html_pages.html_links(pages).collect())
    assert got == [(i, n, f"https://e.org/{i}") for i in range(7) for n in range(i % 3)]


def test_a_text_is_read_once_for_all_terms(spark):
    terms = ["beam", "beam loss", "beam loss monitor", "ion", "ion-trap", "§ 2"]
    texts = ["The beam loss  monitor", "ion-trap; § 2", "", None, "beams"]
    x = spark.createDataFrame([(t,) for t in texts], "t string").select(classify.term_hits(F.lower("t"), terms).alias("h"))
    assert [r.h or [] for r in x.collect()] == [terms[:3], terms[3:], [], [], []]
    assert x._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_snapshots_that_are_not_packed_do_not_go_through_python(spark, monkeypatch):
    mark = lambda raw, encoding: f"<!-- v1 --><!-- x-encoding:{encoding} -->```text\n{base64.b64encode(raw).decode()}\n```"
    good = b'{"personal":{"notes":{"a":"\xc3\xa9"}}}'
    rows = [(1, "owner", "sync", mark(good, "base64")), (2, "owner", "sync", mark(b'{"personal":{"notes":{"a":"\xff"}}}', "base64")), (3, "owner", "sync", mark(gzip.compress(b"\xff"), "gzip-base64"))]
    x = feeds.state_from_issues(spark.createDataFrame(rows, "seq long, login string, title string, body string"), "owner", "sync", "<!-- v1 -->")
    assert [r["state"]["personal"]["notes"] for r in x.collect()] == [{"a": "é"}]
    sent = re.findall(r"_inflate\((.*?)\)#", x._jdf.queryExecution().optimizedPlan().toString())
    assert sent and all("gzip-base64" in s or "_e" in s for s in sent), sent
