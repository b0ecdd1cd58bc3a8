"""Event pages as notice details, category names, and what an export takes and writes."""

import json

from pyspark.sql import functions as F

from corpusloom.operators import joins
from corpusloom.operators.merge import backfill_abstracts
from corpusloom.sources import feeds, sinks


def test_event_details(spark):
    export = {"results": [{"title": "School", "description": "<p>On <b>nuclei</b></p><script>x</script> &amp; more", "startDate": {"date": "2026-05-01"}, "endDate": {"date": "2026-05-04"}, "creationDate": {"date": "2026-01-02"}}, {"title": "second"}]}
    exports = [("https://indico.a.org/export/event/12.json", json.dumps(export)), ("https://indico.a.org/event/12/", json.dumps(export)), ("https://indico.b.org/export/event/5.json", "{}"), ("https://indico.b.org/export/event/6.json", "no json"), (None, None)]
    notices = [(1, "https://Indico.a.org/event/12/overview"), (2, "https://indico.a.org/event/13/"), (3, "https://a.org/event/12/"), (4, "https://indico.b.org/event/5"), (5, None), (6, "https://indico.b.org/event/6/")]
    got = feeds.event_details(spark.createDataFrame(notices, "id long, url string"), spark.createDataFrame(exports, "url string, json string")).collect()
    assert [r.id for r in got] == [1]
    assert got[0].asDict() == {
        "id": 1, "content": "On nuclei & more", "summary": "2026-05-01 — 2026-05-04 On nuclei & more", "published": "2026-01-02", "event_start": "2026-05-01",
        "event_end": "2026-05-04", "deadline": "", "heading": "School",
    }


def test_category_names(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id long, categories array<string>")
    assert [r.category_names for r in joins.category_names(df, {"a": "Alpha"}).orderBy("id").collect()] == [["Alpha", "b"], [], None]
    assert joins.category_names(df, {}).first().category_names == ["a", "b"]


def test_export_of_a_selection(spark, folder):
    df = spark.createDataFrame([(f"p{i}", f"T{i}", ["A, B"], "S", f"2024-01-0{i}", "", "", "", i) for i in range(1, 6)], "id string, title string, authors array<string>, source string, published string, doi string, url string, abstract string, importance long")
    favorites = spark.createDataFrame([("p2",), ("p4",), ("p4",), ("other",)], "id string")
    assert {r.id for r in sinks.export_selection(df, favorites).collect()} == {"p2", "p4"}
    assert sinks.export_selection(df, favorites.where("id = 'other'")).count() == 5
    sinks.write_ris(sinks.export_selection(df, favorites), f"{folder}/ris")
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/ris").collect())
    assert text.count("TY  - ") == 2 and text.index("T4") < text.index("T2") and text.rstrip().endswith("ER  -")


def test_backfill_takes_limits_in_order_and_fills_identifiers(spark):
    body = lambda w: f"An abstract of {w} that is long enough to be taken for one by the rule of fifty characters."
    papers = [(i, f"10.1/{i % 4}" if i != 5 else "", f"title {i}", "" if i != 6 else "own", f"2024-01-0{1 + i % 3}", i % 2, "", "", "") for i in range(8)] + [(None, "10.1/0", "no id", "", "2024-02-01", 9, "", "", "")]
    checked = "struct<status:string,checked_at:string>"
    df = spark.createDataFrame(papers, "id long, doi string, title string, abstract string, published string, importance long, abstract_source string, arxiv_id string, pdf_url string").withColumn("checked", F.lit(None).cast(checked))
    one = spark.createDataFrame([("https://doi.org/10.1/0", body("old"), 1), ("10.1/0", body("new"), 2), ("10.1/1", "short", 1), ("10.9/none", body("x"), 1), (None, body("x"), 1)], "doi string, abstract string, seq long")
    two = spark.createDataFrame([("10.1/1", "  short <b>text</b>", 1, "2401.1"), ("10.1/0", body("two"), 1, "2401.0"), ("10.1/2", "", 1, "2401.2")], "doi string, abstract string, seq long, arxiv_id string")
    sources = [{"name": "one", "table": one, "limit": 3, "checked": "checked"}, {"name": "two", "table": two, "limit": 100, "checked": "checked", "validate": False}]
    rows = backfill_abstracts(df, sources, F.lit("2026-01-01").cast("timestamp")).collect()
    got = {r.id: r for r in rows}
    due = sorted([p for p in papers if p[1] and not p[3] and p[0] is not None], key=lambda p: p[0])
    first = sorted(sorted(due, key=lambda p: (p[4], p[5]), reverse=True), key=lambda p: ([-ord(c) for c in p[4]], -p[5], p[0]))[:3]
    for p in due:
        r, looked = got[p[0]], p in first
        took_one = looked and p[1] == "10.1/0"
        assert r.attempt_one == ("enriched" if took_one else "not_found" if looked else "deferred")
        took_two = not took_one and p[1] in ("10.1/0", "10.1/1")
        assert r.attempt_two == (None if took_one else "enriched" if took_two else "not_found")
        assert r.abstract == (body("new") if took_one else {"10.1/0": body("two"), "10.1/1": "short text"}[p[1]] if took_two else "")
        assert (r.arxiv_id, r.pdf_url) == (({"10.1/0": "2401.0", "10.1/1": "2401.1"}[p[1]],) * 1 + (f"https://arxiv.org/pdf/{ {'10.1/0': '2401.0', '10.1/1': '2401.1'}[p[1]] }",) if took_two else ("", ""))
    assert got[6].abstract == "own" and got[6].attempt_one is None and got[5].attempt_one is None and len(rows) == len(papers)
