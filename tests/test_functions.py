"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import citations, dates, text


def one(spark, *cols, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    out = row.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()
    return out[0] if len(cols) == 1 else tuple(out)


@pytest.mark.parametrize(("raw", "key"), [("A: Nuclear-Physics!", "anuclearphysics"), ("Ｎｕｃｌｅａｒ １２ 核", "nuclear12核"), ("!!!", ""), (None, ""), ("Straße β", "strasseβ")])
def test_title_key(spark, raw, key):
    assert one(spark, text.title_key(F.col("t")), t=raw) == key


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.col("t")), t=" a <b>x</b>&amp;  y\n") == "a x & y"
    assert one(spark, text.clean_text(F.col("t")), t=None) == ""


def test_stable_id(spark):
    import hashlib

    assert one(spark, text.stable_id(F.lit(" DOI"), F.col("t"), F.lit("")), t="10.1/A ") == hashlib.sha1(b"doi|10.1/a").hexdigest()[:16]


@pytest.mark.parametrize(
    ("raw", "day"),
    [("2026年8月10日", "2026-08-10"), ("2026-01-02 截止 2026-03-04", "2026-03-04"), ("2026年13月1日", ""), ("Mon, 01 Jun 2026 10:00:00 GMT", "2026-06-01"), ("", ""), (None, "")],
)
def test_notice_date(spark, raw, day):
    assert one(spark, dates.notice_date(F.col("t")), t=raw) == day


@pytest.mark.parametrize("raw", ["申请截止：2026年9月9日", "Deadline: September 9th, 2026", "must be received by 9 September 2026", "Applications are due 2026-09-09"])
def test_deadline(spark, raw):
    assert one(spark, dates.deadline(F.col("t")), t=raw) == "2026-09-09"


def test_english_and_url_dates(spark):
    assert one(spark, dates.english_date(F.col("t")), t="on 1 June 2026.") == "2026-06-01"
    assert one(spark, dates.english_date(F.col("t")), t="June 31, 2026") == ""
    assert one(spark, dates.url_date(F.col("t")), t="https://x.org/a/t20260102_9.html") == "2026-01-02"


def test_licences(spark):
    by, zero, nc = "https://creativecommons.org/licenses/by/4.0/", "http://creativecommons.org/publicdomain/zero/1.0/", "https://creativecommons.org/licenses/by-nc-nd/4.0/"
    assert [one(spark, text.reusable_license(F.col("t")), t=x) for x in (by, zero, nc, "")] == [True, True, False, False]
    assert one(spark, text.license_label(F.col("t")), t=by) == "CC BY 4.0"


def test_identifiers(spark):
    assert one(spark, text.arxiv_id(F.col("t")), t="https://arxiv.org/pdf/2401.00001v2.pdf?x") == "2401.00001v2"
    assert one(spark, text.clean_arxiv_abstract(F.col("t")), t="arXiv:1 Announce Type: new Abstract: Text") == "Text"
    assert one(spark, text.library_doi(F.col("t")), t="doi: 10.1/X. ") == "10.1/x"
    assert one(spark, text.page_count(F.col("t")), t="12–15") == "4"
    assert one(spark, text.page_count(F.col("t")), t="15-12") == ""


def test_nuclides_and_keywords(spark):
    got = one(spark, text.nuclides(F.col("t")), t="We saw 12C, U-238 and 12C again")
    assert got == ["12C", "238U"]
    assert one(spark, text.ci_unique(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit("B")))) == ["A", "B"]


def test_captions(spark):
    risky = ["Reprinted with permission", "Image credit: X", "from Ref. [3]", "Courtesy of Y", "© Z", "Source: W"]
    assert all(one(spark, citations.caption_risk(F.col("t")), t=x) for x in risky)
    assert not one(spark, citations.caption_risk(F.col("t")), t="Measured cross section")
    score, reasons = one(spark, *citations.figure_rank(F.col("t"), F.lit(2)), t="Measured spectrum")
    assert score == 6 + 18 + 17 and len(reasons) == 2


def test_tex_and_author(spark):
    assert citations.decode_tex(r"M\"uller \'{e} \ss \o") == "Müller é ß ø"
    assert one(spark, text.split_author(F.lit("Doe, Jane, Jr"))).asDict() == {"last": "Doe", "first": "Jane, Jr"}


def test_glossary_longest_first(spark):
    assert one(spark, text.apply_glossary(F.col("t"), [("beam", "B"), ("beam time", "BT$1")]), t="Beam time, beam") == "BT$1, B"
