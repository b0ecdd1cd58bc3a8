"""Scalar functions of dates: everything in and out as ISO text, with an empty text for unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_text, empty_if_null, first_filled, let

#: Month names and date forms of notices.
_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_SHORT = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_YMD = r"20\d{2}\s*[年./-]\s*\d{1,2}\s*[月./-]\s*\d{1,2}\s*日?"
_DMY = rf"\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{_MONTHS})\s+20\d{{2}}"
_MDY = rf"(?:{_MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+20\d{{2}}"


def _ymd(y: Column, m: Column, d: Column) -> Column:
    """ISO text of year, month and day as texts, empty if there is no such day."""
    iso = F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))
    return let(F.when(y != "", iso), lambda s: F.when(F.try_to_date(s, "yyyy-MM-dd").isNotNull(), s).otherwise(F.lit("")))


def _month_number(name: Column) -> Column:
    n = F.array_position(F.array(*map(F.lit, _SHORT)), F.lower(F.substring(name, 1, 3)))
    return F.when(n > 0, n.cast("string")).otherwise("")


def date_parts(parts: Column) -> Column:
    """``[year, month?, day?]`` with month and day 1 by default."""
    pad = lambda i, n: F.lpad(F.coalesce(F.get(parts, i), F.lit(1)).cast("string"), n, "0")
    return F.when(F.get(parts, 0).isNotNull(), F.concat(pad(0, 4), F.lit("-"), pad(1, 2), F.lit("-"), pad(2, 2))).otherwise("")


def iso_date(c: Column) -> Column:
    """mail dates, then ``yyyy-m-d`` anywhere (as written, valid or not), then an ISO prefix."""
    return let(F.trim(empty_if_null(c)), _iso_date)


def _iso_date(t: Column) -> Column:
    # fixed values: the forms of a date that feeds use
    mail = r"(?i)^(?:[a-z]{3},\s*)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\s+\d{1,2}:\d{2}"
    by_mail = _ymd(F.regexp_extract(t, mail, 3), _month_number(F.regexp_extract(t, mail, 2)), F.regexp_extract(t, mail, 1))
    number = r"(20\d{2}|19\d{2})[-/.](\d{1,2})[-/.](\d{1,2})"
    y, m, d = (F.regexp_extract(t, number, i) for i in (1, 2, 3))
    by_number = F.when(y != "", F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0"))).otherwise("")
    return first_filled(by_mail, by_number, F.regexp_extract(t, r"^\d{4}-\d{2}-\d{2}", 0))


def notice_date(c: Column) -> Column:
    """the last date of the text, empty if it isn't a day of the calendar; without any, as ``iso_date``."""
    return let(empty_if_null(c), _notice_date)


def _notice_date(t: Column) -> Column:
    # fixed value: the form of a date in notices
    pattern = r"(?<!\d)(20\d{2})\s*[年./-]\s*(\d{1,2})\s*[月./-]\s*(\d{1,2})"
    last = lambda i: F.try_element_at(F.regexp_extract_all(t, F.lit(pattern), i), F.lit(-1))
    return F.when(last(1).isNotNull(), _ymd(last(1), last(2), last(3))).otherwise(_iso_date(F.trim(t)))


def english_date(c: Column) -> Column:
    """the first ``1 June 2026`` or ``June 1, 2026``."""
    # fixed values: the two English forms of a date, and the ending of its number
    t = F.regexp_replace(F.regexp_extract(empty_if_null(c), rf"(?i)\b(\d{{1,2}}\s+(?:{_MONTHS})\s+20\d{{2}}|(?:{_MONTHS})\s+\d{{1,2}},?\s+20\d{{2}})\b", 1), r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
    return let(t, _english)


def _english(t: Column) -> Column:
    year = F.regexp_extract(t, r"(20\d{2})\s*$", 1)
    day = F.regexp_extract(t, r"(?i)(?:^|[a-z]\s+)(\d{1,2})(?=[\s,])", 1)
    return _ymd(year, _month_number(F.regexp_extract(t, r"([A-Za-z]{3,})", 1)), day)


def url_date(c: Column) -> Column:
    """``t20260102`` or ``20260102`` between separators of a url."""
    # fixed value: the form of a date in urls
    pattern = r"(?i)(?:^|[/_-])t?(20\d{2})(\d{2})(\d{2})(?:[_/.-]|$)"
    return _ymd(*[F.regexp_extract(empty_if_null(c), pattern, i) for i in (1, 2, 3)])


#: Fixed value: the forms of a date that deadlines have.
_WHEN = rf"({_MDY}|{_DMY}|20\d{{2}}[-/.]\d{{1,2}}[-/.]\d{{1,2}})"
#: Ordered patterns of deadlines.
DEADLINES = (
    rf"(?i)(?:截止(?:日期|时间)?|申请截止|申报截止|报名截止|受理时间[^。；;]{{0,24}}?(?:至|到))\s*[:：为]?\s*({_YMD})",
    rf"(?i)(?:申请|申报|受理|报名)时间[^。；;]{{0,80}}?(?:至|到|[-–—])\s*({_YMD})",
    rf"(?i)(?:deadline|closes?|due\s+date|applications?\s+(?:are\s+)?due|proposal\s+submission\s+deadline)\s*(?:is|on|:)?\s*{_WHEN}",
    rf"(?i)(?:submitted|received|apply)[^.]{{0,100}}?(?:by|before|until)\s*(?:\d{{1,2}}(?::\d{{2}})?\s*(?:a\.?m\.?|p\.?m\.?)?\s*[A-Z]{{2,5}}\s*(?:on)?)?\s*({_DMY}|{_MDY})",
)


def deadline(c: Column) -> Column:
    """the first of the ordered patterns whose date is a day of the calendar."""

    def by(t: Column, pattern: str) -> Column:
        part = F.regexp_replace(F.regexp_extract(t, pattern, 1), r"(?i)(\d)(?:st|nd|rd|th)\b", "$1")
        return let(part, lambda s: F.when(s != "", first_filled(_notice_date(s), _english(s))).otherwise(""))

    return let(clean_text(c), lambda t: first_filled(*[by(t, p) for p in DEADLINES]))


def local_day(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """the day in a fixed zone of an instant that is given in UTC."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd")


def days_left(day: Column, as_of: Column) -> Column:
    return F.datediff(F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd"), F.to_date(as_of))


def deadline_state(day: Column, as_of: Column) -> Column:
    """unknown, closed, soon (within 14 days) or open."""
    n = days_left(F.nullif(empty_if_null(day), F.lit("")), as_of)
    return F.when(n.isNull(), "unknown").when(n < 0, "closed").when(n <= 14, "soon").otherwise("open")


def month_bounds(month: Column) -> tuple[Column, Column]:
    """first and last day of a ``yyyy-MM`` month."""
    first = F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")
    return first.cast("string"), F.last_day(first).cast("string")


def next_month(month: Column) -> Column:
    first = F.try_to_date(F.concat(month, F.lit("-01")), "yyyy-MM-dd")
    return F.date_format(F.add_months(first, 1), "yyyy-MM")


def month_range(first: Column, last: Column) -> Column:
    """the months from ``first`` to ``last``, both ``yyyy-MM``."""
    a, b = (F.to_date(F.concat(x, F.lit("-01"))) for x in (first, last))
    days = F.when(b >= a, F.sequence(a, b, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return F.transform(days, lambda d: F.date_format(d, "yyyy-MM"))
