"""Citation texts: RIS, BibTeX and GB/T 7714, and the figures' caption rules."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import empty_if_null, first_filled, host

#: Combining marks of TeX accents, and letters of their own.
ACCENTS = {'"': "\u0308", "'": "\u0301", "`": "\u0300", "^": "\u0302", "~": "\u0303", "=": "\u0304", "u": "\u0306", ".": "\u0307", "v": "\u030c", "H": "\u030b", "c": "\u0327", "k": "\u0328", "r": "\u030a", "b": "\u0331"}
LETTERS = {"ss": "ß", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł"}
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

_ACCENT = re.compile(r"\\([" + "".join(map(re.escape, ACCENTS)) + r"])\{?([A-Za-z])\}?")
_LETTER = re.compile(r"\\(ss|[oOlL])\b")


def decode_tex(text: str) -> str:
    text = _ACCENT.sub(lambda m: unicodedata.normalize("NFC", m[2] + ACCENTS[m[1]]), text)
    return _LETTER.sub(lambda m: LETTERS[m[1]], text)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _decode_all(s: pd.Series) -> pd.Series:
    return s.map(lambda names: None if names is None else [decode_tex(n) for n in names if n is not None])


def plain_authors(authors: Column) -> Column:
    """TeX accents as letters; the helper only works on lists with a backslash."""
    tex = F.exists(authors, lambda a: F.contains(a, F.lit("\\")))
    return F.when(tex, _decode_all(F.when(tex, authors))).otherwise(authors)


def _if(condition: Column, *parts) -> Column:
    return F.when(condition, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _filled(c: Column) -> Column:
    return empty_if_null(c) != ""


def ris(title, authors, source, published, doi, url, abstract) -> Column:
    """The lines of a RIS entry."""
    lines = F.array(
        F.lit("TY  - JOUR"),
        F.concat(F.lit("TI  - "), empty_if_null(title)),
        F.when(F.size(authors) > 0, F.array_join(F.transform(authors, lambda a: F.concat(F.lit("AU  - "), a)), "\n")),
        _if(_filled(source), "JO  - ", source),
        _if(_filled(published), "PY  - ", F.substring(published, 1, 4), "\nDA  - ", published),
        _if(_filled(doi), "DO  - ", doi),
        _if(_filled(url), "UR  - ", url),
        _if(_filled(abstract), "AB  - ", F.regexp_replace(abstract, r"\s+", " ")),
        F.lit("ER  - "),
    )
    return F.array_join(F.array_compact(lines), "\n")


def citation_key(doi, authors, source, published, title, nobody: str = "Anonymous") -> Column:
    """What follows the DOI's last slash; without a DOI the last word of the first author (the source, else ``nobody``), the year and the title's first word."""
    suffix = F.regexp_replace(F.substring_index(empty_if_null(doi), "/", -1), r"[^\w.:-]", "")
    parts = (
        F.regexp_extract(first_filled(F.get(authors, 0), source, F.lit(nobody)), r"(\S+)\s*$", 1),
        F.coalesce(F.nullif(F.substring(published, 1, 4), F.lit("")), F.lit("nd")),
        F.coalesce(F.nullif(F.regexp_extract(title, "[A-Za-z0-9]+", 0), F.lit("")), F.lit("paper")),
    )
    return first_filled(suffix, F.regexp_replace(F.array_join(F.array(*parts), ""), "[^A-Za-z0-9]", ""))


def is_preprint(source_type, arxiv_id, doi) -> Column:
    return (empty_if_null(source_type) == "preprint") | (_filled(arxiv_id) & ~_filled(doi))


def bibtex(r) -> Column:
    """a BibTeX entry of a record; ``r`` gives a column by name, an empty text for absent fields."""
    pre = is_preprint(r("source_type"), r("arxiv_id"), r("doi"))
    authors = F.when(F.size(r("citation_authors")) > 0, r("citation_authors")).otherwise(r("authors"))
    journal = first_filled(r("journal_abbrev"), r("source"))
    month = F.coalesce(F.get(F.array(*map(F.lit, MONTHS)), F.coalesce(F.substring(empty_if_null(r("published")), 6, 2).try_cast("int"), F.lit(0)) - 1), F.lit(""))
    publisher = F.trim(F.regexp_replace(empty_if_null(r("publisher")), r"\s*\(APS\)\s*$", ""))
    url = first_filled(r("publisher_url"), r("url"))
    arxiv = r"(?i)^arxiv\s+"
    field = lambda name, on, value: _if(on & _filled(value), f"  {name} = {{", value, "}")
    fields = F.array(
        _if(F.lit(True), "  title = {", F.trim(F.regexp_replace(empty_if_null(r("title")), r"\s+", " ")), "}"),
        _if(F.size(authors) > 0, "  author = {", F.array_join(authors, " and "), "}"),
        field("journal", ~pre, journal),
        *[field(f, ~pre, r(f)) for f in ("volume", "issue", "pages", "numpages")],
        field("year", F.lit(True), F.substring(empty_if_null(r("published")), 1, 4)),
        field("month", ~pre, month),
        field("publisher", ~pre, publisher),
        field("doi", F.lit(True), r("doi")),
        field("eprint", pre, r("arxiv_id")),
        F.when(pre & _filled(r("arxiv_id")), F.lit("  archivePrefix = {arXiv}")),
        _if(pre & empty_if_null(r("source")).rlike(arxiv), "  primaryClass = {", F.regexp_replace(empty_if_null(r("source")), arxiv, ""), "}"),
        field("url", F.lit(True), url),
    )
    head = F.concat(F.when(pre, "@misc{").otherwise("@article{"), citation_key(r("doi"), r("authors"), r("source"), r("published"), r("title")), F.lit(",\n"))
    return F.concat(head, F.array_join(F.array_compact(fields), ",\n"), F.lit("\n}"))


def gbt7714(r, as_of: Column) -> Column:
    """a GB/T 7714 reference with ``as_of`` as the day of access."""
    names = plain_authors(r("authors"))
    first = F.slice(names, 1, 3)
    more = F.when(F.exists(first, lambda a: a.rlike("[㐀-鿿]")), ", 等").otherwise(", et al")
    authors = F.when(F.size(names) > 0, F.concat(F.array_join(first, ", "), F.when(F.size(names) > 3, more).otherwise(""))).otherwise(first_filled(r("source"), F.lit("责任者不详")))
    title = F.trim(F.regexp_replace(first_filled(r("title"), F.lit("题名不详")), r"\s+", " "))
    published = F.substring(empty_if_null(r("published")), 1, 10)
    year = first_filled(F.substring(published, 1, 4), F.lit("日期不详"))
    url = F.when(_filled(r("doi")), F.concat(F.lit("https://doi.org/"), r("doi"))).otherwise(first_filled(r("url"), F.lit("获取地址不详")))
    platform = F.when(empty_if_null(r("source")).rlike(r"(?i)^arxiv\b"), F.lit("arXiv")).otherwise(first_filled(r("source"), F.lit("预印本平台")))
    online = F.concat(authors, F.lit(". "), title, F.lit("[PP/OL]. "), platform, F.when(published != "", F.concat(F.lit("("), published, F.lit(")"))).otherwise(""), F.lit("["), as_of, F.lit("]. "), url, F.when(_filled(r("arxiv_id")), F.concat(F.lit(". arXiv:"), r("arxiv_id"))).otherwise(""), F.lit("."))
    issue = F.concat(empty_if_null(r("volume")), F.when(_filled(r("issue")), F.concat(F.lit("("), r("issue"), F.lit(")"))).otherwise(""))
    place = F.concat(F.array_join(F.array_compact(F.array(year, F.nullif(issue, F.lit("")))), ", "), F.when(_filled(r("pages")), F.concat(F.lit(": "), r("pages"))).otherwise(""))
    journal = F.concat(authors, F.lit(". "), title, F.lit("[J/OL]. "), first_filled(r("journal_abbrev"), r("source"), F.lit("刊名不详")), F.lit(", "), place, F.lit("["), as_of, F.lit("]. "), url, F.lit("."))
    return F.when(is_preprint(r("source_type"), r("arxiv_id"), r("doi")), online).otherwise(journal)


#: Hosts of figures, and signs of figures that others own.
FIGURE_HOSTS = ("arxiv.org", "export.arxiv.org")
CAPTION_RISKS = (
    r"\breprinted\s+with\s+permission\b",
    r"\b(?:reproduced|reprinted|adapted|modified)\b",
    r"\b(?:image|photo|figure)?\s*credits?\s*:",
    r"\b(?:image|photo)\s+(?:credits?|courtesy|by)\b",
    r"\bimages?\s*:",
    r"\b(?:from|after)\s+ref(?:erence)?\.?\s*(?:\[|\d)",
    r"\btaken\s+from\b",
    r"\bcourtesy\b",
    r"\bcopyright\b",
    r"\bpermission\b",
    r"\bsource\s*:",
    "©",
)
#: Words of a caption, what they add to its rank, and the reason shown.
FIGURE_GROUPS = (
    (("main result", "result", "measured", "measurement", "data", "comparison", "constraint"), 18, "主要结果或数据比较"),
    (("spectrum", "cross section", "angular distribution", "excitation function", "yield", "correlation"), 17, "关键实验观测量"),
    (("level scheme", "energy level", "decay scheme", "half-life", "transition probability", "b(e2)"), 17, "核结构或衰变关键图"),
    (("detector", "efficiency", "resolution", "calibration", "setup", "apparatus", "data acquisition"), 13, "探测器、装置或性能"),
    (("theory", "model", "calculation", "prediction", "fit"), 10, "理论、模型或拟合比较"),
)
FIRST_FIGURE = "论文前部主图"


def caption_risk(c: Column) -> Column:
    """F14."""
    return empty_if_null(c).rlike("(?i)" + "|".join(CAPTION_RISKS))


def clean_figures(figures: Column, keep: int = 2) -> Column:
    """C11: at most ``keep`` figures with a caption, on an allowed https host, without signs of third parties."""

    def ok(f: Column) -> Column:
        return _filled(f["caption"]) & f["url"].rlike("(?i)^https://") & host(f["url"]).isin(*FIGURE_HOSTS) & ~caption_risk(f["caption"])

    return F.slice(F.filter(figures, ok), 1, keep)


def figure_rank(caption: Column, index: Column) -> tuple[Column, Column]:
    """score and reasons."""
    low = F.lower(empty_if_null(caption))
    score = F.greatest(F.lit(0), F.lit(8) - index)
    reasons = []
    for terms, bonus, reason in FIGURE_GROUPS:
        hit = low.rlike("|".join(re.escape(t) for t in terms))
        score = score + F.when(hit, bonus).otherwise(0)
        reasons.append(F.when(hit, F.lit(reason)))
    found = F.array_compact(F.array(*reasons))
    return score, F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(FIRST_FIGURE)))
