"""Scalar functions of text: cleaning, keys, identifiers, licences, display forms. All map columns to columns."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"


@F.pandas_udf(T.StringType())
def _unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.StringType())
def _nfkc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


@F.pandas_udf(T.StringType())
def _nfkc_lower(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).lower())


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def is_ascii(c: Column) -> Column:
    return F.length(c) == F.octet_length(c)


def any_of(c: Column, terms) -> Column:
    """Whether any of the literal terms is in ``c``."""
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(c, F.lit(t))
    return out


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that it uses more than once and that is computed once: the plan holds the value one time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(empty_if_null(c), SPACE, " "))


def unescape(c: Column) -> Column:
    """HTML entities to characters, by a vectorised helper that only sees texts with an ampersand.

    The helper is evaluated for every row that reaches it, so the choice is made on its input.
    """
    return F.when(F.contains(c, F.lit("&")), _unescape(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def clean_text(c: Column, entities: bool = True) -> Column:
    """tags become spaces, entities characters, white space single spaces."""
    plain = F.regexp_replace(empty_if_null(c), "<[^>]+>", " ")
    return collapse(unescape(plain) if entities else plain)


def fold(c: Column) -> Column:
    """NFKC and case folding; plain ``lower`` where the text is ASCII."""
    return F.when(is_ascii(c), F.lower(c)).otherwise(_nfkc_fold(F.when(~is_ascii(c), c)))


def nfkc_lower(c: Column) -> Column:
    return F.when(is_ascii(c), F.lower(c)).otherwise(_nfkc_lower(F.when(~is_ascii(c), c)))


def title_key(c: Column) -> Column:
    """letters and digits of the folded title, at most 220; empty for titles without any."""
    return F.substring(F.regexp_replace(fold(empty_if_null(c)), r"[^\p{L}\p{N}]", ""), 1, 220)


def stable_id(*parts: Column) -> Column:
    """16 hex digits of the SHA-1 of the non-empty parts, trimmed and lower-cased."""
    kept = F.array_compact(F.array(*[F.nullif(F.coalesce(p, F.lit("")), F.lit("")) for p in parts]))
    return F.substring(F.sha1(F.array_join(F.transform(kept, lambda p: F.lower(F.trim(p))), "|")), 1, 16)


def arxiv_id(url: Column) -> Column:
    """F8."""
    return F.regexp_replace(F.regexp_extract(empty_if_null(url), r"(?i)arxiv\.org/(?:abs|pdf)/([^?#/]+)", 1), r"\.pdf$", "")


def clean_arxiv_abstract(c: Column) -> Column:
    """F8: without the feed's announcement prefix."""
    return F.trim(F.regexp_replace(clean_text(c), r"(?i)^arxiv:\S+\s+announce\s+type:\s*\S+\s+abstract:\s*", ""))


def doi(c: Column) -> Column:
    """without resolver prefix, lower-cased."""
    return F.trim(F.lower(F.regexp_replace(F.trim(empty_if_null(c)), r"(?i)^https?://(?:dx\.)?doi\.org/", "")))


def library_doi(c: Column) -> Column:
    """F9, as libraries hold it: also without ``doi:`` and trailing full stops and spaces."""
    bare = F.regexp_replace(F.trim(empty_if_null(c)), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")
    return F.lower(F.regexp_replace(bare, r"[ .]+$", ""))


def history_key(doi_col: Column, id_col: Column) -> Column:
    d = F.trim(F.lower(empty_if_null(doi_col)))
    return F.when(d != "", F.concat(F.lit("doi:"), d)).otherwise(F.concat(F.lit("id:"), empty_if_null(id_col.cast("string"))))


def reusable_license(c: Column) -> Column:
    """links to CC0, or to CC BY without further conditions."""
    return F.lower(empty_if_null(c)).rlike(r"creativecommons\.org/(?:publicdomain/zero/|licenses/by/\d)")


def license_label(c: Column, unknown: str = "授权未核实") -> Column:
    """the label of a reusable licence with its version, else ``unknown``."""
    t = F.lower(empty_if_null(c))
    version = F.regexp_extract(t, r"licenses/by/(\d(?:\.\d)?)", 1)
    return F.when(F.contains(t, F.lit("publicdomain/zero")), F.lit("CC0")).when(version != "", F.concat(F.lit("CC BY "), version)).otherwise(F.lit(unknown))


def page_count(c: Column) -> Column:
    """only of a plain range of numbers that doesn't run backwards."""
    pattern = r"^\s*(\d+)\s*[-–—]\s*(\d+)\s*$"
    a, b = (F.regexp_extract(empty_if_null(c), pattern, i).try_cast("bigint") for i in (1, 2))
    return F.when(b >= a, (b - a + 1).cast("string")).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def host_allowed(url: Column, exact: list[str], suffixes: list[str]) -> Column:
    """F12."""
    h = host(url)
    out = h.isin(exact) if exact else F.lit(False)
    for s in suffixes:
        out = out | h.endswith(s)
    return out & url.rlike("^https?://")


def search_text(*parts: Column) -> Column:
    """F16: all parts in one folded line."""
    return collapse(fold(F.concat_ws(" ", *[empty_if_null(p) for p in parts])))


def clip(c: Column, n: int) -> Column:
    """F17."""
    t = collapse(c)
    return F.when(F.length(t) > n, F.concat(F.rtrim(F.substring(t, 1, max(1, n - 1))), F.lit("…"))).otherwise(t)


def compact(c: Column, n: int) -> Column:
    """F17, the short variant: one line, cut with an ellipsis after ``n`` characters."""
    t = collapse(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("…"))).otherwise(t)


def has_cjk(c: Column) -> Column:
    return empty_if_null(c).rlike("[㐀-鿿]")


BLOCKED = ("enable javascript", "access denied", "just a moment", "captcha", "checking your browser")


def shown_body(body: Column, placeholder: str) -> Column:
    """texts of pages that blocked the reader, and empty ones, give the placeholder."""
    t = collapse(body)
    return F.when((t == "") | any_of(F.lower(t), BLOCKED), F.lit(placeholder)).otherwise(t)


def ci_unique(words: Column, limit: int | None = None) -> Column:
    """trimmed, non-empty, without later repeats in other spelling; arrays that are null are empty."""
    w = F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(w, lambda x: F.lower(x))
    out = F.filter(w, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)
    return F.slice(out, 1, limit) if limit else out


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters. Every text that holds another has all of its trigrams."""
    return F.array_distinct(F.regexp_extract_all(empty_if_null(c), F.lit("(?s)(?=(...))"), F.lit(1)))


def literal_pattern(c: Column) -> Column:
    """A pattern that matches just this text."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def apply_glossary(c: Column, terms: list[tuple[str, str]]) -> Column:
    """longest sources first, in any case, literally; a table of terms that fits the driver."""
    out = c
    for source, target in sorted(terms, key=lambda t: (-len(t[0]), t[0])):
        quoted = "(?i)\\Q" + source.replace("\\E", "\\E\\\\E\\Q") + "\\E"
        out = F.regexp_replace(out, F.lit(quoted), F.lit(target.replace("\\", "\\\\").replace("$", "\\$")))
    return out


def notice_group_by_prefix(category: Column) -> Column:
    """beam and funding by the category's prefix, else meetings."""
    c = F.lower(empty_if_null(category))
    return F.when(c.startswith("beam"), "beam").when(c.startswith("fund"), "funding").otherwise("meetings")


#: Words of the notice groups.
BEAM_WORDS = ("beam", "proposal", "束流", "实验申请")
FUND_WORDS = ("fund", "grant", "nsfc", "基金", "资助", "项目申报", "csc", "博士后")


def notice_group_by_words(category: Column, scope: Column, title: Column) -> Column:
    """by words in category, scope and title."""
    t = F.lower(F.concat_ws(" ", empty_if_null(category), empty_if_null(scope), empty_if_null(title)))
    return F.when(any_of(t, BEAM_WORDS), "beam").when(any_of(t, FUND_WORDS), "funding").otherwise("meetings")


def notice_group_by_category(category: Column) -> Column:
    """by words in the category alone."""
    c = F.lower(empty_if_null(category))
    return F.when(any_of(c, ("beam",)), "beam").when(any_of(c, ("fund", "grant")), "funding").otherwise("meetings")


def abstract_state(abstract: Column, status: Column) -> Column:
    """full, unavailable (all sources were asked) or missing."""
    return F.when(empty_if_null(abstract) != "", "full").when(status == "unavailable", "unavailable").otherwise("missing")


def abstract_source_label(source: Column, labels: dict[str, str]) -> Column:
    out = F.lit("")
    for k, v in labels.items():
        out = F.when(F.lower(empty_if_null(source)) == k.lower(), v).otherwise(out)
    return F.when((out == "") & (empty_if_null(source) != ""), source).otherwise(out)


def nuclides(c: Column, patterns: tuple[str, str] = (r"\b(\d{1,3})([A-Z][a-z]?)\b", r"\b([A-Z][a-z]?)-(\d{1,3})\b"), limit: int = 8) -> Column:
    """``A`` and symbol of both spellings, distinct in order, the number-first ones before the others."""
    t = empty_if_null(c)
    a = F.zip_with(F.regexp_extract_all(t, F.lit(patterns[0]), 1), F.regexp_extract_all(t, F.lit(patterns[0]), 2), lambda n, s: F.concat(n, s))
    b = F.zip_with(F.regexp_extract_all(t, F.lit(patterns[1]), 2), F.regexp_extract_all(t, F.lit(patterns[1]), 1), lambda n, s: F.concat(n, s))
    return F.slice(F.array_distinct(F.concat(a, b)), 1, limit)


def facts(c: Column, vocabulary: dict[str, str], limit: int | None = None) -> Column:
    """the labels whose pattern occurs, in the vocabulary's order."""
    t = F.lower(empty_if_null(c))
    out = F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(label)) for label, p in vocabulary.items()]))
    return F.slice(out, 1, limit) if limit else out


def publish_fragment(c: Column, tag: str = "main") -> Column:
    """F32: the inside of the first ``tag``, scripts dropped, links as spans."""
    body = F.regexp_extract(empty_if_null(c), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    body = F.regexp_replace(body, r"(?is)<script\b[^>]*>.*?</script>", "")
    body = F.regexp_replace(body, r"(?i)<a\b[^>]*>", "<span>")
    return F.trim(F.regexp_replace(body, r"(?i)</a>", "</span>"))


def keyword_suggestions(categories: Column, tags: Column, personal: Column, limit: int = 16) -> Column:
    """category names, tags and the last eight personal keywords."""
    empty = F.array().cast("array<string>")
    mine = F.coalesce(personal, empty)
    last = F.slice(mine, F.greatest(F.size(mine) - 7, F.lit(1)), 8)
    return ci_unique(F.concat(F.coalesce(categories, empty), F.coalesce(tags, empty), last), limit)


def split_author(name: Column) -> Column:
    """``Last, First`` as a struct; without a comma all is the last name."""
    parts = F.split(F.trim(empty_if_null(name)), ",", 2)
    return F.struct(F.trim(parts[0]).alias("last"), F.trim(F.coalesce(F.get(parts, 1), F.lit(""))).alias("first"))


def author_line(authors: Column, cap: int, more: str = " et al.") -> Column:
    a = F.coalesce(authors, F.array().cast("array<string>"))
    return F.concat(F.array_join(F.slice(a, 1, cap), ", "), F.when(F.size(a) > cap, F.lit(more)).otherwise(""))


def union_capped(a: Column, b: Column, n: int) -> Column:
    """Ordered union of two arrays with a cap; null arrays are empty."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(a, empty), F.coalesce(b, empty))), 1, n)
