"""Main text of pages by wrapper induction: same-host trees are aligned, constant nodes are template, varying slots content.

Every host has one reference page. All its pages are aligned with the reference by simple tree matching; nodes without a partner
have the place that their parent's place and label give, so the reference grows by what other pages hold. A text that most
different pages show in the same container is template. What is left, without the parts that markup names as menus, adverts,
comments and the like, is the article.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dom
from .common import discard, join_groups, stored

#: A text is template where this many different pages have its container, and this share of them the text.
LEAST_PAGES, SHARE = 4, 0.8
#: The reference is the shortest page of at least so many characters, or the longest of a host without such.
REFERENCE_CHARS = 1024
#: At most so many hosts count as hot; a reference has at most 40 KB.
HOT_HOSTS = 1000
PAGES_AT_ONCE = 512
_RUNS = ("containers", "keys", "articles", "mains", "titles", "menus", "texts")
_RUN_TYPES = "containers array<long>, keys array<long>, articles array<int>, mains array<int>, titles array<boolean>, menus array<boolean>, texts array<string>"
_KINDS = [pa.list_(k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())]


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _shapes(batches):
    for batch in batches:
        blobs = [dom.blob(dom.parse(h)) for h in _column(batch, "html").to_pylist()]
        yield pa.RecordBatch.from_arrays([_column(batch, "host"), _column(batch, "pages"), pa.array(blobs, pa.binary())], ["host", "pages", "reference"])


@functools.lru_cache(maxsize=64)
def _shape(data: bytes) -> dom.Shape:
    return dom.Shape(data)


def _parsed(batches):
    """Every page's runs of text, one parse and one alignment each."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            part = batch.slice(at, PAGES_AT_ONCE)
            found = [dom.runs(dom.parse(h), _shape(r)) for h, r in zip(_column(part, "html").to_pylist(), _column(part, "reference").to_pylist())]
            columns = [pa.array([[r[i] for r in f] for f in found], kind) for i, kind in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([_column(part, c) for c in ("page_id", "url", "host")] + columns, ["page_id", "url", "host", *_RUNS])


def _texts(batches):
    for batch in batches:
        columns = [_column(batch, c).to_pylist() for c in _RUNS]
        texts = [dom.article(list(zip(*page)), frozenset(t or ())) for *page, t in zip(*columns, _column(batch, "template").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [_column(batch, "page_id"), _column(batch, "url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def references(pages: DataFrame, made: list[str]) -> DataFrame:
    """One page's shape per host: host, pages (how many), reference. A task sends one page for each of its hosts, whatever a host's size."""
    length = F.length("html").cast("long")
    rank = F.when(length >= REFERENCE_CHARS, F.least(length, F.lit((1 << 26) - 1))).otherwise((1 << 27) - length)
    key = F.shiftleft(rank, 35) + F.xxhash64("html").bitwiseAND(F.lit((1 << 35) - 1))
    best = pages.groupBy("host").agg(F.count("*").alias("pages"), F.min_by("html", key).alias("html"))
    return stored(best.mapInArrow(_shapes, "host string, pages long, reference binary"), "references", made)


def templates(parsed: DataFrame, made: list[str]) -> DataFrame:
    """Each host's constant texts: host, template (their keys). Pages with the same longest text are copies of one article and count
    once. A host has fewer keys than its pages have runs of text, since most pages that have a container share each of its keys."""
    longest = F.array_max(F.transform("texts", lambda t: F.struct(F.length(t).alias("n"), F.xxhash64(t).alias("mark"))))
    marked = parsed.select("host", longest["mark"].alias("mark"), "containers", "keys")
    both = F.array_distinct(F.concat(F.arrays_zip("containers", "keys"), F.transform("containers", lambda c: F.struct(c.alias("containers"), F.lit(0).cast("long").alias("keys")))))
    votes = marked.select("host", "mark", F.inline(both)).distinct()
    counts = stored(votes.groupBy("host", "containers", "keys").count().where(F.col("count") >= LEAST_PAGES), "votes", made)
    every = counts.where("keys = 0").select("host", "containers", F.col("count").alias("all"))
    constant = counts.where("keys <> 0").join(every, ["host", "containers"]).where(F.col("count") >= SHARE * F.col("all"))
    return constant.groupBy("host").agg(F.collect_set("keys").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    A null or empty html gives an empty text; a null url, or one without a host, counts to the host ``''``. Repeated rows and null
    ids are kept. Elements nested deeper than 60 levels are laid beside each other, so their text stays. Whole pages are parsed,
    once; other columns are ignored. White space is what ``str.split`` takes for it, no-break spaces included. Constant texts are
    dropped from four different pages of a host on; with fewer, markup alone decides. Where no markup names an article, lists of
    links go and all else stays.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    made: list[str] = []
    shapes = references(rows.select("host", "html"), made)
    parsed = T.StructType([rows.schema["page_id"], rows.schema["url"], rows.schema["host"], *T._parse_datatype_string(_RUN_TYPES).fields])
    met = join_groups(rows, shapes, "host", "pages", HOT_HOSTS).select("page_id", "url", "html", "host", "reference")
    parsed = stored(met.mapInArrow(_parsed, parsed), "runs")
    wrappers = stored(shapes.select("host", "pages").join(templates(parsed, made), "host", "left"), "wrappers")
    discard(pages.sparkSession, made)
    out = T.StructType([rows.schema["page_id"], rows.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return join_groups(parsed, wrappers, "host", "pages", HOT_HOSTS).select("page_id", "url", *_RUNS, "template").mapInArrow(_texts, out)
