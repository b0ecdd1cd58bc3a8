"""Counts over records, runs and user state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_left, deadline_state
from ..functions.text import empty_if_null, first_filled
from .filters import latest_day

UNFOCUSED = ("frontiers", "ai-science")


def month_of(c: str = "published") -> Column:
    return F.substring(F.col(c), 1, 7)


def focused(categories: Column, unfocused=UNFOCUSED) -> Column:
    return F.exists(categories, lambda c: ~c.isin(*unfocused))


def month_stats(papers: DataFrame, completed: DataFrame | None = None, unfocused=UNFOCUSED) -> DataFrame:
    """A1: counts per month; categories and sources as ``name:count`` lists sorted by name; whether the month is complete.
    Only months of the form ``yyyy-MM`` count."""
    p = papers.withColumn("month", month_of()).where(F.col("month").rlike(r"^.{4}-.{2}$"))
    flag = lambda c: F.sum(c.cast("long"))
    base = p.groupBy("month").agg(
        F.count(F.lit(1)).alias("count"),
        flag(focused(F.col("categories"), unfocused)).alias("nuclear_count"),
        flag(empty_if_null(F.col("source_type")) == "journal").alias("journal_count"),
        flag(empty_if_null(F.col("source_type")) == "preprint").alias("preprint_count"),
        flag(empty_if_null(F.col("abstract")) != "").alias("abstract_count"),
        flag(F.coalesce("importance", F.lit(0)) >= 60).alias("featured_count"),
    )
    source = first_filled(F.col("source_short"), F.col("source"), F.lit("未知来源"))
    for name, key in (("categories", F.explode("categories")), ("sources", source)):
        n = p.select("month", key.alias("k")).groupBy("month", "k").agg(F.count(F.lit(1)).alias("n"))
        n = n.groupBy("month").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k", F.col("n").cast("string")))), ",").alias(name))
        base = base.join(n, "month", "left").withColumn(name, empty_if_null(F.col(name)))
    if completed is None:
        return base.withColumn("backfill_complete", F.lit(False))
    done = completed.select("month").distinct().withColumn("_done", F.lit(True))
    return base.join(done, "month", "left").withColumn("backfill_complete", F.coalesce("_done", F.lit(False))).drop("_done")


def year_stats(papers: DataFrame) -> DataFrame:
    """A2: counts per month, year and in all, by one rollup: ``year, month, level, count`` (level 0 month, 1 year, 3 all)."""
    p = papers.withColumn("month", month_of()).where(F.col("month").rlike(r"^\d{4}-.{2}$")).withColumn("year", F.substring("month", 1, 4))
    return p.rollup("year", "month").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("count"))


def coverage_through(months: DataFrame, start: str) -> DataFrame:
    """The last month of the unbroken run of completed ``months(month)`` from ``start``; empty if that one is missing."""
    at = F.substring("month", 1, 4).try_cast("int") * 12 + F.substring("month", 6, 2).try_cast("int")
    first = int(start[:4]) * 12 + int(start[5:7])
    m = months.select("month").distinct().withColumn("i", at - first).where("i >= 0")
    run = m.withColumn("n", F.row_number().over(Window.orderBy("i")) - 1).where("i = n")  # one row per month of history
    return run.agg(F.coalesce(F.max("month"), F.lit("")).alias("coverage_through"))


def manifest(papers: DataFrame, completed: DataFrame, start: str) -> DataFrame:
    """A3."""
    m = month_of()
    valid = m.rlike(r"^.{4}-.{2}$")
    base = papers.agg(
        F.count(F.lit(1)).alias("indexed_papers"),
        F.countDistinct(F.when(valid, m)).alias("indexed_months"),
        F.coalesce(F.min(F.when(valid, m)), F.lit("")).alias("earliest_month"),
        F.coalesce(F.max(F.when(valid, m)), F.lit("")).alias("latest_month"),
    )
    done = completed.agg(F.countDistinct("month").alias("completed_months"))
    return base.crossJoin(done).crossJoin(coverage_through(completed, start))  # three one-row tables


def date_bounds(papers: DataFrame) -> DataFrame:
    """First and last day, empty values left out."""
    day = F.nullif(F.substring("published", 1, 10), F.lit(""))
    return papers.agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def _counted(papers: DataFrame, marks: Column, zero: list[tuple[str, str]]) -> DataFrame:
    """``kind, name, n``: how many rows bear each of their marks, in one scan; ``zero`` marks are there even if none does."""
    each = papers.select(F.explode(marks).alias("m")).select("m.kind", "m.name", F.lit(1).cast("long").alias("n"))
    none = papers.sparkSession.createDataFrame([(k, n, 0) for k, n in zero], "kind string, name string, n long")
    return each.unionByName(none).groupBy("kind", "name").agg(F.sum("n").alias("n"))


def _mark(kind: str, name, on=None) -> Column:
    s = F.struct(F.lit(kind).alias("kind"), (F.lit(name) if isinstance(name, str) else name).alias("name"))
    return s if on is None else F.when(on, s)


def _categories(kind: str = "category") -> Column:
    return F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("name")))


def insights(papers: DataFrame, days: int = 30) -> DataFrame:
    """A4: long form ``kind, name, n``: totals, per source, per category, and per day of the latest ``days`` days that occur."""
    day, kind = F.substring("published", 1, 10), empty_if_null(F.col("source_type"))
    p = papers.crossJoin(F.broadcast(latest_day(papers)))
    marks = F.array(
        _mark("total", "papers"), _mark("total", "journal", kind == "journal"), _mark("total", "preprint", kind == "preprint"),
        _mark("total", "latest_day", day == F.col("latest_day")), _mark("source", F.col("source")), _mark("day", day, day != ""),
    )
    n = _counted(p, F.concat(F.array_compact(marks), _categories()), [("total", c) for c in ("papers", "journal", "preprint", "latest_day")])
    ranked = n.withColumn("_n", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("name"))))  # of counts, not of papers
    return ranked.where((F.col("kind") != "day") | (F.col("_n") <= days)).drop("_n")


def facet_counts(papers: DataFrame) -> DataFrame:
    """A5: categories and sources of the selection with counts, and ``all``."""
    return _counted(papers, F.concat(F.array(_mark("category", "all"), _mark("source", F.col("source"))), _categories()), [("category", "all")])


def group_counts(records: DataFrame, group: str, groups: DataFrame) -> DataFrame:
    """Counts per group of the dimension ``groups(name)``, zero where there is none."""
    n = records.groupBy(F.col(group).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return groups.select("name").join(n, "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def favorite_keyword_stats(favorites: DataFrame) -> DataFrame:
    """Per user and keyword, in any case, the first spelling and the count; favourites without keywords count under an
    empty one. ``favorites(user, seq, keywords)``."""
    words = favorites.select("user", "seq", F.explode_outer("keywords").alias("k")).withColumn("k", F.trim(empty_if_null(F.col("k"))))
    return words.groupBy("user", F.lower("k").alias("keyword")).agg(F.min_by("k", "seq").alias("label"), F.count(F.lit(1)).alias("n"))


def translation_coverage(records: DataFrame, translations: DataFrame) -> DataFrame:
    """Records, translated ones and whole percent per kind, and in all (kind ``all``)."""
    t = translations.where(empty_if_null(F.col("title_zh")) != "").select("id").distinct().withColumn("_t", F.lit(1))
    r = records.join(t, "id", "left").rollup("kind").agg(F.count(F.lit(1)).alias("total"), F.count("_t").alias("translated"))
    return r.select(F.coalesce("kind", F.lit("all")).alias("kind"), "total", "translated", F.expr("cast(translated * 100 div total as long)").alias("percent"))


def source_health(runs: DataFrame) -> DataFrame:
    """Per kind, of the latest run of each source: sources, healthy ones, records, duration, and whether all of them failed;
    and of all runs the last success, null if there is none."""
    last = runs.groupBy("kind", "name").agg(F.max_by(F.struct("ok", "count", "duration_ms"), F.struct("run_at", "seq")).alias("r"), F.max(F.when(F.col("ok"), F.col("run_at"))).alias("success"))
    return last.groupBy("kind").agg(
        F.count(F.lit(1)).alias("sources"),
        F.sum(F.col("r.ok").cast("long")).alias("healthy"),
        F.sum("r.count").alias("records"),
        F.sum("r.duration_ms").alias("duration_ms"),
        (~F.bool_or("r.ok")).alias("all_failed"),
        F.max("success").alias("last_success"),
    )


def ranked(counts: DataFrame, kind: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` of a small count table, with their rank."""
    top = counts.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.lit(kind).alias("kind"), "rank", "name", "n")


def briefing(papers: DataFrame, priorities: DataFrame, unfocused=UNFOCUSED) -> DataFrame:
    """A10: of the latest day's focused papers: totals, five topics by priority, then count, five sources, three items."""
    p = papers.crossJoin(F.broadcast(latest_day(papers))).where((F.substring("published", 1, 10) == F.col("latest_day")) & focused(F.col("categories"), unfocused))
    n = F.count(F.lit(1)).alias("n")
    kinds = p.groupBy(F.col("source_type").alias("name")).agg(n).where("name <> ''").select(F.lit("type").alias("kind"), F.lit(0).alias("rank"), "name", "n")
    topics = p.select(F.explode("categories").alias("name")).groupBy("name").agg(n).join(F.broadcast(priorities), "name", "left")
    topics = ranked(topics, "topic", 5, F.desc(F.coalesce("priority", F.lit(0))), F.desc("n"), F.asc("name"))
    sources = ranked(p.groupBy(F.col("source").alias("name")).agg(n), "source", 5, F.desc("n"), F.asc("name"))
    items = ranked(p.select(F.col("id").cast("string").alias("name"), F.col("importance").cast("long").alias("n")), "item", 3, F.desc("n"), F.asc("name"))
    return kinds.unionByName(topics).unionByName(sources).unionByName(items)


def selection_metrics(papers: DataFrame, favorites: DataFrame, keyword_hits: DataFrame, notes: DataFrame, priorities: DataFrame) -> DataFrame:
    """Results, how many of them are favourites, keyword hits or noted, and five topics by count, then priority, as
    ``name:count``. ``priorities(name, priority)``."""
    out = papers.select("id")
    for name, ids in (("favorites", favorites), ("keyword_hits", keyword_hits), ("noted", notes)):
        out = out.join(ids.select("id").distinct().withColumn(name, F.lit(1)), "id", "left")
    out = out.agg(F.count(F.lit(1)).alias("results"), *[F.count(c).alias(c) for c in ("favorites", "keyword_hits", "noted")])
    topics = papers.select(F.explode("categories").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(priorities), "name", "left")
    topics = ranked(topics, "topic", 5, F.desc("n"), F.desc(F.coalesce("priority", F.lit(0))), F.asc("name"))
    top = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(":", "name", F.col("n").cast("string")).alias("t"))))
    return out.crossJoin(topics.agg(F.array_join(F.transform(top, lambda x: x["t"]), ",").alias("topics")))  # two one-row tables


def match_histogram(matches: DataFrame) -> DataFrame:
    """Matches per month; readers sort by month, newest first."""
    return matches.groupBy("month").agg(F.count(F.lit(1)).alias("n"))


def enrichment_stats(attempts: DataFrame) -> DataFrame:
    """Rows by outcome, how many were checked, and how many still lack the text. ``attempts(outcome, missing_after)``."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return attempts.agg(
        n(F.col("outcome").isin("enriched", "not_found", "blocked", "failed")).alias("checked"),
        *[n(F.col("outcome") == o).alias(o) for o in ("enriched", "not_found", "blocked", "failed", "deferred")],
        n(F.col("missing_after")).alias("remaining"),
    )


def notice_board(notices: DataFrame, runs: DataFrame, as_of: Column) -> DataFrame:
    """Notices first seen on the day, open or soon, and published within a week; and of the sources whose ``runs`` are of
    the kind ``notice``, the healthy ones and all, by the latest run of each."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    health = source_health(runs.where(F.col("kind") == "notice"))
    health = health.agg(*[F.coalesce(F.sum(a), F.lit(0)).alias(b) for a, b in (("healthy", "healthy_sources"), ("sources", "total_sources"))])
    board = notices.agg(
        n(F.substring("first_seen", 1, 10) == as_of).alias("new_today"),
        n(deadline_state(F.col("deadline"), as_of).isin("open", "soon")).alias("open"),
        n(days_left(F.col("published"), as_of) >= -6).alias("this_week"),
    )
    return board.crossJoin(health)  # two one-row tables
