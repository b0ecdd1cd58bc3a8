"""Predicates and row filters over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_left, deadline_state
from ..functions.text import any_of, clean_text, empty_if_null, title_key


def latest_day(df: DataFrame, c: str = "published") -> DataFrame:
    """One row with the latest day; empty values don't count."""
    return df.agg(F.max(F.nullif(F.substring(F.col(c), 1, 10), F.lit(""))).alias("latest_day"))


def scope_filter(records: DataFrame, scope: str, first: str = "", last: str = "", primary: str = "") -> DataFrame:
    """``all``; ``today``, the latest day; ``week``, the seven days up to it; ``range``, from ``first`` to ``last``; or
    ``focus``, the latest day and the primary topic. The latest day is a one-row broadcast."""
    day = F.substring("published", 1, 10)
    if scope == "all":
        return records
    if scope == "range":
        return records.where((day >= first) & (day <= last) if last else (day >= first))
    r = records.crossJoin(F.broadcast(latest_day(records)))
    if scope == "week":
        kept = r.where((day >= F.date_sub(F.to_date("latest_day"), 6).cast("string")) & (day <= F.col("latest_day")))
    else:
        kept = r.where(day == F.col("latest_day"))
        if scope == "focus":
            kept = kept.where(F.array_contains("categories", primary))
    return kept.drop("latest_day")


def history_cutoff(records: DataFrame, first: str) -> DataFrame:
    """Records from a day on, and undated ones."""
    return records.where((empty_if_null(F.col("published")) == "") | (F.col("published") >= first))


def search(records: DataFrame, query: str, *fields: Column) -> DataFrame:
    """All words of the query occur, in any case, in the joined fields."""
    hay = F.lower(F.concat_ws(" ", *[empty_if_null(f) for f in fields]))
    out = records
    for word in query.lower().split():
        out = out.where(F.contains(hay, F.lit(word)))
    return out


def facet_filter(records: DataFrame, category: str | None = None, source: str | None = None, ignored: DataFrame | None = None, read: DataFrame | None = None) -> DataFrame:
    """Category membership, source equality, without ignored ids and without ids that were read."""
    out = records
    if category:
        out = out.where(F.array_contains("categories", category))
    if source:
        out = out.where(F.col("source") == source)
    for ids in (ignored, read):
        if ids is not None:
            out = out.join(ids.select("id"), "id", "left_anti")
    return out


def due_for_retry(missing: Column, key: Column, status: Column, checked_at: Column, now: Column, cooldown_days: dict[str, int], default_days: int | None = None) -> Column:
    """Lacks its payload, has a key, and was never checked or not within the cooldown of its status. A timestamp that
    can't be read counts as never; a status without cooldown is due unless there is a default."""
    at = F.try_to_timestamp(checked_at)
    days = F.lit(default_days).cast("int")
    for s, d in cooldown_days.items():
        days = F.when(status == s, d).otherwise(days)
    waited = F.unix_timestamp(now) - F.unix_timestamp(at)
    return missing & (empty_if_null(key) != "") & (at.isNull() | days.isNull() | (waited >= days * 86400))


#: Texts that are no abstract, and no summary.
REJECTED = (
    "enable javascript",
    "access denied",
    "request unsuccessful",
    "verify you are human",
    "checking your browser",
    "cookie policy",
    "page not found",
    "no abstract available",
    "abstract not available",
    "temporarily unavailable",
)
BOILERPLATE = ("indico style", "choose timezone", "africa/abidjan", "skip to main content")


def valid_abstract(c: Column, title: Column, rejected=REJECTED) -> Column:
    """The cleaned text if it is an abstract, else empty: 50 to 20,000 characters, no rejected phrase, and not just the title."""
    text = clean_text(c)
    a, t = title_key(text), title_key(title)
    copy = (t != "") & ((a == t) | (a.startswith(t) & (F.length(text) < F.length(title) + 35)))
    bad = (F.length(text) < 50) | (F.length(text) > 20_000) | any_of(F.lower(text), rejected) | F.coalesce(copy, F.lit(False))
    return F.when(bad, "").otherwise(text)


def low_quality(c: Column) -> Column:
    """C10."""
    t = F.lower(clean_text(c))
    return (F.length(t) < 45) | any_of(t, BOILERPLATE)


def figure_status(figures: Column, status: Column, reusable: Column) -> Column:
    """C11: ready with figures; else pending if the licence allows them, blocked if it doesn't, and unknown without one."""
    return (
        F.when(F.size(figures) > 0, "ready")
        .when(reusable.isNull(), "rights_unknown")
        .when(~reusable, "license_blocked")
        .when(status.isin("source_timeout", "extraction_failed", "no_figures"), status)
        .otherwise("pending")
    )


def notice_filter(notices: DataFrame, timing: str, as_of: Column, group: str | None = None, query: str = "") -> DataFrame:
    """First seen on the run's day (``new``), open or soon (``open``), published within a week (``week``), with group and words."""
    out = notices
    if timing == "new":
        out = out.where(F.substring("first_seen", 1, 10) == as_of)
    elif timing == "open":
        out = out.where(deadline_state(F.col("deadline"), as_of).isin("open", "soon"))
    elif timing == "week":
        n = days_left(F.col("published"), as_of)
        out = out.where(n >= -6)
    if group:
        out = out.where(F.col("group") == group)
    return search(out, query, F.col("title"), F.col("source")) if query else out


def directory_search(entries: DataFrame, query: str, group: str | None = None) -> DataFrame:
    """A group's entries with the query in name, scope, description or tags."""
    hay = F.lower(F.concat_ws(" ", empty_if_null(F.col("name")), empty_if_null(F.col("scope")), empty_if_null(F.col("description")), F.array_join("tags", " ")))
    out = entries.where(F.contains(hay, F.lit(query.lower().strip())))
    return out.where(F.col("category") == group) if group else out
