"""First and last per key, top-k selections, queues and orderings. Every order ends in a unique tie-breaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import deadline_state
from ..functions.text import empty_if_null
from .filters import latest_day


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the order; ``F.desc`` gives the last."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def dedupe_urls(links: DataFrame) -> DataFrame:
    """The first row of each url within its source, by ``pos``."""
    return first_per_key(links, ["source", "url"], F.asc("pos"))


def top_k_per(df: DataFrame, by: list[str], k: int, *order: Column) -> DataFrame:
    """``rank`` from 1 up to ``k`` within each group; Spark limits groups before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def max_priority(categories: Column, priorities: dict[str, int]) -> Column:
    m = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])
    return F.coalesce(F.array_max(F.transform(categories, lambda c: F.coalesce(F.try_element_at(m, c), F.lit(0)))), F.lit(0))


def featured(papers: DataFrame, priorities: dict[str, int], days: int = 14, least: int = 15, core: int = 32, rest: int = 8) -> DataFrame:
    """Of the ``days`` up to the latest day the ``core`` best whose priority is at least ``least``, then the best of the rest."""
    p = papers.withColumn("priority", max_priority(F.col("categories"), priorities)).crossJoin(F.broadcast(latest_day(papers)))
    p = p.where(F.substring("published", 1, 10) >= F.date_sub(F.to_date("latest_day"), days).cast("string"))
    order = (F.desc("importance"), F.desc("priority"), F.desc("published"), F.asc("id"))
    first = p.where(F.col("priority") >= least).orderBy(*order).limit(core).select("id", F.lit("core").alias("part"))
    other = p.join(first, "id", "left_anti").orderBy(*order).limit(rest).select("id", F.lit("rest").alias("part"))
    return first.unionByName(other)


def digest_papers(papers: DataFrame, core: list[str], limit: int = 8) -> DataFrame:
    """The latest day if it has at least ``min(4, limit)`` papers, else all; core topics, importance, abstract, date."""
    day = F.substring("published", 1, 10)
    p = papers.crossJoin(F.broadcast(latest_day(papers)))
    enough = p.where(day == F.col("latest_day")).agg((F.count(F.lit(1)) >= min(4, limit)).alias("enough"))
    pool = p.crossJoin(F.broadcast(enough)).where(~F.col("enough") | (day == F.col("latest_day")))
    is_core = F.arrays_overlap("categories", F.array(*map(F.lit, core)))
    order = (F.desc(is_core), F.desc("importance"), F.desc(empty_if_null(F.col("abstract")) != ""), F.desc("published"), F.asc("id"))
    return pool.orderBy(*order).limit(limit).select(*papers.columns)


def digest_latest(records: DataFrame, limit: int) -> DataFrame:
    """The latest day's records, all dated ones if these are too few; by importance and date."""
    day = F.substring("published", 1, 10)
    dated = records.where(empty_if_null(F.col("published")) != "").crossJoin(F.broadcast(latest_day(records)))
    few = dated.where(day == F.col("latest_day")).agg((F.count(F.lit(1)) < limit).alias("few"))
    pool = dated.crossJoin(F.broadcast(few)).where(F.col("few") | (day == F.col("latest_day")))
    return pool.orderBy(F.desc("importance"), F.desc("published"), F.asc("id")).limit(limit).select(*records.columns)


def digest_notices(notices: DataFrame, pool: int = 12, per_group: int = 2, total: int = 6) -> DataFrame:
    """Of a pool of the latest, ``per_group`` of each group in the groups' order, filled up to ``total`` in pool order."""
    best = Window.orderBy(F.desc("importance"), F.desc("published"), F.asc("id"))
    p = digest_latest(notices, pool).withColumn("_i", F.row_number().over(best))  # of the pool's few rows
    p = p.withColumn("_g", F.row_number().over(Window.partitionBy("group").orderBy("_i")))
    place = F.when(F.col("_g") <= per_group, F.create_map(F.lit("meetings"), F.lit(0), F.lit("funding"), F.lit(1), F.lit("beam"), F.lit(2))[F.col("group")]).otherwise(9)
    return p.withColumn("_p", place).orderBy("_p", "_i").limit(total).select(*notices.columns)


def enrichment_queue(papers: DataFrame, due: Column, never_tried: Column, limit: int) -> DataFrame:
    """Due rows, never tried ones first, then by date and importance; ``queued`` for the first ``limit``, else deferred."""
    rows = papers.where(due).withColumn("_never", never_tried)
    top = rows.orderBy(F.desc("_never"), F.desc("published"), F.desc("importance"), F.asc("id")).limit(limit).select("id", F.lit(True).alias("queued"))
    return rows.select("id").join(F.broadcast(top) if limit <= 10_000 else top, "id", "left").withColumn("queued", F.coalesce("queued", F.lit(False)))


def rank_core_first(papers: DataFrame, priorities: dict[str, int], k: int) -> DataFrame:
    """By the highest priority of a paper's topics, importance, date; the first row is the spotlight."""
    p = papers.withColumn("priority", max_priority(F.col("categories"), priorities))
    return p.orderBy(F.desc("priority"), F.desc("importance"), F.desc("published"), F.asc("id")).limit(k)


def order_results(papers: DataFrame, mode: str, matched: Column, priorities: dict[str, int]) -> DataFrame:
    """Personal matches first, then by ``importance`` (core topics first), ``source`` or ``newest``."""
    p = papers.withColumn("matched", matched)
    own = {
        "importance": [F.desc(max_priority(F.col("categories"), priorities)), F.desc("importance"), F.desc("published")],
        "source": [F.asc("source"), F.desc("published")],
        "newest": [F.desc("published"), F.desc("importance")],
    }[mode]
    return p.orderBy(F.desc("matched"), *own, F.asc("id"))


def home_papers(papers: DataFrame, journals: list[str], priorities: dict[str, int], k: int = 24) -> DataFrame:
    """Of listed journals, one per DOI (id, else source and title), by date, priority, importance."""
    key = F.coalesce(F.nullif(F.lower(F.trim(empty_if_null(F.col("doi")))), F.lit("")), F.nullif(F.col("id").cast("string"), F.lit("")), F.concat_ws(":", "source", "title"))
    p = papers.where(F.col("source").isin(*journals)).withColumn("_key", key).withColumn("_p", max_priority(F.col("categories"), priorities))
    order = (F.desc("published"), F.desc("_p"), F.desc("importance"), F.asc("id"))
    return first_per_key(p, ["_key"], *order).orderBy(*order).limit(k).select(*papers.columns)


def home_notices(notices: DataFrame, as_of: Column, k: int = 30) -> DataFrame:
    """Open and soon ones first, then by date."""
    open_first = F.when(deadline_state(F.col("deadline"), as_of).isin("open", "soon"), 0).otherwise(1)
    return notices.orderBy(open_first, F.desc("published"), F.asc("id")).limit(k)


def home_news(news: DataFrame, k: int = 30) -> DataFrame:
    """The newest first."""
    return news.orderBy(F.desc(empty_if_null(F.col("published"))), F.asc("id")).limit(k)


def pending_months(status: DataFrame, start: str, as_of: str, n: int) -> DataFrame:
    """Closed months from ``start`` before ``as_of``'s month that ``status(month, complete)`` hasn't as complete, the first ``n``."""
    spark = status.sparkSession
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start + "-01")), F.add_months(F.trunc(F.to_date(F.lit(as_of)), "month"), -1), F.expr("interval 1 month"))).alias("d"))
    months = months.select(F.date_format("d", "yyyy-MM").alias("month"))
    return months.join(status.where("complete").select("month"), "month", "left_anti").orderBy("month").limit(n)


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """A page of the ordered rows, ``number`` from 0."""
    return df.orderBy(*order).offset(number * size).limit(size)


def deadline_board(notices: DataFrame, group: str, as_of: Column, k: int = 8) -> DataFrame:
    """The group's open and soon notices, the earliest deadline first."""
    n = notices.where((F.col("group") == group) & deadline_state(F.col("deadline"), as_of).isin("open", "soon"))
    return n.orderBy("deadline", "id").limit(k)


def union_latest(*frames: DataFrame) -> DataFrame:
    """Rows of all frames by id, the later frame's; columns that a frame lacks are null."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_frame", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return first_per_key(out, ["id"], F.desc("_frame"), F.desc("seq")).drop("_frame")


def remaining_ops(ops: DataFrame, acks: DataFrame) -> DataFrame:
    """U4: operations that weren't acknowledged."""
    return ops.join(acks.select("op_id"), "op_id", "left_anti")


