"""Catalogue merge, new records, abstract backfill and history union. Groups are never collected: every field is an aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, empty_if_null, history_key, reusable_license, title_key
from ..functions.text import doi as normal_doi
from ..storage import kept
from .filters import due_for_retry, valid_abstract

#: Of an existing and an incoming value, which one stays: the first or the last that is filled.
KEEP_OLD = ("arxiv_id", "pdf_url", "doi", "first_seen")
PREFER_NEW = ("journal_abbrev", "volume", "issue", "pages", "numpages", "publisher", "publisher_url", "abstract", "abstract_source", "license", "last_seen")
NOTICE_FIELDS = ("summary", "published", "deadline", "notice_category", "source_url", "scope")
UNIONS = {"categories": 4, "tags": 10, "publisher_licenses": None}


def merge_targets(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``incoming`` with ``target``: the last existing record of its title key, else the id of the first incoming row with
    that key, else (no key) its own id. The index of titles never changes once a title has a target, so this needs no loop."""
    known = existing.where(empty_if_null(F.col("id").cast("string")) != "").select(title_key(F.col("title")).alias("_key"), "id", "seq").where("_key <> ''")
    return with_targets(incoming, known.groupBy("_key").agg(F.max_by("id", "seq").alias("_old")))


def with_targets(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """As ``merge_targets``, with the existing records given as ``known(_key, _old)``: a title key's last id."""
    mine = incoming.withColumn("_key", title_key(F.col("title")))
    first = mine.where("_key <> ''").groupBy("_key").agg(F.min_by("id", "seq").alias("_new"))
    index = first.join(known, "_key", "left").select("_key", F.coalesce("_old", "_new").alias("_target"))
    return mine.join(index, "_key", "left").withColumn("target", F.coalesce("_target", "id")).drop("_key", "_target")


def merge_records(existing: DataFrame, incoming: DataFrame, max_items: int | None = None) -> DataFrame:
    """The catalogue after ``incoming``; both need ``id, seq, title`` and share their other columns, absent values null.

    Rows fold into their target in ``seq`` order. A journal's metadata replaces all but a journal's; otherwise a row only
    fills gaps. Identifiers and first sight keep the old value; abstract, citation fields, licence and last sight prefer
    a new filled one. Categories, tags and licences unite in order; importance is the highest. Notices don't lose
    filled fields. Of existing rows with one id the last counts; existing rows without id go. At last the top
    ``max_items`` by date, importance, title, id.
    """
    old = existing.where(empty_if_null(F.col("id").cast("string")) != "")
    last = Window.partitionBy("id").orderBy(F.desc("seq"))
    old = old.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    out = fold_targets(old, merge_targets(existing, incoming))
    return out if max_items is None else out.orderBy(*newest_first()).limit(max_items)


def fold_targets(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Existing records of distinct ids, and ``incoming`` with ``target``, folded to a record for each target."""
    rows = existing.withColumns({"target": F.col("id"), "_new": F.lit(0)}).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rows = rows.withColumn("_at", F.struct("_new", "seq"))
    # when a target became a journal's
    journal = empty_if_null(F.col("source_type")) == "journal"
    became = rows.where(journal).groupBy("target").agg(F.min("_at").alias("_journal"))
    rows = rows.join(became, "target", "left")

    def pick(c: str, when: Column, first: bool = False) -> Column:
        take = F.min_by if first else F.max_by
        return take(F.when(when, F.col(c)), F.when(when, F.col("_at")))

    aggregates, unions = [F.count(F.lit(1)).alias("_rows")], {}
    for c in existing.columns:
        filled = F.col(c).isNotNull() & (F.size(c) > 0 if dict(existing.dtypes)[c].startswith("array") else F.col(c).cast("string") != "")
        present = F.col(c).isNotNull()
        if c in ("id", "seq"):
            continue
        if c in UNIONS:
            unions[c] = UNIONS[c]
        elif c == "importance":
            aggregates.append(F.max(c).alias(c))
        elif c == "citation_metadata_checked":
            aggregates.append(F.bool_or(c).alias(c))
        elif c in KEEP_OLD or c == "figures":
            aggregates.append(F.coalesce(pick(c, filled, first=True), F.max(c)).alias(c))
        elif c in PREFER_NEW or c == "citation_authors":
            aggregates.append(F.coalesce(pick(c, filled), F.max(c)).alias(c))
        else:
            by_journal = pick(c, present & journal)
            before = pick(c, present & (F.col("_journal").isNull() | (F.col("_at") < F.col("_journal"))))
            after = pick(c, present, first=True)
            value = F.coalesce(by_journal, before, after)
            if c in NOTICE_FIELDS and "type" in existing.columns:
                value = F.when(F.max("type") == "notice", F.coalesce(pick(c, filled), F.max(c))).otherwise(value)
            aggregates.append(value.alias(c))
    out = rows.groupBy("target").agg(F.min(F.struct("_at", "seq"))["seq"].alias("seq"), *aggregates)
    if unions:
        # Elements of all lists by their first place; the explode is of short arrays and keeps no group together.
        none = F.array().cast("array<string>")
        marked = lambda k, c: F.transform(F.coalesce(c, none), lambda e, i: F.struct(F.lit(k).alias("_kind"), i.alias("_pos"), e.alias("_e")))
        marks = [marked(k, c) for k, c in enumerate(unions)]
        each = rows.select("target", "_at", F.inline(F.concat(*marks))).groupBy("target", "_kind", "_e").agg(F.min(F.struct("_at", "_pos")).alias("_p"))
        lists = each.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("_kind", "_p", "_e"))).alias("_lists"))
        out = out.join(lists, "target", "left")
        held = F.coalesce("_lists", F.array().cast(lists.schema["_lists"].dataType))
        of_kind = lambda k: F.filter(held, lambda x: x["_kind"] == k)
        for k, (c, cap) in enumerate(unions.items()):
            united = F.transform(of_kind(k), lambda x: x["_e"])
            out = out.withColumn(c, F.slice(united, 1, cap) if cap else united)
    if "abstract_status" in existing.columns:
        out = out.withColumn("abstract_status", F.when(F.col("_rows") > 1, F.when(empty_if_null(F.col("abstract")) != "", "full").otherwise("missing")).otherwise(F.col("abstract_status")))
    if "rights_status" in existing.columns and "license" in existing.columns:
        out = out.withColumn("rights_status", F.when((F.col("_rows") > 1) & reusable_license(F.col("license")), "reusable").otherwise(F.col("rights_status")))
    if "figure_status" in existing.columns and "figures" in existing.columns:
        out = out.withColumn("figure_status", F.when((F.col("_rows") > 1) & (F.size("figures") > 0), "ready").otherwise(F.col("figure_status")))
    return out.withColumnRenamed("target", "id").select(*existing.columns)


def newest_first() -> list[Column]:
    """Date, importance and title descending, with the id to settle ties."""
    return [F.desc(empty_if_null(F.col("published"))), F.desc(F.coalesce("importance", F.lit(0))), F.desc(empty_if_null(F.col("title"))), F.desc("id")]


def new_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming records that are really new: the first row of each id (title key without one) whose id and title key
    the catalogue doesn't have. Empty title keys match nothing."""
    mine = incoming.withColumn("_title", title_key(F.col("title")))
    mine = mine.withColumn("_key", F.coalesce(F.nullif(F.col("id").cast("string"), F.lit("")), F.nullif(F.col("_title"), F.lit("")))).where("_key is not null")
    first = mine.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("seq"))).where("_n = 1")
    ids = existing.select("id").where("id is not null").distinct()
    titles = existing.select(title_key(F.col("title")).alias("_title")).where("_title <> ''").distinct()
    return first.join(ids, "id", "left_anti").join(titles, "_title", "left_anti").drop("_title", "_key", "_n")


def history_union(catalogue: DataFrame, shards: DataFrame, min_year: int = 2001) -> DataFrame:
    """One row per DOI (id without one). Of the catalogue, from ``min_year`` on, the last row counts and comes first, then
    shards in ``seq`` order; the first row stays unless it has no abstract and a later one has: then the first of these."""
    year = F.substring("published", 1, 4)
    mine = catalogue.where(year.rlike(r"^\d{4}$") & (year.try_cast("int") >= min_year)).withColumn("_key", history_key(F.col("doi"), F.col("id")))
    mine = mine.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(F.desc("seq")))).where("_n = 1").drop("_n")
    both = mine.withColumn("_origin", F.lit(0)).unionByName(shards.withColumn("_key", history_key(F.col("doi"), F.col("id"))).withColumn("_origin", F.lit(1)))
    order = Window.partitionBy("_key").orderBy(F.when(empty_if_null(F.col("abstract")) != "", 0).otherwise(1), "_origin", "seq")
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_key", "_origin")


def due_candidates(papers: DataFrame, sources: list[dict]) -> DataFrame:
    """For each DOI of a paper without abstract, what each source has last: ``_doi, found_<i>`` (struct of abstract, arxiv_id).

    Only rows of wanted DOIs are aggregated, and all sources are in one pass: a dump is filtered by the wanted DOIs, a narrow table,
    before it is shuffled, by a broadcast if these are few, else where its rows meet them."""
    wanted = kept(papers.where((F.col("_doi") != "") & (empty_if_null(F.col("abstract")) == "")).select("_doi").distinct(), "wanted-dois")
    if wanted.count() <= WANTED_DOIS:
        wanted = F.broadcast(wanted)
    parts = []
    for i, s in enumerate(sources):
        arxiv = F.col("arxiv_id") if "arxiv_id" in s["table"].columns else F.lit(None)
        parts.append(
            s["table"].select(normal_doi(F.col("doi")).alias("_doi"), F.lit(i).alias("_i"), F.col("seq").cast("long").alias("_seq"), F.struct(F.col("abstract").alias("abstract"), arxiv.cast("string").alias("arxiv_id")).alias("_found"))
        )
    rows = reduce(DataFrame.unionByName, parts).where("_doi <> ''").join(wanted, "_doi", "left_semi")
    mine = lambda i: F.col("_i") == i
    return kept(rows.groupBy("_doi").agg(*[F.max_by(F.when(mine(i), F.col("_found")), F.when(mine(i), F.col("_seq"))).alias(f"found_{i}") for i in range(len(sources))]), "found-abstracts")


#: DOIs of 16 to 60 bytes that are broadcast at most.
WANTED_DOIS = 500_000


#: Places up to which a row is found by a bounded sort of the whole table.
NEAR_ROWS = 20_000


def row_at(rows: DataFrame, order: list[Column], place: int) -> Row | None:
    """The row at ``place``, from 1, in an order that leaves no ties; none if there are fewer rows. A far one is looked for in the range of the
    table that has it: Spark's bounded sort holds room for every row before it, in each task and on the driver."""
    n = rows.count()
    if place > n:
        return None
    if place > NEAR_ROWS:
        ranged = kept(rows.repartitionByRange(-(-n // NEAR_ROWS), *order).withColumn("_range", F.spark_partition_id()), "ranges")
        for part, size in sorted(ranged.groupBy("_range").count().collect()):
            if place <= size:
                break
            place -= size
        rows = ranged.where(F.col("_range") == part).drop("_range")
    return rows.orderBy(*order).offset(place - 1).limit(1).first()


def _within(queue: list[tuple[str, bool]], last: dict) -> Column:
    """Whether a row is at or before ``last`` in an order of columns (name, descending)."""
    out = F.lit(True)
    for name, down in reversed(queue):
        c, v = F.col(name), F.lit(last[name])
        out = (c > v if down else c < v) | ((c == v) & out)
    return out


def backfill_abstracts(papers: DataFrame, sources: list[dict], now: Column) -> DataFrame:
    """Missing abstracts from ordered secondary tables.

    A source: ``name, table(doi, abstract, seq[, arxiv_id]), limit, cooldown_days, default_days, checked`` (the column with
    ``{status, checked_at}`` of earlier attempts), ``validate`` and ``accept`` (what makes of a found text and the paper's title the text
    to take, or empty; C9 unless given). Of a source's queue, the never tried first, then by
    date and importance, ``limit`` rows are looked up; a found text is taken by the first source that has one. Adds
    ``abstract, abstract_source`` and ``attempt_<name>`` (enriched, not_found, deferred or null), and, where ``papers`` has
    ``arxiv_id`` and ``pdf_url``, fills empty ones from the source that gave the text. The papers meet the found texts once, by
    DOI; a source's queue needs its last row only, which is looked for in a table of narrow columns. Papers without id wait.
    """
    p = papers.withColumn("_doi", normal_doi(F.col("doi")))
    found = due_candidates(p, sources)
    narrow, checks = ["id", "title", "abstract", "published", "importance", "_doi"], list(dict.fromkeys(s["checked"] for s in sources))
    slim = p.where((F.col("_doi") != "") & (empty_if_null(F.col("abstract")) == "") & F.col("id").isNotNull()).select(*narrow, *checks).join(found, "_doi", "left")
    slim = kept(slim.withColumns({"_published": empty_if_null(F.col("published")), "_importance": F.coalesce(F.col("importance").cast("double"), F.lit(0.0)), "abstract_source": F.lit(None).cast("string"), "_arxiv": F.lit(None).cast("string")}), "papers-due")
    for i, s in enumerate(sources):
        name, checked = s["name"], F.col(s["checked"])
        due = due_for_retry(empty_if_null(F.col("abstract")) == "", F.col("_doi"), checked["status"], checked["checked_at"], now, s.get("cooldown_days", {}), s.get("default_days"))
        slim = slim.withColumns({"_due": F.coalesce(due, F.lit(False)), "_never": F.when(checked["checked_at"].isNull(), 0).otherwise(1)})
        queue = [("_never", False), ("_published", True), ("_importance", True), ("id", False)]
        waiting = slim.where("_due").select(*[c for c, _ in queue])
        last = row_at(waiting, [F.desc(c) if down else F.asc(c) for c, down in queue], s["limit"]) if s["limit"] > 0 else None
        looked = F.col("_due") & (_within(queue, last.asDict()) if last else F.lit(s["limit"] > 0))
        got = F.col(f"found_{i}")
        accept = s.get("accept") or (valid_abstract if s.get("validate", True) else lambda found, title: clean_text(found))
        text = empty_if_null(accept(got["abstract"], F.col("title")))
        new = looked & (text != "")
        slim = slim.withColumns(
            {
                f"attempt_{name}": F.when(new, "enriched").when(looked, "not_found").when(F.col("_due"), "deferred"),
                "abstract_source": F.when(new, F.lit(name)).otherwise(F.col("abstract_source")),
                "_arxiv": F.when(new, F.nullif(empty_if_null(got["arxiv_id"]), F.lit(""))).otherwise(F.col("_arxiv")),
                "abstract": F.when(new, text).otherwise(F.col("abstract")),
            }
        )
        # what one source has filled another doesn't look for: the next queue starts from this table
        slim = kept(slim.drop("_due", "_never"), "papers-due")
    attempts = [f"attempt_{s['name']}" for s in sources]
    filled = slim.select("id", "_doi", F.struct(F.col("abstract"), "abstract_source", F.col("_arxiv").alias("arxiv"), *attempts).alias("_filled")).dropDuplicates(["id", "_doi"])
    out = p.join(filled, ["id", "_doi"], "left")
    new = F.col("_filled.abstract_source").isNotNull()
    values = {"abstract": F.when(new, F.col("_filled.abstract")).otherwise(F.col("abstract")), "abstract_source": F.when(new, F.col("_filled.abstract_source")).otherwise(F.col("abstract_source"))}
    if {"arxiv_id", "pdf_url"} <= set(papers.columns):
        takes = new & F.col("_filled.arxiv").isNotNull() & (empty_if_null(F.col("arxiv_id")) == "")
        values["arxiv_id"] = F.when(takes, F.col("_filled.arxiv")).otherwise(F.col("arxiv_id"))
        values["pdf_url"] = F.when(takes, F.concat(F.lit("https://arxiv.org/pdf/"), F.col("_filled.arxiv"))).otherwise(F.col("pdf_url"))
    values |= {a: F.col(f"_filled.{a}") for a in attempts}
    return out.select(*papers.columns, "_filled", *([] if "abstract_source" in papers.columns else [F.lit(None).cast("string").alias("abstract_source")])).withColumns(values).drop("_filled")


def abstract_availability(papers: DataFrame, attempts: list[str]) -> DataFrame:
    """The sources that were asked, and ``full``, ``unavailable`` (a DOI, and all were asked) or ``missing``."""
    asked = F.array_compact(F.array(*[F.when(F.col(a).isNotNull(), F.lit(a)) for a in attempts]))
    status = F.when(empty_if_null(F.col("abstract")) != "", "full").when((empty_if_null(F.col("doi")) != "") & (F.size(asked) == len(attempts)), "unavailable").otherwise("missing")
    return papers.withColumns({"abstract_checked_sources": asked, "abstract_status": status})


def backfill_months(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Every month's records after its incoming ones are merged in (J1), with ``month`` and ``place``, by date, source and title
    descending. Months, those of ``published``, never mix: ids and title keys count within one."""
    head = "0000-00 "

    def within(df: DataFrame) -> DataFrame:
        month = F.rpad(F.substring(empty_if_null(F.col("published")), 1, 7), len(head) - 1, "-")
        return df.withColumns({"title": F.concat(month, F.lit(" "), empty_if_null(F.col("title"))), "id": F.concat(month, F.lit(" "), F.col("id").cast("string")), "history_month": month})

    merged = merge_records(within(existing), within(incoming))
    rest = lambda c: F.substr(c, F.lit(len(head) + 1))
    merged = merged.withColumns({"title": rest("title"), "month": F.substring("id", 1, len(head) - 1), "id": rest("id").cast(existing.schema["id"].dataType)})
    order = Window.partitionBy("month").orderBy(F.desc(empty_if_null(F.col("published"))), F.desc(empty_if_null(F.col("source"))), F.desc(empty_if_null(F.col("title"))), F.desc("id"))
    return merged.withColumn("place", F.row_number().over(order)).drop("history_month")


def backfill_status(existing: DataFrame, incoming: DataFrame, results: DataFrame) -> DataFrame:
    """``month, complete, sources, count, new_count, abstract_count``: whether all of a month's sources were read, its records
    after the merge, the really new ones (J2), and those with an abstract. ``results(month, source, ok)``."""
    month = F.substring(empty_if_null(F.col("published")), 1, 7)
    named = lambda df: df.withColumns({"title": F.concat_ws(" ", month, "title"), "id": F.concat_ws(" ", month, F.col("id").cast("string"))})
    new = new_records(named(existing), named(incoming)).groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("new_count"))
    counts = backfill_months(existing, incoming).groupBy("month").agg(F.count(F.lit(1)).alias("count"), F.count_if(empty_if_null(F.col("abstract")) != "").alias("abstract_count"))
    state = results.groupBy("month").agg(F.bool_and("ok").alias("complete"), F.count(F.lit(1)).alias("sources"))
    out = state.join(counts, "month", "left").join(new, "month", "left")
    return out.select("month", "complete", "sources", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("count", "new_count", "abstract_count")])
