"""Tables and text files that other programs read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.citations import ris
from ..functions.text import ci_unique, clip, empty_if_null, first_filled, library_doi, search_text, split_author
from ..operators.merge import newest_first
from ..operators.stats import manifest, month_stats
from .snapshots import Snapshots


def with_month(papers: DataFrame) -> DataFrame:
    m = F.substring("published", 1, 7)
    return papers.where(m.rlike(r"^.{4}-.{2}$")).withColumns({"year": F.substring("published", 1, 4), "month": F.substring("published", 6, 2)})


def write_month_shards(papers: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Parquet by year and month, each month sorted; months that the frame doesn't have stay as they are. Tasks get ranges
    of the whole order, so a month with many rows is shared by several, in files that follow each other."""
    p = with_month(papers)
    order = [F.asc("year"), F.asc("month"), *newest_first()]
    files = p.repartitionByRange(*order).sortWithinPartitions(*order)
    files.write.option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", rows_per_file).partitionBy("year", "month").mode("overwrite").parquet(path)


def publish_history(papers: DataFrame, completed: DataFrame, start: str, root: str) -> dict:
    """S17 with A1 and A3, switched together: month shards as in ``write_month_shards``, each in a folder of its own, the months'
    statistics, and the manifest over all of them, which is in the commit record (its ``about``). Months that the frame doesn't have
    stay as they were. Until the commit, and after a write that was stopped, readers see the version before."""
    spark = papers.sparkSession
    snapshots = Snapshots(spark, root)
    state = snapshots.state()
    p = with_month(papers)
    order = [F.asc("year"), F.asc("month"), *newest_first()]
    sorted_shards = p.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.concat_ws("-", "year", "month"))
    months = {**state["tables"].get("papers", {}), **snapshots.stage(sorted_shards, "papers", "part")}
    whole = spark.read.schema(p.schema).parquet(*[f for _, f in sorted(months.items())]) if months else p
    stats_rows = month_stats(whole, completed)
    tables = {"papers": months, "stats": snapshots.stage(stats_rows.withColumn("part", F.lit("all")), "stats", "part")}
    about = {"manifest": manifest(whole, completed, start).first().asDict(), "schema": p.schema.jsonValue(), "stats": stats_rows.schema.jsonValue()}
    return snapshots.commit({**state, "tables": tables, "about": about})


def published_papers(spark: SparkSession, root: str, months: list[str] | None = None, version: int | None = None) -> DataFrame:
    """The published shards, in one version throughout; of ``months``, if given, only these are opened."""
    snapshots = Snapshots(spark, root)
    state = snapshots.state(version)
    return snapshots.read("papers", T.StructType.fromJson(state["about"]["schema"]), months, state["version"])


def published_stats(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, dict]:
    """A1 and A3 of a published version: the statistics of its months, and its manifest."""
    snapshots = Snapshots(spark, root)
    state = snapshots.state(version)
    return snapshots.read("stats", T.StructType.fromJson(state["about"]["stats"]), version=state["version"]), state["about"]["manifest"]


def search_index(papers: DataFrame) -> DataFrame:
    """The slim columns of a search index with the folded text of all searchable fields."""
    have = set(papers.columns)
    text = [F.col(c) for c in ("title", "abstract", "summary", "source", "source_short", "doi", "arxiv_id") if c in have]
    text += [F.array_join(c, " ") for c in ("authors", "tags", "categories") if c in have]
    p = with_month(papers)
    return p.select("id", "year", F.substring("published", 1, 7).alias("month"), "published", "title", "source", "importance", search_text(*text).alias("search_text"))


def build_search_index(papers: DataFrame, path: str) -> None:
    """Written by year, so that a search of some years reads only these; a year is shared by the tasks of its range of days."""
    search_index(papers).repartitionByRange("year", "published", "id").write.option("partitionOverwriteMode", "dynamic").partitionBy("year").mode("overwrite").parquet(path)


def ris_entries(papers: DataFrame) -> DataFrame:
    """``id, entry``."""
    c = F.col
    return papers.select("id", ris(c("title"), c("authors"), c("source"), c("published"), c("doi"), c("url"), c("abstract")).alias("entry"))


def export_selection(records: DataFrame, favorites: DataFrame) -> DataFrame:
    """What an export takes of the filtered ``records``: those that are favourites, if any is, else all."""
    mine = records.join(favorites.select("id").distinct(), "id", "left_semi")
    return records if mine.isEmpty() else mine.select(records.columns)


def write_ris(records: DataFrame, path: str) -> None:
    """The entries in the list's order (newest first), a blank line after each, as text files that follow each other."""
    order = newest_first()
    listed = records.repartitionByRange(*order).sortWithinPartitions(*order)
    ris_entries(listed).select(F.concat("entry", F.lit("\n")).alias("value")).write.text(path)


def library_items(papers: DataFrame) -> DataFrame:
    """``id, item``: items for a reference manager as JSON. Records without title are left out."""
    cut = lambda name, n: F.substring(F.trim(F.regexp_replace(empty_if_null(F.col(name)), r"\s+", " ")), 1, n)
    pre = empty_if_null(F.col("source_type")) == "preprint"
    tags = ci_unique(F.concat(F.coalesce("categories", F.array().cast("array<string>")), F.coalesce("tags", F.array().cast("array<string>"))))
    item = F.struct(
        cut("id", 200).alias("id"),
        F.when(pre, "preprint").otherwise("journalArticle").alias("itemType"),
        cut("title", 4000).alias("title"),
        F.transform("authors", split_author).alias("creators"),
        cut("published", 100).alias("date"),
        library_doi(F.col("doi")).alias("DOI"),
        F.when(F.col("url").rlike("^https?://"), F.col("url")).otherwise("").alias("url"),
        F.substring(F.trim(empty_if_null(F.col("abstract"))), 1, 50_000).alias("abstractNote"),
        F.transform(tags, lambda t: F.struct(F.substring(t, 1, 200).alias("tag"))).alias("tags"),
        F.when(pre, cut("source", 1000)).alias("repository"),
        F.when(~pre, cut("source", 1000)).alias("publicationTitle"),
        F.when(~pre, cut("source_short", 300)).alias("journalAbbreviation"),
    )
    return papers.where(cut("title", 4000) != "").select("id", F.to_json(item).alias("item"))


def digest_markdown(records: DataFrame, number: Column | None = None, body_chars: int = 360, nothing: str = "数据源暂未提供详细介绍。") -> DataFrame:
    """``id, line``: a Markdown item of localized records (J6), numbered or with a dash."""
    meta = F.array_join(F.filter(F.array(empty_if_null(F.col("source")), empty_if_null(F.col("published"))), lambda x: x != ""), " · ")
    head = F.concat(number.cast("string"), F.lit(". ")) if number is not None else F.lit("- ")
    body = first_filled(clip(F.col("shown_body"), body_chars), F.lit(nothing))
    return records.select("id", F.concat(head, F.lit("**["), F.col("shown_title"), F.lit("]("), empty_if_null(F.col("url")), F.lit(")**  \n   "), meta, F.lit("  \n   "), body).alias("line"))
