"""Log-shaped work: each operator as a batch function, and as a Structured Streaming query with the same result.

The watermark of the daily counts is this library's own: rows later than it are dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ci_unique, empty_if_null
from ..operators.merge import new_records

NOTE_CHARS = 12_000
#: The operations that a log may hold.
TYPES = ("favorite", "ignored", "note", "keywords", "queue")


def clean_ops(ops: DataFrame) -> DataFrame:
    """operations of known types with an id and an item, ids trimmed and cut, notes trimmed, keywords unique (30 at most)."""
    cut = lambda c, n: F.substring(F.trim(empty_if_null(F.col(c).cast("string"))), 1, n)
    x = ops.withColumns({"op_id": cut("op_id", 120), "type": cut("type", 30), "item_id": cut("item_id", 180), "text": cut("text", NOTE_CHARS), "keywords": ci_unique(F.col("keywords"), 30)})
    forbidden = F.col("item_id").isin("__proto__", "prototype", "constructor")
    return x.where((F.col("op_id") != "") & (F.col("item_id") != "") & F.col("type").isin(*TYPES) & ~forbidden)


def fold_user_ops(ops: DataFrame) -> DataFrame:
    """``user, type, item_id, active, text, keywords, seq``: the state after a log, by the last operation on each item; favourites
    and ignored items that were switched off, empty notes and empty keyword lists leave no row. Later by ``ts``, then ``seq``."""
    last = clean_ops(ops).groupBy("user", "type", "item_id").agg(F.max_by(F.struct("active", "text", "keywords", "seq"), F.struct("ts", "seq")).alias("p"))
    return last.select("user", "type", "item_id", "p.*").where(_there())


def _there():
    return (
        F.when(F.col("type").isin("favorite", "ignored"), F.coalesce("active", F.lit(False)))
        .when(F.col("type") == "note", F.col("text") != "")
        .when(F.col("type") == "keywords", F.size("keywords") > 0)
        .otherwise(True)
    )


def fold_user_ops_stream(ops: DataFrame) -> DataFrame:
    """T1 as a stream in update mode: an aggregate of one small row per user, type and item, kept by Spark's state store. It has no end:
    a switch that was set years ago still counts. The sink keeps the last row of each, and ``settled`` drops what was switched off."""
    last = clean_ops(ops).groupBy("user", "type", "item_id").agg(F.max_by(F.struct("active", "text", "keywords", "seq"), F.struct("ts", "seq")).alias("p"))
    return last.select("user", "type", "item_id", "p.*")


def settled(updates: DataFrame) -> DataFrame:
    """The state out of a fold's updates, of which the highest ``seq`` of each item is the last."""
    last = updates.groupBy("user", "type", "item_id").agg(F.max_by(F.struct("active", "text", "keywords", "seq"), "seq").alias("p"))
    return last.select("user", "type", "item_id", "p.*").where(_there())


def compact_queue(ops: DataFrame, acks: DataFrame) -> DataFrame:
    """The newest operation per user, type and item, unless it was acknowledged."""
    last = clean_ops(ops).groupBy("user", "type", "item_id").agg(F.max_by(F.struct("op_id", "seq"), F.struct("ts", "seq")).alias("p"))
    return last.select("user", "type", "item_id", "p.*").join(acks.select(F.col("op_id").cast("string").alias("op_id")).distinct(), "op_id", "left_anti")


def sightings(records: DataFrame) -> DataFrame:
    """T3, the batch twin: per id when it was first and last seen."""
    return records.groupBy("id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def ingest_incremental(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None]):
    """For each batch, write the catalogue with new records added and ``last_seen`` of known ones refreshed. ``read`` gives the catalogue
    (id, first_seen, last_seen) before the batch, and ``write`` must be idempotent by batch number."""

    def step(batch: DataFrame, number: int) -> None:
        both = read().unionByName(sightings(batch))
        write(both.groupBy("id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen")), number)

    return stream.writeStream.foreachBatch(step)


def daily_counts(records: DataFrame, watermark: str = "7 days") -> DataFrame:
    """T4: rows per day of ``ts``; on a stream, days close after the watermark."""
    r = records.withColumn("ts", F.col("ts").cast("timestamp"))
    r = r.withWatermark("ts", watermark) if r.isStreaming else r
    return r.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


def reconcile_state(remote: DataFrame, local: DataFrame) -> DataFrame:
    """T5: ``user, from, favorites, notes, keywords``: the newer of two snapshots, whole; a legacy local draft merges into the remote one:
    maps entry by entry with the local value first, keywords united in any case. Snapshots:
    ``user, updated_at, legacy, favorites map, notes map, keywords``; an unreadable time is the oldest."""
    names = ("updated_at", "legacy", "favorites", "notes", "keywords")
    r = remote.select("user", *[F.col(c).alias(f"r_{c}") for c in names])
    x = r.join(local.select("user", *[F.col(c).alias(f"l_{c}") for c in names]), "user", "full")
    at = lambda c: F.coalesce(F.unix_timestamp(F.try_to_timestamp(c)), F.lit(0))
    legacy = F.coalesce("l_legacy", F.lit(False))
    source = F.when(legacy, "merged").when(~legacy & F.col("l_updated_at").isNotNull() & (at("l_updated_at") > at("r_updated_at")), "local").when(F.col("r_updated_at").isNull(), "local").otherwise("remote")
    none = F.create_map().cast("map<string,string>")

    def united(c: str):
        a, b = F.coalesce(f"r_{c}", none), F.coalesce(f"l_{c}", none)
        return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)

    words = ci_unique(F.concat(F.coalesce("r_keywords", F.array().cast("array<string>")), F.coalesce("l_keywords", F.array().cast("array<string>"))))
    x = x.withColumn("from", source)
    pick = lambda c, merged: F.when(F.col("from") == "merged", merged).when(F.col("from") == "local", F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(c)
    return x.select("user", "from", pick("favorites", united("favorites")), pick("notes", united("notes")), pick("keywords", words))


def run_counts(runs: DataFrame, watermark: str = "7 days") -> DataFrame:
    """T4: per day and kind of ``run_at`` the runs, the records that they brought, and the failed ones; on a stream, days close after the
    watermark."""
    r = runs.withColumn("run_at", F.col("run_at").cast("timestamp"))
    r = r.withWatermark("run_at", watermark) if r.isStreaming else r
    counts = [F.count(F.lit(1)).alias("runs"), F.sum(F.col("count").cast("long")).alias("records"), F.count_if(~F.col("ok")).alias("failed")]
    return r.groupBy(F.window("run_at", "1 day").alias("w"), "kind").agg(*counts).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "runs", "records", "failed")


def keyed_list(items, named: str):
    """An array of structs with ``id, url, title``, merged: one element for each id (url, title, else place), in the place of the first and
    with the content of the last."""
    text = lambda x, c: F.nullif(empty_if_null(x[c].cast("string")), F.lit(""))
    name = lambda x, i: F.coalesce(text(x, "id"), text(x, "url"), text(x, "title"), F.concat(F.lit(f"{named}-"), i.cast("string")))
    each = F.transform(items, lambda x, i: F.struct(name(x, i).alias("name"), x.alias("item")))
    names = F.array_distinct(F.transform(each, lambda e: e["name"]))
    return F.transform(names, lambda n: F.element_at(F.filter(each, lambda e: e["name"] == n), -1)["item"])


def clean_terms(terms):
    """An array of ``source, target``: trimmed, without empty ones, the first of each source in any case."""
    each = F.transform(terms, lambda t: F.struct(F.trim(empty_if_null(t["source"])).alias("source"), F.trim(empty_if_null(t["target"])).alias("target")))
    each = F.filter(each, lambda t: (t["source"] != "") & (t["target"] != ""))
    keys = F.transform(each, lambda t: F.lower(t["source"]))
    return F.filter(each, lambda t, i: F.array_position(keys, F.lower(t["source"])) == i + 1)


MAPS = ("favorites", "read_status", "notes", "translation_favorites")
LISTS = ("code_items", "resources")
ID_LISTS = ("hidden", "ignored")


def reconcile_snapshots(remote: DataFrame, local: DataFrame) -> DataFrame:
    """T5, whole snapshots: ``user, from`` and their parts. The newer of two wins wholly; a legacy local draft with content merges into the
    remote one: maps entry by entry with the local value first, keywords in any case, glossary terms, item lists by id, url or title with
    the last content, and the ids of hidden and ignored items.

    Snapshots: ``user, updated_at, legacy``, maps ``favorites, read_status, notes, translation_favorites``, ``keywords``, ``glossary``
    (source, target), ``code_items`` and ``resources`` (id, url, title and more), ``hidden`` and ``ignored`` ids. Null parts are empty.
    """
    parts = [*MAPS, "keywords", "glossary", *LISTS, *ID_LISTS]
    kinds = {f.name: f.dataType.simpleString() for f in remote.schema.fields}
    empty = {c: (F.create_map() if kinds[c].startswith("map") else F.array()).cast(kinds[c]) for c in parts}
    r = remote.select("user", F.col("updated_at").alias("r_at"), *[F.coalesce(c, empty[c]).alias(f"r_{c}") for c in parts])
    held = local.select("user", F.col("updated_at").alias("l_at"), F.coalesce("legacy", F.lit(False)).alias("l_legacy"), F.lit(True).alias("l_is"), *[F.coalesce(c, empty[c]).alias(f"l_{c}") for c in parts])
    x = r.withColumn("r_is", F.lit(True)).join(held, "user", "full")
    x = x.withColumns({f"{s}_{c}": F.coalesce(f"{s}_{c}", empty[c]) for s in "rl" for c in parts})
    at = lambda c: F.coalesce(F.unix_millis(F.try_to_timestamp(c)), F.lit(0))
    some = reduce(lambda a, b: a | b, [F.size(f"l_{c}") > 0 for c in parts])
    legacy = F.coalesce("l_legacy", F.lit(False))
    source = F.when(legacy & some, "merged").when(F.col("l_is").isNotNull() & ~legacy & (at("l_at") > at("r_at")), "local").otherwise("remote")

    def merged(c: str):
        a, b = F.col(f"r_{c}"), F.col(f"l_{c}")
        both = F.concat(a, b)
        if c in MAPS:
            return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
        return ci_unique(both) if c == "keywords" else clean_terms(both) if c == "glossary" else keyed_list(both, c) if c in LISTS else F.array_distinct(both)

    x = x.withColumn("from", source)
    pick = lambda c: F.when(F.col("from") == "merged", merged(c)).when(F.col("from") == "local", F.col(f"l_{c}")).otherwise(F.col(f"r_{c}")).alias(c)
    return x.select("user", "from", *[pick(c) for c in parts])


def latest_source_status(runs: DataFrame) -> DataFrame:
    """The last run of each source; on a stream an aggregation in update mode."""
    last = runs.groupBy("name").agg(F.max_by(F.struct("kind", "ok", "count", "run_at"), F.struct("run_at", "seq")).alias("p"))
    return last.select("name", "p.*")


def new_in_batch(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """The records of a batch that the catalogue doesn't have."""
    return new_records(existing, batch)
