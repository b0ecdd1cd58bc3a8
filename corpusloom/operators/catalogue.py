"""A stored catalogue that daily batches are merged into without moving it.

Records are bucketed by id and cut into slices, parts of a snapshot; title keys are a log, bucketed by key. A batch is
shuffled to the buckets of both, the stored side stays where it is: the log gives the batch's targets, the records those that
the batch touches, and these alone are folded with it. Of the slices, only touched ones are written anew. Everything is
committed at once, with the number of the batch, so a batch that comes again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import empty_if_null, history_key, title_key
from ..sources.snapshots import Buckets, Snapshots, part_of
from .merge import UNIONS, fold_targets, new_records, with_targets

#: The log of title keys is written anew when it has so many parts.
LOG_PARTS = 32


class Catalogue:
    """``root``: a folder that all executors see. ``buckets`` and ``slices`` are fixed by the first version: a task of a merge has a
    bucket of all touched slices, a file a bucket of one."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, slices: int = 16) -> None:
        self.spark, self.snapshots = spark, Snapshots(spark, root)
        about = self.snapshots.state()["about"]
        self.buckets, self.slices = about.get("buckets", buckets), about.get("slices", slices)
        self._records = Buckets(self.snapshots, "records", "slice", "id", self.buckets)
        self._titles = Buckets(self.snapshots, "titles", "part", "_key", self.buckets)

    # -- reading

    def _schema(self, state: dict) -> T.StructType:
        return T.StructType.fromJson(state["about"]["schema"])

    def records(self, state: dict | None = None) -> DataFrame:
        """The records of a version, the newest if none is given, with their ``slice``."""
        state = state or self.snapshots.state()
        schema = self._schema(state)
        return self._records.table(state, T.StructType([*schema.fields, T.StructField("slice", T.IntegerType())]))

    def papers(self, state: dict | None = None) -> DataFrame:
        return self.records(state).drop("slice")

    def title_log(self, state: dict) -> DataFrame:
        id_type = self._schema(state)["id"].dataType.simpleString()
        fields = T._parse_datatype_string(f"_key string, id {id_type}, seq long, at long, present boolean, part int")
        return self._titles.table(state, fields)

    def known(self, state: dict, keys: DataFrame) -> DataFrame:
        """``(_key, _old)``: of ``keys(_key)``, those that the catalogue has, with the last record's id. The log isn't moved."""
        held = self.title_log(state).join(keys, "_key", "left_semi").groupBy("_key", "id").agg(F.max_by(F.struct("seq", "present"), "at").alias("p"))
        return held.where("p.present").groupBy("_key").agg(F.max_by("id", "p.seq").alias("_old"))

    # -- writing

    def create(self, papers: DataFrame) -> dict:
        """The first version: of records with one id the last by ``seq``, with its lists within their limits; those without id go."""
        if self.snapshots.versions():
            raise ValueError(f"{self.snapshots.root} holds a catalogue")
        last = papers.where(empty_if_null(F.col("id").cast("string")) != "").groupBy("id").agg(F.max_by(F.struct(*papers.columns), "seq").alias("p")).select("p.*")
        last = last.withColumns({c: F.slice(F.array_distinct(c), 1, cap) for c, cap in UNIONS.items() if cap and c in papers.columns})
        state = self.snapshots.state()
        state["about"] = {"schema": papers.schema.jsonValue(), "buckets": self.buckets, "slices": self.slices}
        state["tables"] = {"records": self._stage_records(last)}
        # the titles of the records as they are stored, so that ``papers`` isn't computed a second time
        stored = self.spark.read.schema(papers.schema).parquet(*state["tables"]["records"].values()) if state["tables"]["records"] else last
        log = stored.select(title_key(F.col("title")).alias("_key"), "id", F.col("seq").cast("long"), F.lit(1).cast("long").alias("at"), F.lit(True).alias("present")).where("_key <> ''")
        state["tables"]["titles"] = self._stage_titles(log, 1)
        return self.snapshots.commit(state)

    def _stage_records(self, records: DataFrame) -> dict[str, str]:
        return self._records.stage(records.withColumn("slice", part_of("id", self.slices)).repartition(self.buckets, "id"))

    def _stage_titles(self, log: DataFrame, version: int) -> dict[str, str]:
        return self._titles.stage(log.withColumn("part", F.lit(version)).repartition(self.buckets, "_key"))

    def rewritten(self, state: dict, folded: DataFrame, touched: list[int]) -> DataFrame:
        """The rows of the touched slices after a merge: the stored ones, and ``folded`` in place of those that it has. ``folded``
        is shuffled to the stored buckets, which stay."""
        columns = self._schema(state).fieldNames()
        mine = folded.select("id", F.struct(*columns).alias("_new"))
        met = self.records(state).where(F.col("slice").isin(touched)).join(mine, "id", "full")
        pick = lambda c: F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c)
        return met.select("id", *[pick(c) for c in columns if c != "id"]).select(*columns, part_of("id", self.slices).alias("slice"))

    def merge(self, incoming: DataFrame, batch: tuple[str, int] | None = None) -> dict:
        """J1 of ``incoming`` into the catalogue, committed as a new version, whose record is returned.

        The result is that of ``merge_records(papers, incoming)`` without a limit; rows of ``incoming`` that have neither an id nor a
        known title are left out. ``batch`` (a stream's name, a number) is committed with it: a batch whose number isn't above
        the stream's last one is skipped. What an interrupted merge wrote stays unread.
        """
        state = self.snapshots.state()
        if batch and state["batches"].get(batch[0], -1) >= batch[1]:
            return state
        schema, version = self._schema(state), state["version"] + 1
        work = self.snapshots.new_folder("work")

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{work}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{work}/{name}")

        given = kept(incoming, "incoming")
        keys = given.select(title_key(F.col("title")).alias("_key")).where("_key <> ''").distinct()
        rows = kept(with_targets(given, self.known(state, keys)).where(empty_if_null(F.col("target").cast("string")) != ""), "targets")
        targets = rows.select(F.col("target").alias("id")).distinct()
        touched = sorted(r[0] for r in targets.select(part_of("id", self.slices)).distinct().collect())  # at most ``slices`` numbers
        if touched:
            stored = self.records(state).where(F.col("slice").isin(touched)).join(targets, "id", "left_semi").select(*schema.fieldNames())
            old = kept(stored, "old")
            folded = kept(fold_targets(old, rows).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), "folded")
            slices = self._records.stage(self.rewritten(state, folded, touched))
            tables = {"records": {**state["tables"].get("records", {}), **slices}, "titles": self._log(state, old, folded, version)}
            state = {**state, "tables": tables}
        if batch:
            state = {**state, "batches": {**state["batches"], batch[0]: batch[1]}}
        state = self.snapshots.commit(state)
        self._delete(work)
        return state

    def _log(self, state: dict, old: DataFrame, folded: DataFrame, version: int) -> dict[str, str]:
        """The title log's parts after a merge: one more part, with the keys that records have gained or lost."""
        named = lambda df, c: df.select(title_key(F.col("title")).alias("_key"), "id", F.col("seq").cast("long").alias(c)).where("_key <> ''")
        both = named(old, "_before").join(named(folded, "_after"), ["_key", "id"], "full").where("_before is null or _after is null or _before <> _after")
        log = both.select("_key", "id", F.coalesce("_after", "_before").alias("seq"), F.lit(version).cast("long").alias("at"), F.col("_after").isNotNull().alias("present"))
        parts = state["tables"].get("titles", {})
        if len(parts) >= LOG_PARTS:
            whole = self.title_log(state).select(log.columns).unionByName(log).groupBy("_key", "id").agg(F.max_by(F.struct("seq", "at", "present"), "at").alias("p"))
            return self._stage_titles(whole.select("_key", "id", "p.*").where("present"), version)
        return {**parts, **self._stage_titles(log, version)}

    def _delete(self, folder: str) -> None:
        path = self.snapshots._path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    # -- what builds on it

    def new_records(self, incoming: DataFrame) -> DataFrame:
        """J2 against the stored catalogue, of which only ids in the batch's slices and the log are read, and neither is moved."""
        state = self.snapshots.state()
        ids = self.records(state).join(incoming.select("id").distinct(), "id", "left_semi").select("id", F.lit("").alias("title"))
        key = title_key(F.col("title"))
        titles = self.known(state, incoming.select(key.alias("_key")).where("_key <> ''").distinct())
        return new_records(ids, incoming).withColumn("_key", key).join(titles, "_key", "left_anti").select(*incoming.columns)

    def merge_stream(self, stream: DataFrame, name: str):
        """A writer that merges each batch of ``stream``, once. ``name`` names the stream in commits; its checkpoint numbers the
        batches, so a new checkpoint needs a new name."""
        return stream.writeStream.foreachBatch(lambda df, number: self.merge(df, (name, number)))


class History:
    """The union of all months (W3), bucketed by DOI or id: the catalogue of the day meets it without moving it."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.snapshots = spark, Snapshots(spark, root)
        self.buckets = self.snapshots.state()["about"].get("buckets", buckets)
        self._rows = Buckets(self.snapshots, "history", "part", "_key", self.buckets)

    def create(self, shards: DataFrame) -> dict:
        """Store the shards, one row for each key: the first with an abstract by ``seq``, else the first."""
        keyed = shards.withColumn("_key", history_key(F.col("doi"), F.col("id")))
        order = F.struct(F.when(empty_if_null(F.col("abstract")) != "", 0).otherwise(1), "seq")
        rows = keyed.groupBy("_key").agg(F.min_by(F.struct(*shards.columns), order).alias("p")).select("p.*", "_key", F.lit(0).alias("part"))
        state = self.snapshots.state()
        state["about"] = {"schema": shards.schema.jsonValue(), "buckets": self.buckets}
        state["tables"] = {"history": self._rows.stage(rows.repartition(self.buckets, "_key"))}
        return self.snapshots.commit(state)

    def union(self, catalogue: DataFrame, min_year: int = 2001) -> DataFrame:
        """``history_union(catalogue, shards)``, with only the catalogue shuffled."""
        state = self.snapshots.state()
        schema = T.StructType.fromJson(state["about"]["schema"])
        stored = self._rows.table(state, T.StructType([*schema.fields, *T._parse_datatype_string("_key string, part int").fields]))
        year = F.substring("published", 1, 4)
        mine = catalogue.where(year.rlike(r"^\d{4}$") & (year.try_cast("int") >= min_year)).withColumn("_key", history_key(F.col("doi"), F.col("id")))
        mine = mine.groupBy("_key").agg(F.max_by(F.struct(*schema.fieldNames()), "seq").alias("_mine"))
        met = stored.join(mine, "_key", "full")
        has = lambda c: empty_if_null(c) != ""
        take = F.col("_mine").isNotNull() & (has(F.col("_mine.abstract")) | ~has(F.col("abstract")))
        return met.select(*[F.when(take, F.col("_mine")[c]).otherwise(F.col(c)).alias(c) for c in schema.fieldNames()])
