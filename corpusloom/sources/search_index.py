"""A stored index for substring search (S18 with C6): posting lists of trigrams by year, and the texts that decide.

The records of a year are dealt into blocks. A posting is a trigram with the ids of one block that have it, so no list is longer than
a block. Postings and records are partitioned by year; postings are sorted by trigram, so that a search reads the row groups of its
own trigrams in the years that it asks for, and then only records of blocks with candidates. Token lists wouldn't do: a search
term may begin and end inside words.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.text import fold
from ..storage import small
from .sinks import search_index
from .snapshots import Snapshots

#: Records of a block, about: as many as a list may have.
BLOCK = 4096


#: Bits of a code point, of which a trigram has three.
POINT = 21


def _grams(text: str) -> np.ndarray:
    """The distinct trigrams of a text, as numbers."""
    points = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64)
    return np.unique((points[:-2] << 2 * POINT) | (points[1:-1] << POINT) | points[2:])


def _spelled(grams: np.ndarray) -> list[str]:
    points = np.stack([grams >> 2 * POINT, (grams >> POINT) & ((1 << POINT) - 1), grams & ((1 << POINT) - 1)], 1)
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + 3] for i in range(0, len(text), 3)]


def _postings(schema: pa.Schema):
    """Posting lists of blocks whose records follow each other; a task holds the numbers of one block at a time."""

    def lists(year: str, block: int, ids: list, grams: list[np.ndarray]) -> pa.RecordBatch:
        each, row = np.concatenate(grams), np.repeat(np.arange(len(ids)), [len(g) for g in grams])
        order = np.argsort(each, kind="stable")  # records come by id, so lists are sorted
        each, row = each[order], row[order]
        first = np.flatnonzero(np.r_[True, each[1:] != each[:-1]]) if len(each) else np.zeros(0, np.int64)
        held = pa.array(ids, schema.field("ids").type.value_type).take(pa.array(row))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(each)], pa.int32()), held).cast(schema.field("ids").type)
        n = len(first)
        columns = [pa.array([year] * n, pa.string()), pa.array([block] * n, pa.int32()), pa.array(_spelled(each[first]), pa.string()), lists]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                yield from zip(*[c.to_pylist() for c in b.slice(at, 64).columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (year, block), mine in groupby(rows(batches), key=lambda r: r[:2]):
            ids, grams = [], []
            for _, _, i, text in mine:
                ids.append(i)
                grams.append(_grams(text))
            yield lists(year, block, ids, grams)

    return run


def write_search_index(papers: DataFrame, root: str, block: int = BLOCK) -> dict:
    """Index ``papers`` (columns as in ``search_index``); years that they have are replaced, both tables at once."""
    spark = papers.sparkSession
    snapshots = Snapshots(spark, root)
    state = snapshots.state()
    rows = search_index(papers)
    blocks = rows.groupBy("year").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    # a year is dealt to its blocks, and a block to one task; years are few rows
    dealt = rows.join(small(blocks), "year").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks").repartition("year", "block")
    parts = snapshots.stage(dealt.withColumn("part", F.col("year")).sortWithinPartitions("part", "block", "id"), "records", "part")
    # the stored records, which are folded by now, in the blocks of their tasks
    stored = spark.read.schema(dealt.schema).parquet(*parts.values()) if parts else dealt
    sorted_blocks = stored.select("year", "block", "id", "search_text").repartition("year", "block").sortWithinPartitions("year", "block", "id")  # no block in two tasks
    of = {f.name: f.dataType for f in stored.schema.fields}
    kinds = StructType().add("year", of["year"]).add("block", of["block"]).add("gram", StringType()).add("ids", ArrayType(of["id"]))
    postings = sorted_blocks.mapInArrow(_postings(to_arrow_schema(kinds)), kinds)
    staged = {"records": parts, "postings": snapshots.stage(postings.withColumn("part", F.col("year")).sortWithinPartitions("part", "gram"), "postings", "part")}
    tables = {t: {**state["tables"].get(t, {}), **parts} for t, parts in staged.items()}
    about = {"records": dealt.schema.jsonValue(), "postings": postings.schema.jsonValue()}
    return snapshots.commit({**state, "tables": tables, "about": about})


class SearchIndex:
    """A version of an index. ``postings`` and ``records`` open the folders of the years that are asked for, and no others."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.snapshots = Snapshots(spark, root)
        self.state = self.snapshots.state()

    def _table(self, name: str, years: list[str] | None) -> DataFrame:
        return self.snapshots.read(name, StructType.fromJson(self.state["about"][name]), years, self.state["version"])

    def candidates(self, grams: list[str], years: list[str] | None = None) -> DataFrame:
        """``(year, block, id)`` of records that have all trigrams."""
        lists = self._table("postings", years).where(F.col("gram").isin(grams)).groupBy("year", "block").agg(F.collect_list("ids").alias("lists"))
        both = F.aggregate(F.slice("lists", 2, len(grams)), F.get("lists", F.lit(0)), lambda a, b: F.array_intersect(a, b))
        return lists.where(F.size("lists") == len(grams)).select("year", "block", F.explode(both).alias("id"))

    def search(self, query: str, years: list[str] | None = None) -> DataFrame:
        """C6 over the index: records whose text holds all words of the query as substrings, in any case. Words of one or two characters
        only decide among what the others leave; a query of such words reads all records of its years."""
        spark = self.snapshots.spark
        words = [w for w in spark.range(1).select(F.split(F.trim(fold(F.lit(query))), r"[\s\p{Z}]+").alias("w")).first()["w"] if w]
        grams = sorted({w[i : i + 3] for w in words for i in range(len(w) - 2)})
        rows = self._table("records", years)
        if grams:
            rows = rows.join(small(self.candidates(grams, years)), ["year", "block", "id"], "left_semi")
        for w in words:
            rows = rows.where(F.contains("search_text", F.lit(w)))
        return rows.drop("block", "blocks")
