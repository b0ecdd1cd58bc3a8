"""Exact deduplication by two passes over a Bloom filter, with DataFrame functions only.

Every text is hashed once into a narrow table. A hash chooses a bucket of the filter, a bitmap of 32,768 bits
whose number follows the row count, and two bits in it. Pass 1 counts these choices as single numbers, with
partial sums in each task, and sets the bits of those made more than once: what moves is eight bytes for every
different choice of a task, no id and no text. Pass 2 tests each row: one of whose two bits is missing is
certainly unique and passes straight through. Only the rest, true repeats and the few false positives, meet by
their SHA-256. A filter larger than what may be broadcast is probed in turns, each with a part of the buckets. The
hashes are written in a folder for each turn, so that all turns together read them once and no row shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, fresh_path, join_groups, stored

BITS_PER_ROW = 8
BUCKET_BITS = 32_768
#: Bytes of the filter that a turn broadcasts.
FILTER_BYTES = 64 << 20


def repeated_bits(choices: DataFrame) -> DataFrame:
    """``(bucket, bits)``: the bitmaps of the buckets in which ``choices.choice`` occurs more than once."""
    twice = choices.groupBy("choice").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    both = F.array(F.expr("shiftright(choice, 15) & 32767"), F.expr("choice & 32767"))
    return twice.select(F.shiftright("choice", 30).alias("bucket"), F.explode(both).alias("bit")).groupBy("bucket").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))


def _is_set(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1


def _by_turn(df: DataFrame, turns: int, made: list[str], bucket: Column | None = None) -> DataFrame:
    """``df`` written in a folder for each turn of the filter, so that a turn reads its own part alone. No row moves for it."""
    path = fresh_path(df.sparkSession, "filter-turns")
    made.append(path)
    turn = F.pmod(F.shiftright("choice", 30) if bucket is None else bucket, F.lit(turns)).cast("int")
    df.withColumn("turn", turn).write.option("compression", "zstd").partitionBy("turn").parquet(path)
    return df.sparkSession.read.schema(df.withColumn("turn", turn).schema).parquet(path)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id is kept.
    A null text counts as empty, and empty texts are equal to each other. Rows that repeat both id and text
    are the same document: they share the decision and each counts in ``group_size``. A null id never wins
    over another id. An empty table gives an empty result; further columns of ``docs`` are ignored.
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    made: list[str] = []
    buckets = max(1, -(-docs.count() * BITS_PER_ROW // BUCKET_BITS))
    turns = max(1, -(-buckets * (BUCKET_BITS // 8) // filter_bytes))
    choice = F.shiftleft(F.pmod(F.xxhash64("sha"), F.lit(buckets)), 30).bitwiseOR(F.xxhash64("sha", F.lit(1)).bitwiseAND((1 << 30) - 1))
    rows = docs.select(F.col(id_col).alias("id"), F.unhex(F.sha2(norm, 256)).alias("sha")).select("id", "sha", choice.alias("choice"))
    rows = _by_turn(rows, turns, made)
    bits = _by_turn(repeated_bits(rows), turns, made, F.col("bucket"))

    maybe = F.coalesce(_is_set(F.col("bits"), F.expr("shiftright(choice, 15) & 32767")) & _is_set(F.col("bits"), F.expr("choice & 32767")), F.lit(False))
    tested = []
    for turn in range(turns):
        mine = rows.where(F.col("turn") == turn).withColumn("bucket", F.shiftright("choice", 30))
        mine = mine.join(F.broadcast(bits.where(F.col("turn") == turn).select("bucket", "bits")), "bucket", "left")
        tested.append(stored(mine.select("id", "sha", maybe.alias("maybe")), "bloom-tested"))
    tested = reduce(DataFrame.union, tested)
    discard(docs.sparkSession, made)

    again = tested.where("maybe").select("id", "sha")
    groups = stored(again.groupBy("sha").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "equal-texts")
    met = join_groups(again, groups, "sha", "group_size")
    alone = tested.where("not maybe").select("id", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return alone.unionByName(met).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
