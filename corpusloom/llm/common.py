"""Helpers that the corpus operators share: the shared folder, written tables, checked broadcasts, ASCII lower-casing."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import string
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WHITESPACE = r"[\x20\x09-\x0D]+"

#: Bytes a side may have to be broadcast; larger sides go through a shuffled join.
BROADCAST_BYTES = 64 << 20
#: At most so many groups count as hot and are broadcast by ``join_groups``.
HOT_GROUPS = 50_000
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a
    temporary one; a cluster is refused, since its executors would write to their own disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor sees")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corpusloom-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage and survives lost executors.
    The path is added to ``made``, for ``discard``."""
    path = fresh_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files. Spark deletes these when its driver happens to collect garbage, which on a quiet driver
    is after the job, so that a job's disk would be the sum of its steps and not the largest."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)


def discard(spark: SparkSession, made: list[str]) -> None:
    """Delete tables on which no table or result depends any more."""
    for path in made:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    made.clear()


def _bytes(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.array_join(c.cast("array<string>"), "")) + 16 * F.size(c), F.lit(0)) + 16
        return F.coalesce(8 * F.size(c), F.lit(0)) + 16
    return F.lit(8)


def table_bytes(df: DataFrame) -> int:
    """Bytes of a table's rows in memory, as far as their values tell; one cheap job on a stored table."""
    size = F.lit(16)
    for f in df.schema.fields:
        size = size + _bytes(F.col(f"`{f.name}`"), f.dataType)
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df``, a stored table, marked for broadcast if its rows take at most ``limit`` bytes, else for a hash join of shuffled parts: a
    sort would write the texts that it meets to disk once more."""
    return F.broadcast(df) if table_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df.hint("shuffle_hash")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int = HOT_GROUPS) -> DataFrame:
    """``rows`` with the row of ``groups`` that has their ``key``; both are stored tables, ``size`` counts a group's rows.

    A group that holds more than one in ``most`` of all rows is hot. There are at most ``most`` of these, and
    they are broadcast, so that a group's rows never meet in one task; the rest is joined by key.
    """
    total = rows.count()
    hot = F.col(size) > max(1, total // most) if total > 1000 else F.lit(False)
    met = rows.join(F.broadcast(groups.where(hot).withColumn("_hot", F.lit(True))), key, "left")
    done = met.where("_hot").drop("_hot")
    return done.unionByName(met.where("_hot is null").select(rows.columns).join(groups.where(~hot), key).select(done.columns))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is the same on pure ASCII strings, and much faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def tidy(function):
    """A function of batches whose worker gives back what it held when the task is done. Workers outlive their tasks, and would keep
    freed memory beside the next stage's."""

    @functools.wraps(function)
    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
