"""The folder that all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors see; a local session (tests) may do without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that every executor sees")
        folder = f"file://{tempfile.mkdtemp(prefix='corpusloom-')}"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows, and bytes of their JSON, of a table that is broadcast at most.
SMALL_ROWS, SMALL_BYTES = 100_000, 32 << 20


def small(df: DataFrame, rows: int = SMALL_ROWS, size: int = SMALL_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most so many rows and bytes; beyond, Spark picks the join."""
    whole = F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))) if df.columns else F.lit(0)
    n, found = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(whole, F.lit(0))).first()
    return F.broadcast(df) if n <= rows and found <= size else df


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to that folder and read back: computed once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
