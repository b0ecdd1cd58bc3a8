"""Token counts with a digest cache.

Each text is keyed by the SHA-256 of its content and of the tokenizer's vocabulary file. Keys that the cache
table holds are joined to their stored counts; of the rest, each distinct content is encoded once and its
count is appended to the cache.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, tokenizer_digest
from .common import fresh_path, stored

CACHE_SCHEMA = "digest string, n_tokens long, tokenizer string"


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        last = None
        for b in batches:
            out = []
            for digest, text in zip(b.column("digest").to_pylist(), b.column("text").to_pylist()):
                if digest != last:  # rows that repeat id and content follow each other
                    out.append((digest, len(tokens.ids(text)) // 4))
                    last = digest
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["digest", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    over: int = 1024,
    normalise: Callable[[Column], Column] = lambda c: c,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit``: one row per input row, in counts of the whole text.

    ``normalise`` is applied before digest and encoding (by default nothing). A null text counts as empty:
    0 bytes, 0 tokens. Repeated rows and repeated ids each get their row; equal texts are encoded once. No
    begin, end or added special tokens; special strings inside a text are handled as the library does by
    default. ``cache_path`` names a Parquet table, partitioned by tokenizer, to read and append to; without one a new
    table is made.
    Appending twice after a failure is harmless: a digest's rows in the cache are equal, and one is read.
    Null ids are kept. Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer_path)
    cache_path = cache_path or fresh_path(spark, "token-counts")
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    keyed = stored(docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "text-digests")

    # The empty write makes the table, so that it can be read even where it is new.
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    def cache() -> DataFrame:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)

    # One row of each distinct missing content is found by narrow keys; only then does the text move.
    first = keyed.groupBy("digest").agg(F.min("id").alias("first")).join(cache(), "digest", "left_anti")
    whole = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("key"), text.alias("text"))
    misses = whole.join(first, (F.col("key") == F.col("digest")) & F.col("id").eqNullSafe(F.col("first"))).select("digest", "text")
    counted = misses.mapInArrow(_counts(tokenizer_path), "digest string, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)

    # Of a large cache, only the counts of these texts are brought together.
    counts = cache().select("digest", "n_tokens").join(keyed.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return keyed.join(counts, "digest", "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit")
    )
