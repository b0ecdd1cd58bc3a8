"""Connected components of edge tables, in rounds of joins on narrow rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, tidy

ROUNDS = 60


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the edges: ``(node, least node)``, the least ones themselves left out."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(before, label):
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each run of edges becomes a forest of stars, which connects the same nodes."""

    def star(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in parts]) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in forest(u, v)], ["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n > 500_000:
            held = [star(held)]
            if held[0].num_rows > 400_000:
                yield held.pop()
            n = sum(b.num_rows for b in held)
    if n:
        yield star(held)


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``edges(u, v)`` (longs), ``label`` the least node that can be reached.

    Alternating large-star and small-star steps; a hot node costs a join key, which adaptive execution splits,
    and no step has more rows than the edges. Each round is written to the shared folder, and the one before it
    deleted; what is returned is a stored table.
    """
    spark, made, old = edges.sparkSession, [], []
    first = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(first.mapInArrow(tidy(_contract), "u long, v long").distinct(), "edges", made)
    before = None
    for _ in range(ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # now u > v everywhere: each node's smaller neighbours, and the node itself, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        made, old = [], made
        now = stored(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges", made)
        discard(spark, old)
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError("the components didn't settle")
    stars = now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
    labels = stored(stars.union(stars.select("label", "label").distinct()), "labels")
    discard(spark, made)
    return labels
