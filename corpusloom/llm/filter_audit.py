"""Filter interaction audit: what each filter removes in every order, and its Shapley share, from one lattice of subsets.

A state of the lattice is the set of filters already applied, an edge applies one more. ``forward`` counts the orders that
reach a state, ``backward`` those that leave it; both are sums over edges, level by level. A removal on an edge happens in
``forward(from) * backward(to)`` orders, which gives the Shapley sums, and the steps of an order are the edges on its path.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITESPACE, discard, stored


def lattice(n: int) -> list[tuple[int, int, int, int]]:
    """Edges ``(state, filter, forward, backward)`` of the subsets of ``n`` filters, as bits."""
    full = (1 << n) - 1
    forward, backward = {0: 1}, {full: 1}
    states = sorted(range(1 << n), key=int.bit_count)
    for s in states[1:]:
        forward[s] = sum(forward[s ^ (1 << f)] for f in range(n) if s >> f & 1)
    for s in reversed(states[:-1]):
        backward[s] = sum(backward[s | (1 << f)] for f in range(n) if not s >> f & 1)
    return [(s, f, forward[s], backward[s | (1 << f)]) for s in states for f in range(n) if not s >> f & 1]


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions that a text decides alone, by filter."""
    words = F.filter(F.split(text, WHITESPACE), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, made: list[str], conditions=text_conditions, copies: str = "E") -> tuple[list[str], DataFrame]:
    """Filters, and per part and set of failed filters the documents: part, failed (bits), n, good, toxic.

    Texts shrink to 128 bits of a hash in the scan. Copies are never brought together: each group keeps, per part, its counts
    and those of its least doc_id, so a group of any size is a row per part. Labels meet narrow rows by doc_id.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    alone = conditions(text)
    names = [*alone, copies]
    failed = reduce(lambda a, b: a + b, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(alone.values())])
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("hash"),
        failed.alias("failed"),
    )
    # repeated rows meet here, so a doc_id has one row per part and text
    rows = stored(rows.groupBy("doc_id", "part", "hash", "failed").agg(F.count("*").alias("n")), "audited", made)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    met = rows.where("doc_id is not null").join(marks, "doc_id", "left").unionByName(rows.where("doc_id is null"), allowMissingColumns=True)
    n, good, toxic = F.col("n"), F.when(F.col("good"), F.col("n")).otherwise(0), F.when(F.col("toxic"), F.col("n")).otherwise(0)
    one = F.struct(F.col("doc_id"), n.alias("n"), good.alias("good"), toxic.alias("toxic"))
    groups = met.groupBy("hash", "failed", "part", F.col("doc_id").isNull().alias("no_id")).agg(
        F.sum(n).alias("n"), F.sum(good).alias("good"), F.sum(toxic).alias("toxic"), F.min(F.when(F.col("doc_id").isNotNull(), one)).alias("first")
    )
    least = groups.groupBy("hash").agg(F.min("first.doc_id").alias("least"))
    groups = groups.join(least, "hash")
    is_first = F.col("first.doc_id") == F.col("least")
    state = F.when(F.col("no_id"), F.array(F.struct(F.col("failed"), "n", "good", "toxic"))).otherwise(
        F.array(
            F.struct(F.col("failed"), *[F.when(is_first, F.col(f"first.{c}")).otherwise(0).alias(c) for c in ("n", "good", "toxic")]),
            F.struct(
                (F.col("failed") + (1 << len(alone))).alias("failed"),
                *[(F.col(c) - F.when(is_first, F.col(f"first.{c}")).otherwise(0)).alias(c) for c in ("n", "good", "toxic")],
            ),
        )
    )
    counts = groups.select("part", F.inline(state)).groupBy("part", "failed").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    return names, counts


def filter_audit(docs: DataFrame, labels: DataFrame, conditions=text_conditions, copies: str = "E") -> DataFrame:
    """One row per part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``docs`` has doc_id, text and lang; a null text is empty, a null lang the part ``''``. Every row counts, repeated ones too. A
    document is a copy if a row with a smaller doc_id has the same text; a row without doc_id neither is one nor makes one, and has
    no label. Of repeated labels any 1 counts. Extra columns are ignored, whatever their names. An empty table has no parts and so
    no rows. Letters of the filters are the names of ``conditions``, then ``copies``.
    """
    made: list[str] = []
    names, counts = failure_counts(docs, labels, made, conditions, copies)
    fields = ("state", "filter", "bit", "forward", "backward")
    edges = [(s, f, 1 << f, forward, backward) for s, f, forward, backward in lattice(len(names))]
    at = counts.select("*", F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(fields, e)]) for e in edges])))
    failed, bit = F.col("failed"), F.col("bit")
    fails, earlier = failed.bitwiseAND(bit) != 0, failed.bitwiseAND(F.col("state")) != 0
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0)).cast("long")
    steps = at.groupBy("part", "state", "filter", "forward", "backward").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", failed == bit).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"),
    )
    steps = stored(steps, "audit-edges")
    discard(docs.sparkSession, made)
    shares = steps.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("forward") * F.col("backward")).cast("long").alias("shapley"))
    path = [
        ("".join(names[f] for f in order), step + 1, sum(1 << g for g in order[:step]), f)
        for order in permutations(range(len(names)))
        for step, f in enumerate(order)
    ]
    orders = docs.sparkSession.createDataFrame(path, "filter_order string, step int, state int, filter int")
    return (
        steps.join(F.broadcast(orders), ["state", "filter"])
        .join(shares, ["part", "filter"])
        .select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    )
