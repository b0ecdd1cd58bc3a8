"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes its set of shingle hashes; equal sets are one class, whose least id stands for it. The
   sketch is the set's smallest hashes.
2. Inverted lists of the retained values: a pair of similar sets shares many of them, so it also meets in each
   one's rarest values, the prefix. Values that one class alone retains count in the prefix but need no list.
   Classes that meet in a list form candidate groups.
3. A group's sketches are compared in blocks of a bounded number. The sketch of the union, the values below both
   sketches' largest, estimates a pair's similarity. A block returns a forest of the pairs that may reach the
   threshold, never all pairs; their components are much closer groups.
4. Only these groups' full sets are made, and compared in blocks again: exact Jaccard confirms the pairs that the
   sketches leave, and a block returns a forest of its links.
5. Components of the confirmed links and the classes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_side, stored, tidy
from .components import components, forest
from .shingling import Shingler, overlaps

SKETCH = 64
#: Sketches of sets at the threshold share 48 values on average; fewer than this have a chance below one in 100,000.
SHARED = 30
#: In estimates, so many standard deviations below the threshold still go to the exact check.
DEVIATIONS = 4.5
BLOCK_SETS = 768
BLOCK_SHINGLES = 1_000_000
NUMERATOR, DENOMINATOR = 75, 100


def _sketches(sketch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for b in batches:
            n, digest, low = [], [], []
            for s in shingler.text_sets(b.column(1).to_pylist()):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                low.append(s[:sketch].view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int32)
            values = pa.array(np.concatenate(low) if low else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), values)], ["id", "n", "digest", "sketch"])

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for b in batches:
        sets = [s.tobytes() for s in shingler.text_sets(b.column("text").to_pylist())]
        i = b.schema.get_field_index("text")
        yield pa.RecordBatch.from_arrays([*[c for j, c in enumerate(b.columns) if j != i], pa.array(sets, pa.binary())], [*[f.name for f in b.schema if f.name != "text"], "shingles"])


def may_link(low: list[np.ndarray], i: np.ndarray, j: np.ndarray, sketch: int = SKETCH) -> np.ndarray:
    """Which of the pairs of sets ``i`` by sets ``j`` may reach the threshold, by their sketches."""
    top = np.array([s[-1] if len(s) == sketch else np.uint64(2**64 - 1) for s in low], np.uint64)
    # Of each sketch, how many values lie below each other sketch's largest.
    below = np.array([np.searchsorted(s, top, side="right") for s in low], np.int32)
    shared = overlaps([low[x] for x in i], [low[x] for x in j]) if not np.array_equal(i, j) else overlaps([low[x] for x in i])
    size = below[np.ix_(i, j)] + below[np.ix_(j, i)].T
    union = size - shared
    t = NUMERATOR / DENOMINATOR
    whole = (top[i][:, None] == np.uint64(2**64 - 1)) & (top[j][None, :] == np.uint64(2**64 - 1))
    slack = np.where(whole, 0.0, DEVIATIONS * np.sqrt(t * (1 - t) / np.maximum(union, 1)))
    return (shared >= (t - slack) * union) & (i[:, None] != j[None, :])


def near_forest(ids: np.ndarray, low: list[np.ndarray], left: np.ndarray, right: np.ndarray, sketch: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the pairs, between the ``left`` and the ``right`` of the sketches (boolean masks), that may be linked."""
    i, j = np.nonzero(left)[0], np.nonzero(right)[0]
    a, b = np.nonzero(may_link(low, i, j, sketch))
    return forest(ids[i[a]], ids[j[b]])


def links(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, sketch: int = SKETCH) -> tuple[np.ndarray, np.ndarray]:
    """Confirmed links between the ``left`` and the ``right`` of the sets (boolean masks), as a forest of stars.

    Pairs on one side only are looked at where a set is on both sides.
    """
    i, j = np.nonzero(left)[0], np.nonzero(right)[0]
    near = may_link([s[:sketch] for s in sets], i, j, sketch) if len(sets) > 6 else i[:, None] != j[None, :]
    rows, cols = np.nonzero(near.any(1))[0], np.nonzero(near.any(0))[0]
    if not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    exact = overlaps([sets[i[r]] for r in rows], [sets[j[c]] for c in cols])
    n = np.array([len(s) for s in sets])
    both = n[i[rows]][:, None] + n[j[cols]][None, :] - exact
    linked = near[np.ix_(rows, cols)] & (DENOMINATOR * exact >= NUMERATOR * both) & (exact > 0)
    a, b = np.nonzero(linked)
    return forest(ids[i[rows[a]]], ids[j[cols[b]]])


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of sorted batches, one table for each key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.nonzero(keys[1:] != keys[:-1])[0] + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != keys[x]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def _compare(sketch: int, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, "key"):
            ids = t.column("id").to_numpy()
            if full:
                sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
            else:
                lists = t.column("sketch").combine_chunks()
                sets = np.split(lists.flatten().to_numpy().view(np.uint64), np.cumsum(lists.value_lengths().to_numpy())[:-1])
            block, first, second = (t.column(c).to_numpy() for c in ("block", "first", "second"))
            u, v = (links if full else near_forest)(ids, sets, block == first, block == second, sketch)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def group_blocks(members: DataFrame, weight: str, most: int, made: list[str]) -> DataFrame:
    """``(group, blocks)``: into how many blocks a group's members go, by their number and their weight."""
    sums = members.groupBy("group").agg(F.count(F.lit(1)).alias("sets"), F.sum(weight).alias("weight"))
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("weight") / most)).cast("long")
    return small_side(stored(sums.select("group", blocks.alias("blocks")), "group-sizes", made))


def in_blocks(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of ``members(group, id, ..)`` once for each pair of blocks in which they are compared.

    ``sizes(group, blocks)``. A group of one block is compared with itself; a larger one gets a key for each
    pair of its blocks. Adds ``block, first, second, key``.
    """
    m = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    m = m.withColumn("first", F.least("block", "other")).withColumn("second", F.greatest("block", "other"))
    return m.drop("other", "blocks").withColumn("key", F.xxhash64("group", "first", "second"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: int = SKETCH) -> DataFrame:
    """``id_col, n_shingles, component_id, kept``: one row per input row.

    Sets are distinct 5-word shingles of A-Z lower-cased words between ASCII white space, the whole sequence for
    texts of fewer words. Documents with 100 * intersection >= 75 * union are linked; ``component_id`` is the
    least id that links reach, and the row whose id it is is kept. Null texts and texts without words have no
    shingles, are linked with nothing and are kept. Ids are integers. Rows that repeat an id are one document:
    they share their component. A row without an id is linked with nothing: its component is null, and it is
    kept. Candidates come from sketches: a pair just at the threshold is missed with a chance below one in 10,000, sets of at most
    40 shingles never. Further columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketched = stored(rows.mapInArrow(tidy(_sketches(sketch)), "id long, n long, digest binary, sketch array<long>"), "sketches")
    narrow = sketched.where("n > 0 and id is not null").select("id", "n", "digest")
    made: list[str] = []
    classes = stored(narrow.groupBy("digest", "n").agg(F.min("id").alias("rep")), "classes", made)
    own = narrow.join(classes, ["digest", "n"])
    same = own.where("id <> rep").select(F.col("id").alias("u"), F.col("rep").alias("v"))

    reps = sketched.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"]).dropDuplicates(["id", "digest"])
    postings = reps.select("id", "n", F.explode("sketch").alias("value"))
    shared = postings.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    met = postings.join(shared, "value").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("lists"))
    # The prefix: with m values of which two similar sets share at least t, the m - t + 1 rarest.
    m = F.least("n", F.lit(sketch))
    t = F.least(F.lit(max(1, math.floor(SHARED * sketch / SKETCH))), F.ceil(F.col("n") * NUMERATOR / DENOMINATOR))
    quota = F.greatest(F.lit(0), m - t + 1 - (m - F.size("lists"))).cast("int")
    prefix = stored(met.select("id", F.explode(F.slice("lists", F.lit(1), quota)).alias("l")).select("id", F.col("l.value").alias("value")), "prefixes", made)
    hubs = prefix.groupBy("value").agg(F.min("id").alias("hub"), F.max("id").alias("far")).where("hub <> far")
    star = prefix.join(hubs, "value").where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    met_in = components(star).select(F.col("node").alias("id"), F.col("label").alias("group"))
    # An id that repeats with another text has a sketch for each.
    low = stored(met_in.join(reps.select("id", "n", "sketch"), "id"), "candidate-sketches", made)
    placed = in_blocks(low, group_blocks(low, "n", 1 << 62, made)).repartition("key").sortWithinPartitions("key")
    near = stored(placed.select("key", "id", "block", "first", "second", "sketch").mapInArrow(tidy(_compare(sketch, False)), "u long, v long"), "near-pairs", made)

    close = components(near).select(F.col("node").alias("id"), F.col("label").alias("group"))
    members = stored(close.join(low.select("id", "n"), "id"), "members", made)
    texts = rows.join(small_side(members.select("id", "group").distinct()), "id").mapInArrow(tidy(_full_sets), "id long, group long, shingles binary")
    placed = in_blocks(texts, group_blocks(members, "n", BLOCK_SHINGLES, made)).repartition("key").sortWithinPartitions("key")
    confirmed = stored(placed.select("key", "id", "block", "first", "second", "shingles").mapInArrow(tidy(_compare(sketch, True)), "u long, v long"), "links", made)

    labels = components(confirmed.union(same))
    discard(docs.sparkSession, made)
    out = sketched.select("id", "n").join(labels, F.col("id") == F.col("node"), "left")
    component = F.coalesce("label", "id")
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_shingles"),
        component.cast(docs.schema[id_col].dataType).alias("component_id"),
        component.eqNullSafe(F.col("id")).alias("kept"),
    )
