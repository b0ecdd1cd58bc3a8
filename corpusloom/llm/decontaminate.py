"""Benchmark decontamination as a prefix-filtered set join, with DataFrame functions only.

A window of an item is a set of word shingles. A text that contains the window contains all of its
shingles, so under any global order the first shingle of the window, its prefix, is enough to find it; the
order is rarity over the whole corpus, so that the prefix is the shingle with the fewest false candidates.
The shingle's place in the window fixes where the window must start in the document (positional bound) and
how many words must follow (length bound). There, the words of every shingle of the window must be those of
the document: a join on document and place, since the scan has kept all places of shingles that items have.

The corpus is read once for each block of windows, nearly always one, and each size of shingle: items of four
words and more share one size, and items of one, two or three words add a scan for each of these sizes. A scan leaves a
narrow row for each document and one for each shingle that items have, and nothing else moves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, small_side, stored, table_bytes

#: Words are what these ASCII separators leave.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 4
WINDOW = 10
#: Bytes of item shingles that one scan of the corpus looks for.
BLOCK_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def shingles(words: DataFrame, size: int) -> DataFrame:
    """Each row of ``words`` once per shingle of ``size`` words, with ``pos`` from 0, its words ``s0, s1, ..`` and their hash
    ``token``; once with nulls if it has none."""
    cols = [c for c in words.columns if c != "words"]
    parts = [F.slice("words", i + 1, F.greatest(F.size("words") - (size - 1), F.lit(0))).alias(f"s{i}") for i in range(size)]
    out = words.select(*cols, F.posexplode_outer(F.arrays_zip(*parts)).alias("pos", "s"))
    names = [f"s{i}" for i in range(size)]
    return out.select(*cols, "pos", *[F.col(f"s.{n}").alias(n) for n in names], F.xxhash64(*[F.col(f"s.{n}") for n in names]).alias("token"))


def item_windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """``(window, words, size, len, items)``: distinct windows, by their words with spaces between; ``size`` is the shingle size."""
    w = items.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - (window - 1), F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("all", i, window))).alias("words"))
    size = F.least(F.size("words"), F.lit(SHINGLE)).alias("size")
    return w.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.array_join("words", " ").alias("window"), "words", size, F.size("words").alias("len"), "items")


def _seen(docs: DataFrame, size: int, tokens: DataFrame, doc_id: str, keep: tuple[str, ...], firsts: bool) -> DataFrame:
    """The scan: ``first`` rows, one for each document, if asked for, and a row for each place of an item's shingle, with its words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select(F.col(doc_id).alias("d"), F.xxhash64(text).alias("h"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"), words_of(F.col("text")).alias("words"))
    vocabulary = F.broadcast(tokens.select("token").distinct().withColumn("own", F.lit(True)))  # of at most BLOCK_BYTES
    every = shingles(words.withColumn("n_words", F.size("words")), size).join(vocabulary, "token", "left")
    first = F.coalesce(F.col("pos") == 0, F.lit(True))
    said = F.when(F.col("own") & F.col("pos").isNotNull(), F.concat_ws(" ", *[f"s{i}" for i in range(size)]))
    return every.where(first | F.col("own") if firsts else F.col("own")).select("d", "h", "n_words", first.alias("first"), F.when(first, F.col("kept")).alias("kept"), "pos", said.alias("said"))


def _occurrences(seen: DataFrame, tokens: DataFrame, made: list[str]) -> DataFrame:
    """``(d, h, start, window, len)``: the places where the windows of ``tokens`` occur in the documents of ``seen``."""
    places = seen.where("said is not null").select("d", "h", "n_words", "pos", "said")
    rarity = stored(places.groupBy("said").agg(F.count(F.lit(1)).alias("n")), "rarity", made)
    # A shingle that no document has is the rarest of all: its window can't occur.
    ranked = tokens.join(F.broadcast(rarity), "said", "left").groupBy("window", "len").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "said", "pos")).alias("p"))
    prefix = stored(ranked.where("p.n > 0").select(F.col("p.said").alias("said"), F.col("p.pos").alias("at"), "window", "len"), "item-prefixes", made)
    start = F.col("pos") - F.col("at")
    near = places.join(F.broadcast(prefix), "said").where((start >= 0) & (start + F.col("len") <= F.col("n_words")))
    near = stored(near.select("d", "h", start.alias("start"), "window", "len").distinct(), "window-candidates", made)
    wanted = near.join(F.broadcast(tokens.select("window", F.col("pos").alias("i"), "said", "n_tokens")), "window")
    wanted = wanted.select("d", "h", "start", "window", "len", "n_tokens", (F.col("start") + F.col("i")).alias("pos"), "said")
    own = near.select(F.col("d").alias("e"), F.col("h").alias("g")).distinct()
    there = places.join(small_side(stored(own, "candidate-documents", made)), F.col("d").eqNullSafe(F.col("e")) & (F.col("h") == F.col("g")), "left_semi")
    there = there.select(F.col("d").alias("e"), F.col("h").alias("g"), F.col("pos").alias("place"), F.col("said").alias("words")).distinct()
    same = F.col("d").eqNullSafe(F.col("e")) & (F.col("h") == F.col("g")) & (F.col("pos") == F.col("place")) & (F.col("said") == F.col("words"))
    found = wanted.join(there, same).groupBy("d", "h", "start", "window", "len", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    return found.where("n = n_tokens").select("d", "h", "start", "window", "len")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    window: int = WINDOW,
    keep: tuple[str, ...] = (),
    hash_col: str | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: one row per document.

    A window is ``window`` consecutive words of an item, or all words of a shorter item. A document's word is
    hit when it lies inside an occurrence of a window. Null and empty texts have no words: such documents are
    clean, such items match nothing. Repeated rows, rows that share an id but not a text, and rows with a null
    id each get a row of their own, judged by their own text. Equal items each count, repeated item ids once;
    a null item id counts for hits, not among the items. Further columns are ignored but for those named in
    ``keep``, which are passed through; ``hash_col`` names a column to add, ``xxhash64`` of the text (null: empty).
    """
    made: list[str] = []
    windows = stored(item_windows(items, item_id, "text", window), "item-windows", made)
    sizes = [r["size"] for r in windows.select("size").distinct().orderBy(F.desc("size")).collect()]  # at most SHINGLE values
    base, hits = None, []
    for size in sizes or [SHINGLE]:
        own = shingles(windows.where(F.col("size") == size).select("window", "len", (F.col("len") - size + 1).alias("n_tokens"), "words"), size)
        tokens = stored(own.select("window", "len", "n_tokens", "pos", "token", F.concat_ws(" ", *[f"s{i}" for i in range(size)]).alias("said")), "item-shingles", made)
        blocks = max(1, -(-table_bytes(tokens) // block_bytes))
        for b in range(blocks):
            part = tokens.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b)
            seen = stored(_seen(docs, size, part, doc_id, keep if base is None else (), base is None), "seen-shingles", None if base is None else made)
            base = seen.where("first") if base is None else base
            if sizes:
                hits.append(stored(_occurrences(seen, part, made), "occurrences", made))
    rows = base.select("d", "h", "kept", F.col("n_words").cast("long").alias("n_words"))
    empty = F.array().cast("array<string>")
    if hits:
        found = reduce(DataFrame.unionByName, hits).join(windows.select("window", "items"), "window")
        span = F.struct(F.col("start"), (F.col("start") + F.col("len")).alias("end"))
        found = found.groupBy("d", "h").agg(F.array_sort(F.collect_set(span)).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
        covered = F.aggregate(
            "spans",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
            lambda a, s: F.struct(
                (a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["end"]), F.lit(0))).cast("long").alias("n"),
                F.greatest(a["end"], s["end"]).alias("end"),
            ),
            lambda a: a["n"],
        )
        found = stored(found.select(F.col("d").alias("e"), F.col("h").alias("g"), covered.alias("n_hit"), "items"), "contaminated-documents")
        discard(docs.sparkSession, made)
        rows = rows.join(small_side(found), F.col("d").eqNullSafe(F.col("e")) & (F.col("h") == F.col("g")), "left")
    else:
        rows = rows.withColumns({"n_hit": F.lit(0).cast("long"), "items": empty})
    items_of = F.coalesce("items", empty)
    return rows.select(
        F.col("d").alias(doc_id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *[F.col(f"kept.{c}").alias(c) for c in keep],
        *([F.col("h").alias(hash_col)] if hash_col else []),
    )
