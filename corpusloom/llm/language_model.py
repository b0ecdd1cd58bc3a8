"""A hashed maximum-entropy language model with a class-factored softmax.

A token's probability is that of its class, given the tokens before it, times that of the token inside its
class, given the same tokens. Both are softmaxes whose weights are rows of hashed tables: of n-gram and skip
features of the context for classes, of such features together with the class for the words in it. Inside a
class the most frequent words have an outcome each and the others share one, in proportion to their counts.
Words that aren't frequent make a class of their own, where counts give up a discount to unknown words,
which is divided among as many words as are estimated to be unseen.

Counts, contexts and gradients are of all training texts: counts are summed by word; classes come from
clustering the contexts of frequent words; and weights are trained in rounds, in which each task takes
gradient steps over its texts of that round and the changes are averaged.

What is broadcast is bounded: at most ``FREQUENT`` words with their classes, and the weights, whose rows
double with every eightfold of the training tokens beyond ``2 ** GROWTH_FROM``, ``2 ** MOST_BITS`` at most. All
other words' counts reach the texts by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .shingling import Shingler, mix, slices

FREQUENT = 1 << 17
CONTEXT = 8
CLASSES = 64
#: Outcomes inside a class: its most frequent words, and the rest.
SLOTS = 16
TABLE_BITS = 15
MOST_BITS = 20
GROWTH_FROM = 28
ROUNDS = 3
STEP = 0.4
MINIBATCH = 4096
#: For tables inside classes, whose rows are narrower.
INNER_MINIBATCH = 16384
#: Bits of a hash that choose a word's place in a direct table.
PLACE_BITS = 20
#: Bound of a weight: the features of a token and a bias can't overflow a 32-bit exponential.
LIMIT = 15.0
RARE = CLASSES - 1
#: Places before the first token, and words that aren't frequent, as context.
START, OTHER = FREQUENT + 1, FREQUENT
END = np.uint64(0x9D3C1A7E5B2F4687)  # no word is made to have this hash
CHUNK_ROWS = 1024
#: Chunks from this number on are of the table for words inside classes.
INNER_CHUNKS = 1 << 20
_SALTS = np.random.default_rng(7).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FEATURES, INNER_FEATURES = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _token_batches(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows, all their token hashes with the ends, and the tokens of each row; of bounded size but for one long text."""
    shingler = Shingler()
    for b in batches:
        rows = list(zip(*[c.to_pylist() for c in b.columns]))
        texts = [r[column] or "" for r in rows]
        for x, y in slices(texts):
            a, text, _ = shingler.words(texts[x:y])
            lengths = np.bincount(text, minlength=y - x) + 1
            tokens = np.empty(len(a) + y - x, np.uint64)
            tokens[np.arange(len(a)) + text] = a
            tokens[np.cumsum(lengths) - 1] = END
            yield rows[x:y], tokens, lengths


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
    return words, np.bincount(at, np.concatenate([c for _, c in parts]), len(words)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _, tokens, _ in _token_batches(batches):
        held.append(np.unique(tokens, return_counts=True))
        if sum(len(w) for w, _ in held) > 1_500_000:
            held = [_merge(held)]
            if len(held[0][0]) > 1_000_000:
                words, counts = held.pop()
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])
    if held:
        words, counts = _merge(held)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "n"])


class Vocabulary:
    """The frequent words: hashes ascending, their counts and classes."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, classes: np.ndarray | None = None):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order]
        self.classes = np.zeros(len(words), np.int64) if classes is None else classes[order]
        place = (self.words & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        self.first = np.zeros(1 << PLACE_BITS, np.int32)
        self.first[place] = np.arange(len(words))
        self.shared = np.bincount(place, minlength=1 << PLACE_BITS) > 1  # places of several words

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.words, self.counts, self.classes

    def index(self, tokens: np.ndarray) -> np.ndarray:
        """Places of tokens among the frequent words, ``OTHER`` for others."""
        if not len(self.words):
            return np.full(len(tokens), OTHER)
        place = (tokens & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        at = self.first[place].astype(np.int64)
        known = self.words[at] == tokens
        again = np.flatnonzero(~known & self.shared[place])
        if len(again):
            at[again] = np.minimum(np.searchsorted(self.words, tokens[again]), len(self.words) - 1)
            known[again] = self.words[at[again]] == tokens[again]
        return np.where(known, at, OTHER)


def before(index: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
    """For each token the one ``k`` places earlier in its text, or ``START``."""
    out = np.full(len(index), START)
    out[k:] = index[:-k] if k < len(index) else []
    starts = np.cumsum(lengths) - lengths
    for j in range(k):
        at = starts + j
        out[at[j < lengths]] = START
    return out


def _sum_chunks(kind):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weight: dict[int, float] = {}
        for b in batches:
            for chunk, w, data in zip(*(b.column(i).to_pylist() for i in range(3))):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, kind).astype(np.float32) * np.float32(w)
                weight[chunk] = weight.get(chunk, 0) + w
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([weight[c] for c in sums], pa.float64()), pa.array([x.astype(np.float32).tobytes() for x in sums.values()], pa.binary())], ["chunk", "weight", "data"])

    return run


_CHUNKS = "chunk int, weight double, data binary"


def _chunks(table: np.ndarray, weight: float, kind, first: int = 0) -> pa.RecordBatch:
    parts = [(first + i, table[i * CHUNK_ROWS : (i + 1) * CHUNK_ROWS]) for i in range(-(-len(table) // CHUNK_ROWS))]
    parts = [(i, p) for i, p in parts if p.any()]
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([weight] * len(parts), pa.float64()), pa.array([p.astype(kind).tobytes() for _, p in parts], pa.binary())], ["chunk", "weight", "data"])


def _total(parts: DataFrame, kind, *tables: np.ndarray, mean: bool) -> None:
    """Add to the tables the sum, or weighted mean, of the chunks that tasks send for them; what arrives has their size."""
    for chunk, weight, data in parts.repartition("chunk").mapInArrow(_sum_chunks(kind), _CHUNKS).collect():
        table, at = tables[chunk // INNER_CHUNKS], chunk % INNER_CHUNKS * CHUNK_ROWS
        part = np.frombuffer(data, np.float32).reshape(-1, table.shape[1])
        table[at : at + len(part)] += part / np.float32(weight) if mean else part


def _contexts(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = Vocabulary(*shared.value)
        k = len(v.words)
        rows = np.arange(FREQUENT + 2, dtype=np.uint64)[:, None] * np.uint64(CONTEXT) + np.arange(CONTEXT, dtype=np.uint64)
        signs = (mix(rows) >> np.uint64(63)).astype(np.float32) * 2 - 1
        signs[OTHER:] = 0
        table = np.zeros((k, CONTEXT), np.float32)
        for _, tokens, lengths in _token_batches(batches):
            index = v.index(tokens)
            near = signs[before(index, lengths, 1)] + signs[before(index, lengths, 2)]
            own = index < k
            for d in range(CONTEXT):
                table[:, d] += np.bincount(index[own], near[own, d], k)
        yield _chunks(table, 1.0, np.float32)

    return run


def clusters(contexts: np.ndarray, counts: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means of the words' contexts, seeded by the most frequent words."""
    if not len(counts):
        return np.zeros(0, np.int64)
    mean = contexts.sum(0) / max(1, counts.sum())
    x = contexts - counts[:, None] * mean
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
    weight = np.sqrt(counts.astype(np.float64))
    centre = x[np.argsort(-counts, kind="stable")[:n]].astype(np.float64)
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        for at in range(0, len(x), 65536):
            label[at : at + 65536] = (x[at : at + 65536] @ centre.T).argmax(1)
        for d in range(x.shape[1]):
            centre[:, d] = np.bincount(label, weight * x[:, d], len(centre))
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    return label


@dataclass
class Model:
    """All that texts are scored by, but the counts of rare words."""

    words: np.ndarray
    counts: np.ndarray
    #: By place among the frequent words, then ``OTHER`` and ``START``: class, symbol as context, slot, log10 of the share of the slot.
    classes: np.ndarray
    symbols: np.ndarray
    slots: np.ndarray
    shares: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    total: int
    types: int
    rare_tokens: int
    rare_types: int
    discount: float
    unseen: float

    def features(self, index: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each token's rows in both tables: of the word before, the skipped ones before that, and the pair of the last two
        classes; and of its own class with the word before, and with the skipped one before that."""
        bits, symbols, ends = np.uint64(self.weights.shape[0].bit_length() - 1), self.symbols.astype(np.uint64), [before(index, lengths, k) for k in (1, 2, 3)]
        pick = lambda keys, kind, n=bits: (mix(keys * _SALTS[0] + _SALTS[1:2] * np.uint64(kind + 1)) >> (np.uint64(64) - n)).astype(np.int64)
        outer = [pick(symbols, k)[e] for k, e in enumerate(ends)]
        classes = self.classes.astype(np.uint64)
        pair = np.arange((CLASSES + 1) ** 2, dtype=np.uint64)
        outer.append(pick(pair, 3)[self.classes[ends[0]] * (CLASSES + 1) + self.classes[ends[1]]])
        own = classes[index] * _SALTS[2]
        inner = [pick(symbols[e] + own, 4 + k, np.uint64(self.inner.shape[0].bit_length() - 1)) for k, e in enumerate(ends[:INNER_FEATURES])]
        return np.stack(outer), np.stack(inner)


def logits(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Unnormalised log-probabilities; ``bias`` is a row, or a row for each token."""
    z = np.take(weights, rows[0], axis=0)
    part = np.empty_like(z)
    for own in rows[1:]:
        z += np.take(weights, own, axis=0, out=part, mode="clip")
    z += bias
    return z


def log_probability(rows: np.ndarray, label: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """log10 of the softmax at the labels."""
    z = logits(rows, weights, bias)
    own = z[np.arange(len(label)), label].astype(np.float64)
    np.exp(z, out=z)
    return (own - np.log((z @ np.ones(z.shape[1], np.float32)).astype(np.float64))) / math.log(10)


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows: in each turn neighbours in a run are added, and runs of one row are done."""
    out = np.empty((len(counts), values.shape[1]), values.dtype)
    run = np.arange(len(counts))
    while True:
        starts = np.cumsum(counts) - counts
        single = counts == 1
        out[run[single]] = np.take(values, starts[single], axis=0)
        if single.all():
            return out
        run, starts, counts = run[~single], starts[~single], counts[~single]
        half = (counts + 1) >> 1
        ends = np.cumsum(half)
        at = 2 * (np.arange(ends[-1]) - np.repeat(ends - half, half)) + np.repeat(starts, half)
        odd = ends[(counts & 1) == 1] - 1  # the last row of these runs has no neighbour
        merged = np.take(values, at, axis=0)
        other = np.take(values, at + 1, axis=0, mode="clip")
        other[odd] = 0
        merged += other
        values, counts = merged, half


def take_step(rows: np.ndarray, label: np.ndarray, weights: np.ndarray, squares: np.ndarray, bias: np.ndarray) -> None:
    """A gradient step over a minibatch, feature by feature, on the rows that it hits; all in float32."""
    error = logits(rows, weights, bias)
    np.exp(error, out=error)
    error /= (error @ np.ones(error.shape[1], np.float32))[:, None]
    error[np.arange(len(label)), label] -= 1
    for own in rows:
        keys = own.astype(np.uint16) if len(weights) <= 1 << 16 else own  # numpy sorts 16 bits by radix
        order = np.argsort(keys, kind="stable")
        hit = own[order]
        cut = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1]]))
        hit, n = hit[cut], np.diff(np.append(cut, len(hit)))
        g = group_sums(np.take(error, order, axis=0), n)
        g *= (n**-0.5).astype(np.float32)[:, None]
        seen = squares[hit] + np.einsum("ij,ij->i", g, g) / np.float32(g.shape[1])
        squares[hit] = seen
        g *= (np.float32(STEP / len(rows)) / np.sqrt(seen))[:, None]
        weights[hit] = np.clip(weights[hit] - g, -LIMIT, LIMIT)


def _train(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**model.value)
        v = Vocabulary(m.words, m.counts)
        weights, inner = m.weights.copy(), m.inner.copy()
        squares, inner_squares = (np.full(len(t), 1e-2, np.float32) for t in (weights, inner))
        seen = 0
        for _, tokens, lengths in _token_batches(batches):
            index = v.index(tokens)
            label, slot = m.classes[index], m.slots[index]
            outer, rows = m.features(index, lengths)
            for at in range(0, len(tokens), MINIBATCH):
                take_step(outer[:, at : at + MINIBATCH], label[at : at + MINIBATCH], weights, squares, m.bias)
            named = np.flatnonzero(label != RARE)
            for at in range(0, len(named), INNER_MINIBATCH):
                own = named[at : at + INNER_MINIBATCH]
                take_step(rows[:, own], slot[own], inner, inner_squares, m.inner_bias[label[own]])
            seen += len(tokens)
        if seen:
            yield _chunks(weights - m.weights, float(seen), np.float16)
            yield _chunks(inner - m.inner, float(seen), np.float16, INNER_CHUNKS)

    return run


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**model.value)
        v = Vocabulary(m.words, m.counts)
        base = np.append(np.log10((m.counts + 1) / (m.total + m.types + 1)), np.zeros(len(m.classes) - len(m.counts)))
        row, prefix = 0, TaskContext.get().partitionId() << 36
        for held, tokens, lengths in _token_batches(batches, 1):
            index = v.index(tokens)
            label, slot = m.classes[index], m.slots[index]
            outer, rows = m.features(index, lengths)
            score = m.shares[index]
            for at in range(0, len(tokens), MINIBATCH):
                score[at : at + MINIBATCH] += log_probability(outer[:, at : at + MINIBATCH], label[at : at + MINIBATCH], m.weights, m.bias)
            named = np.flatnonzero(label != RARE)
            for at in range(0, len(named), INNER_MINIBATCH):
                own = named[at : at + INNER_MINIBATCH]
                score[own] += log_probability(rows[:, own], slot[own], m.inner, m.inner_bias[label[own]])
            starts = np.cumsum(lengths) - lengths
            rare = index == OTHER
            whose = np.repeat(np.arange(len(lengths)), lengths)[rare]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(lengths)))]).astype(np.int32)
            out = [
                pa.array(np.arange(row, row + len(held)) + prefix),
                pa.array([r[0] for r in held], pa.int64()),
                pa.array(lengths.astype(np.int64)),
                pa.array(np.add.reduceat((~rare).astype(np.int64), starts)),
                pa.array(np.add.reduceat(base[index], starts)),
                pa.array(np.add.reduceat(score, starts)),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[rare].view(np.int64))),
            ]
            row += len(held)
            yield pa.RecordBatch.from_arrays(out, ["row", "id", "n_tokens", "known", "base", "model", "rare"])

    return run


def placed(words: Vocabulary, total: int, types: int, n1: int, n2: int) -> Model:
    """The model before training: every frequent word's class, symbol and slot, and biases from counts."""
    k, places = len(words.words), FREQUENT + 2
    rows = 1 << min(MOST_BITS, TABLE_BITS + max(0, (max(1, total).bit_length() - GROWTH_FROM) // 3))
    most = rows // 4
    classes = np.full(places, RARE)
    classes[:k], classes[START] = words.classes, CLASSES
    rank = np.empty(k, np.int64)
    rank[np.lexsort((words.words, -words.counts))] = np.arange(k)
    symbols = most + classes
    symbols[:k] = np.where(rank < most, rank, symbols[:k])
    # Inside a class, by count: the first words have a slot each.
    order = np.lexsort((rank, words.classes))
    size = np.bincount(words.classes, minlength=CLASSES)
    inside = np.empty(k, np.int64)
    inside[order] = np.arange(k) - np.repeat(np.cumsum(size) - size, size)
    slots = np.zeros(places, np.int64)
    slots[:k] = np.minimum(inside, SLOTS - 1)
    in_slot = np.bincount(words.classes * SLOTS + slots[:k], words.counts, CLASSES * SLOTS).reshape(CLASSES, SLOTS)
    shares = np.zeros(places)
    shares[:k] = np.log10(words.counts / in_slot[words.classes, slots[:k]])
    in_class = in_slot.sum(1)
    rare_tokens = total - int(words.counts.sum())
    in_class[RARE] = rare_tokens
    with np.errstate(divide="ignore"):
        inner_bias = np.maximum(np.log(in_slot / np.maximum(1, in_slot.sum(1))[:, None]), -2 * LIMIT)
    inner_bias[in_slot == 0] = -40 * math.log(10)  # no such outcome
    discount = n1 / (n1 + 2 * max(1, n2)) if n1 else 0.5
    # As many unseen words as singletons and pairs let expect, and so many that none is likelier than a singleton.
    unseen = max(1.0, n1 * (n1 - 1) / (2 * (n2 + 1)), discount * (types - k) / (1 - discount))
    return Model(
        words.words,
        words.counts,
        classes,
        symbols,
        slots,
        shares,
        np.zeros((rows, CLASSES), np.float32),
        np.log((in_class + 0.5) / (total + 0.5 * CLASSES)).astype(np.float32),
        np.zeros((rows, SLOTS), np.float32),
        inner_bias.astype(np.float32),
        total,
        types,
        rare_tokens,
        types - k,
        discount,
        unseen,
    )


def fit(training: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model and the counts ``(word, c)`` of all words, as hashes, from every row of ``training``."""
    spark = training.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    counted = training.select(text).mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c"))
    vocabulary = stored(counted, "vocabulary")
    n1, n2 = (F.coalesce(F.sum(F.expr(f"if(c = {i}, 1, 0)")), F.lit(0)) for i in (1, 2))
    total, types, n1, n2 = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), n1, n2).first()

    # Words are frequent from a count on that at most FREQUENT of them reach, by a scale of a few hundred steps.
    scale = F.floor(F.log2("c") * 8)
    left, least = FREQUENT, None
    for step, n in sorted(((r[0], r[1]) for r in vocabulary.where("c > 1").groupBy(scale).count().collect()), reverse=True):
        left -= n
        if left < 0:
            break
        least = step
    top = vocabulary.where((F.col("c") > 1) & (scale >= least)).collect() if least is not None else []
    words = Vocabulary(np.array([r[0] for r in top], np.int64).view(np.uint64), np.array([r[1] for r in top], np.int64))
    contexts = np.zeros((max(1, len(words.words)), CONTEXT), np.float32)
    _total(training.select(text).mapInArrow(_contexts(spark.sparkContext.broadcast(words.parts())), _CHUNKS), np.float32, contexts, mean=False)
    words.classes = clusters(contexts[: len(words.words)], words.counts, CLASSES - 1)

    model = placed(words, total, types, n1, n2)
    for r in range(rounds):
        turn = training.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(r"turn")), F.lit(rounds)) == r)
        _total(turn.select(text).mapInArrow(_train(spark.sparkContext.broadcast(dict(vars(model)))), _CHUNKS), np.float16, model.weights, model.inner, mean=True)
    return model, vocabulary


def score(docs: DataFrame, model: Model, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` scored by a model and its counts; the columns are those of ``language_model_scores``."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ids = F.col(id_col).cast("long").alias("id")
    shared = docs.sparkSession.sparkContext.broadcast(dict(vars(model)))  # plain arrays: executors need no copy of this package
    kinds = "row long, id long, n_tokens long, known long, base double, model double, rare array<long>"
    scored = stored(docs.select(ids, text).mapInArrow(_scorer(shared), kinds), "text-scores")
    others = scored.select("row", F.explode("rare").alias("word")).groupBy("row", "word").agg(F.count(F.lit(1)).alias("times"))
    others = others.join(vocabulary, "word", "left")
    tokens = float(max(1, model.rare_tokens))
    unknown = math.log10((model.discount * model.rare_types / tokens if model.rare_tokens else 1.0) / model.unseen)
    per_token = F.coalesce(F.log10((F.col("c") - model.discount) / F.lit(tokens)), F.lit(unknown))
    rest = others.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(model.total + model.types + 1)))).alias("more_base"),
        F.sum(F.col("times") * per_token).alias("more_model"),
    )
    out = scored.drop("rare").join(rest, "row", "left")
    return out.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"),
    )


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``: one row per input row.

    Tokens are A-Z lower-cased words between ASCII white space and one end. The base is the add-one unigram
    model of the training texts; ``score`` is the log10 probability by the class-factored model, which sums to one over
    the training words and as many unseen words as the counts lead to expect. A null text counts as empty: its end
    alone. Repeated rows count and are scored as often as they occur; a null id is a training row like any other.
    Without training texts all tokens are unknown. Ids are integers; further columns are ignored; an empty table gives
    an empty result.
    """
    return score(docs, *fit(docs.where(~held_out(F.col(id_col))), id_col, text_col, rounds), id_col, text_col)
