"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad; its features are of its own text and of the lines before and after it, and
neighbouring labels influence each other. A document label is taken as the label of its lines in training,
which is on a bounded sample of labelled documents; a document's score is the mean of its lines' marginal
probabilities of being good, weighted by line length.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, tidy
from .shingling import slices

#: Labelled documents to fit on, at most.
SAMPLE_DOCS = 2000
STEPS = 80
RATE = 0.08
PENALTY = 1e-3
THRESHOLD = 0.7
SLICE = 256

_CLASSES = np.zeros((256, 7), np.float32)
for _i, _bytes in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), b"|", b"!?", b"#%$&*^~=<>{}[]\\_+/@", b".,;:'\"()-")):
    _CLASSES[list(_bytes), _i] = 1
OWN = 13


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line that has words, its length in bytes, and the lines of each text."""
    counts, rows, lines = [], [], []
    for text in texts:
        n = 0
        for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
            words = line.split()
            if words:
                distinct = len(set(words))
                rows.append((len(words), distinct, sum(map(eq, words, words[1:]))))
                lines.append(line)
                n += 1
        counts.append(n)
    if not lines:
        return np.zeros((0, OWN)), np.zeros(0), np.array(counts, np.int64)
    data = np.frombuffer(b"".join(lines), np.uint8)
    size = np.array([len(x) for x in lines], np.int64)
    starts = np.cumsum(size) - size
    kinds = np.add.reduceat(_CLASSES[data], starts, axis=0).astype(np.float64)
    # Two-byte Latin letters: after C3, 80-9E are capitals.
    accented = np.zeros(len(data), np.float64)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    capital = kinds[:, 0] + np.add.reduceat(accented, starts)
    letters = kinds[:, 0] + kinds[:, 1] + np.add.reduceat((data >= 0xC0).astype(np.float64), starts)
    words, distinct, repeats = np.array(rows, np.float64).T
    per_word = lambda x: np.minimum(1, x / words)
    out = np.stack(
        [
            np.minimum(1, capital / np.maximum(1, letters)),
            per_word(kinds[:, 3]),
            per_word(kinds[:, 4]),
            per_word(kinds[:, 5] / 2),
            per_word(kinds[:, 6]),
            per_word(kinds[:, 2] / 2),
            repeats / words,
            1 - distinct / words,
            np.where(words < 4, 1 - distinct / words, 0),
            np.minimum(1, letters / size),
            np.minimum(3, np.log10(words)),
            np.minimum(2, size / words / 10),
            (words < 4) * 1.0,
        ],
        axis=1,
    )
    return out, size.astype(np.float64), np.array(counts, np.int64)


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after, and whether there is one; a constant last."""
    n, d = own.shape
    first = np.zeros(n, bool)
    last = np.zeros(n, bool)
    ends = np.cumsum(counts)
    full = counts > 0
    first[(ends - counts)[full]] = True
    last[ends[full] - 1] = True
    out = np.zeros((n, 3 * d + 3))
    out[:, :d] = own
    out[1:, d : 2 * d] = own[:-1]
    out[first, d : 2 * d] = 0
    out[:-1, 2 * d : 3 * d] = own[1:]
    out[last, 2 * d : 3 * d] = 0
    out[:, 3 * d], out[:, 3 * d + 1], out[:, 3 * d + 2] = first, last, 1
    return out


def forward_backward(scores: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state good for every line, and the expected transitions of each text summed (2 x 2).

    ``scores``: log-potential of good against bad for each line. Texts run side by side, the longest first.
    """
    order = np.argsort(-counts, kind="stable")
    length = counts[order]
    starts = (np.cumsum(counts) - counts)[order]
    longest = int(length[0]) if len(length) else 0
    pot = np.zeros((len(scores), 2))
    pot[:, 1] = scores
    pot -= pot.max(1, keepdims=True)
    pot = np.exp(pot)
    move = np.exp(transition - transition.max())
    alpha, beta = np.zeros_like(pot), np.ones_like(pot)
    live = [int(np.searchsorted(-length, -t, side="left")) for t in range(longest)]  # texts longer than t lines
    for t in range(longest):
        at = starts[: live[t]] + t
        a = pot[at] if t == 0 else pot[at] * (alpha[at - 1] @ move)
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        b = (pot[at + 1] * beta[at + 1]) @ move.T
        beta[at] = b / b.sum(1, keepdims=True)
    both = alpha * beta
    marginal = both / both.sum(1, keepdims=True)
    pairs = np.zeros((2, 2))
    second = np.ones(len(scores), bool)
    second[starts[length > 0]] = False
    at = np.nonzero(second)[0]
    if len(at):
        joint = alpha[at - 1][:, :, None] * move[None] * (pot[at] * beta[at])[:, None, :]
        pairs = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
    return marginal[:, 1], pairs


def fit(own: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Weights by Adam on the log-likelihood of the lines' labels."""
    scale = np.maximum(own.std(0), 0.02) if len(own) else np.ones(OWN)
    mean = own.mean(0) if len(own) else np.zeros(OWN)
    model = {"mean": mean, "scale": scale, "prior": np.array(labels.mean() if len(labels) else 0.5)}
    x = with_neighbours((own - mean) / scale, counts)
    y = np.repeat(labels, counts).astype(np.float64)
    w, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    n = max(1, len(y))
    seen = np.zeros((2, 2))
    inside = np.ones(len(y), bool)
    inside[(np.cumsum(counts) - counts)[counts > 0]] = False
    at = np.nonzero(inside)[0]
    np.add.at(seen, (y[at - 1].astype(int), y[at].astype(int)), 1)
    m = v = np.zeros(len(w) + 4)
    for step in range(1, steps + 1 if len(y) else 1):
        marginal, pairs = forward_backward(x @ w, counts, transition)
        g = np.concatenate([x.T @ (y - marginal) / n - PENALTY * w, ((seen - pairs) / n - PENALTY * transition).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, transition = w + move[:-4], transition + move[-4:].reshape(2, 2)
    return model | {"w": w, "transition": transition}


def scores(texts: list[str | None], model: dict[str, np.ndarray]) -> np.ndarray:
    """Each text's length-weighted mean of its lines' marginals; the share of good training texts if it has no words."""
    own, size, counts = line_features(texts)
    out = np.full(len(texts), float(model["prior"]))
    if len(own):
        x = with_neighbours((own - model["mean"]) / model["scale"], counts)
        marginal, _ = forward_backward(x @ model["w"], counts, model["transition"])
        full = counts > 0
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(marginal * size, starts) / np.add.reduceat(size, starts)
    return np.clip(out, 0, 1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own, _, counts = line_features(b.column(1).to_pylist())
        ends = np.cumsum(counts)
        rows = [own[e - c : e].astype(np.float32).tobytes() for e, c in zip(ends, counts)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["label", "features"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> dict[str, np.ndarray]:
    """Fit on at most ``sample_docs`` labelled documents that are not held out, the first ones by a hash of their ids.

    Rows without id or label don't count; of several labels of a document the lowest does. Where ids repeat in
    ``docs``, at most twice as many rows are fitted, the first by a hash of their features. Without any labelled
    document all scores are one half.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    chosen = known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    chosen = chosen.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(sample_docs)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    kind = "label int, features binary"
    got = rows.select(F.col("label").cast("int").alias("label"), "text").mapInArrow(tidy(_features), kind).orderBy(F.sha1("features"), "label").limit(2 * sample_docs).collect()
    own = [np.frombuffer(r["features"], np.float32).reshape(-1, OWN).astype(np.float64) for r in got]
    return fit(np.concatenate(own) if own else np.zeros((0, OWN)), np.array([len(x) for x in own], np.int64), np.array([r["label"] for r in got], np.float64))


def quality(docs: DataFrame, model: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, held_out, score, predicted``: one row per input row; the score reads nothing but the whole text.

    A null or empty text, or one without words, gets the share of good documents in training. Repeated rows
    get equal scores, null ids are kept. Further columns are ignored but for those named in ``keep``, which are
    passed through.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for at in range(0, len(texts), SLICE):  # bounded memory, whatever the batch and the texts
            part = texts.slice(at, SLICE).to_pylist()
            out += [scores(part[x:y], model) for x, y in slices([t or "" for t in part])]
        got = pa.array(np.concatenate(out))
        give_back()
        return got

    # Only texts go to Python, and only scores come back.
    rows = docs.select(F.col(id_col).alias("id"), score(F.col(text_col)).alias("score"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"))
    return rows.select(
        F.col("id").alias(id_col),
        held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
        *[F.col(f"kept.k{i}").alias(c) for i, c in enumerate(keep)],
    )
