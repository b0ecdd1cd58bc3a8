"""Word shingles as 64-bit hashes, many texts at a time."""

from __future__ import annotations

import numpy as np

WORDS = 5
#: Bytes of text that are hashed at a time.
BATCH_BYTES = 1 << 19
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RANDOM = np.random.default_rng(20240101)
_FACTORS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTERS = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(texts: list[str], most: int = BATCH_BYTES):
    """Places where a list of texts is cut into runs of about ``most`` characters."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size > most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Shingler:
    """Word and shingle hashes, by array operations over the bytes of many texts.

    A word's hash is a polynomial in its bytes, a difference of two prefix sums over all bytes, and mixed; a
    shingle's is a mixed linear combination of its words' hashes.
    """

    def __init__(self, words: int = WORDS):
        self.k = words
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * BATCH_BYTES)
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 2**64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words between ASCII white space, A-Z lower-cased: hash, number of the text, number of the line in it."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.array([len(x) + 1 for x in raw], np.int64)
        starts_of = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"\n".join(raw).translate(_LOWER), np.uint8)
        n = len(data)
        self._grow(n + 1)
        space = np.ones(n + 2, bool)
        space[1:-1] = _SPACE[data]
        edge = np.nonzero(space[1:] != space[:-1])[0]
        begin, end = edge[::2], edge[1::2]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_LETTERS[data] * self.powers[:n], out=sums[1:])
        h = mix((sums[end] - sums[begin]) * self.inverses[begin])
        text = np.searchsorted(starts_of, begin, side="right") - 1
        breaks = np.nonzero(data == 10)[0]
        line = np.searchsorted(breaks, begin) - np.searchsorted(breaks, starts_of)[text]
        return h, text, line

    def runs(self, a: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingles of consecutive word sequences of the given ``lengths`` in ``a``: hashes, sequence numbers, first words' places."""
        ends = np.cumsum(lengths)
        full = np.maximum(lengths - self.k + 1, np.minimum(lengths, 1))
        seq = np.repeat(np.arange(len(lengths)), full)
        at = np.arange(len(seq)) - np.repeat(np.cumsum(full) - full, full) + np.repeat(ends - lengths, full)
        k = np.minimum(lengths, self.k)[seq]
        padded = np.concatenate([a, np.zeros(self.k, np.uint64)])
        h = k.astype(np.uint64)
        short = bool((k < self.k).any())
        for j in range(self.k):
            term = _FACTORS[j] * padded[at + j]
            h += np.where(j < k, term, np.uint64(0)) if short else term
        return mix(h), seq, at

    def text_sets(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's distinct shingles, ascending: of each ``k`` words in a row, or of a shorter text's whole sequence."""
        out = []
        for x, y in slices(texts):
            a, text, _ = self.words(texts[x:y])
            h, seq, _ = self.runs(a, np.bincount(text, minlength=y - x))
            cuts = np.cumsum(np.bincount(seq, minlength=y - x))
            out += [np.unique(part) for part in np.split(h, cuts[:-1])]
        return out


def overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Exact sizes of the intersections of each of ``sets`` with each of ``others`` (or with each other one of ``sets``).

    Values that one set alone holds are left out, so a set's entry with itself is no size.
    """
    both = sets if others is None else [*sets, *others]
    m = len(sets)
    if len(both) <= 6:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in (others if others is not None else sets)] for x in sets], np.int64).reshape(m, -1)
    values = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column) > 1 if len(column) else np.zeros(0, bool)
    keep = shared[column] if len(column) else np.zeros(0, bool)
    column, owner = column[keep], owner[keep]
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
    out = np.zeros((m, len(both) - m if others is not None else m), np.int64)
    width = 2048
    for base in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [base, base + width])
        x = np.zeros((len(both), width), np.float32)
        x[owner[a:b], column[a:b] - base] = 1
        rows = np.unique(owner[a:b])
        left = rows[rows < m]
        right = rows[rows >= m] if others is not None else left
        if len(left) and len(right):
            out[np.ix_(left, right - m if others is not None else right)] += np.rint(x[left] @ x[right].T).astype(np.int64)
    return out
