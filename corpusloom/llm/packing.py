"""Packing into near-equal windows by Karmarkar-Karp multiway differencing.

Each partition tokenizes its documents and packs them on the spot: no token moves through a shuffle. Full
windows are cut off a document first. The remainders gather into groups of a bounded number of windows; in
a group, every piece starts as a partial partition (one part holds it, the others are empty), and the two
partial partitions with the largest imbalance are merged, the heaviest part of one onto the lightest of the
other, until one is left. If its heaviest part exceeds the capacity, the group is divided among one window
more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import tidy

CAPACITY = 1024
GROUP_WINDOWS = 32
#: Tokens a group leaves free for each of its windows.
SLACK = 3
#: For each window of a group, pieces of these sizes are cut, so that the last differences can even out.
FINE = (2, 4, 8, 16)

COLUMNS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``k`` parts with near-equal sums."""
    if k == 1:
        return [list(range(len(sizes)))]
    empty = [(0, ())] * (k - 1)
    # A partial partition: parts as (sum, members), heaviest first; members form nested pairs, so merging is O(1).
    heap = [(-s, i, [(s, (i,)), *empty]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        a = heapq.heappop(heap)[2]
        b = heapq.heappop(heap)[2]
        merged = []
        for (x, p), (y, q) in zip(a, reversed(b)):
            merged.append((x + y, (p, q) if p and q else p or q))
        merged.sort(key=lambda e: -e[0])
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], tie, merged))
        tie += 1
    parts = []
    for _, members in heap[0][2] if heap else []:
        flat, todo = [], [members]
        while todo:
            m = todo.pop()
            if isinstance(m, tuple):
                todo.extend(m)
            else:
                flat.append(m)
        parts.append(flat)
    return parts


def windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Parts of ``sizes`` that all fit ``capacity``; their count starts at the least possible and rises as needed."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        k += 1


class _Packer:
    """Packs one partition; rows gather in ``out`` until they are taken."""

    def __init__(self, capacity: int, group: int, first_sequence: int):
        self.capacity, self.share = capacity, max(1, capacity - SLACK)
        self.goal = group * self.share
        self.sequence = first_sequence
        self.pieces: list[tuple] = []
        self.held = 0
        self.out: list[tuple] = []

    def _emit(self, members: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in members:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, at, cap = len(ids) // 4, 0, self.capacity
        while total - at >= cap:
            self._emit([(doc_id, at, ids[4 * at : 4 * (at + cap)], total)])
            at += cap
        while at < total:
            n = min(total - at, self.goal - self.held)
            self.pieces.append((doc_id, at, ids[4 * at : 4 * (at + n)], total))
            self.held += n
            at += n
            if self.held == self.goal:
                self.group()

    def group(self) -> None:
        """Pack the held pieces: long ones in halves of a window, the longest ones partly in fine grain."""
        pieces, grain = [], [f for f in FINE for _ in range(self.goal // self.share)]
        for piece in sorted(self.pieces, key=lambda p: len(p[2])):
            pieces += _cut(piece, [self.capacity // 2] * (len(piece[2]) // 2 // self.capacity))
        longest = len(pieces) - 1
        while grain and longest >= 0:
            room, take = len(pieces[longest][2]) // 4 - 1, []
            while grain and grain[-1] <= room:
                room -= grain[-1]
                take.append(grain.pop())
            if not take:
                break
            pieces[longest : longest + 1] = _cut(pieces[longest], take)
            longest -= 1
        self.pieces, self.held = [], 0
        for members in windows([len(p[2]) // 4 for p in pieces], self.capacity):
            self._emit([pieces[i] for i in sorted(members)])

    def finish(self) -> None:
        """What is left: as many windows as it fills, and the rest by powers of two, which need no padding."""
        rest = self.held % self.share
        tail = []
        while rest:
            piece = self.pieces.pop()
            n = len(piece[2]) // 4
            if n > rest:
                head, piece = _cut(piece, [n - rest])
                self.pieces.append(head)
                n = rest
            tail.append(piece)
            rest -= n
        if self.pieces:
            self.group()
        self.held = 0
        left = sum(len(p[2]) // 4 for p in tail)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            members = []
            while size:
                piece = tail.pop()
                n = len(piece[2]) // 4
                if n > size:
                    piece, more = _cut(piece, [size])
                    tail.append(more)
                    n = size
                members.append(piece)
                size -= n
            self._emit(members)


def _cut(piece: tuple, sizes: list[int]) -> list[tuple]:
    """The piece in parts of the given sizes and what is left."""
    doc_id, start, ids, total = piece
    parts, at = [], 0
    for size in sizes:
        parts.append((doc_id, start + at, ids[4 * at : 4 * (at + size)], total))
        at += size
    if 4 * at < len(ids):
        parts.append((doc_id, start + at, ids[4 * at :], total))
    return parts


def _pack(path: str, capacity: int, group: int, end_id: int, id_type: pa.DataType):
    types = [id_type, *[pa.int64()] * 6]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], list(COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        end = end_id.to_bytes(4, "little")
        packer = _Packer(capacity, group, TaskContext.get().partitionId() << 40)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                packer.add(doc_id, tokens.ids(text) + end)
            if len(packer.out) > 5_000:
                yield batch(packer.out)
                packer.out = []
        packer.finish()
        if packer.out:
            yield batch(packer.out)

    return run


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    group_windows: int = GROUP_WINDOWS,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A document is its ids and then ``end_id``; each id lies in exactly one piece, and the pieces of a sequence
    follow each other from offset 0 up to at most ``capacity``. Null and empty texts are ``end_id`` alone.
    Repeated rows are packed as often as they occur; null ids are kept. ``sequence_id`` is unique, not gapless:
    its upper bits are the partition, so a task that runs again after a loss gives the same rows. An empty
    table gives no pieces; further columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[id_col].dataType
    schema = f"{COLUMNS[0]} {kind.simpleString()}, " + ", ".join(f"{c} long" for c in COLUMNS[1:])
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = rows.mapInArrow(tidy(_pack(tokenizer_path, capacity, group_windows, end_id, to_arrow_type(kind))), schema)
    return packed.withColumnRenamed(COLUMNS[0], id_col)
