"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Every partition packs its own documents, so nothing is shuffled. A document longer than a window gives full windows; what is
left of it is cut into items of at most ITEM tokens. Items are gathered until they fill GROUP windows but for SLACK tokens
each (the last of them, FINE tokens for each window, in items of FINE tokens), and are then divided among them: the two partial partitions of largest spread are merged, the largest sums of one with
the smallest of the other, until one is left. While its largest window exceeds the capacity, the window count rises by one.
The rest at a partition's end fills windows in the same way but for a remainder that is cut into sequences whose lengths are
powers of two, which need no padding.

Every token lies in one piece, pieces of a sequence join without gaps from offset 0. Null text is the empty text: its only
token is the end token. Repeated rows and null ids are documents of their own; an empty table gives an empty table; further
columns are ignored. A partition holds one group of items (GROUP windows) and one slice of text in memory.
"""
from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm.blocks import crc, row_groups, text_bytes
from lumenscan.llm.vocab import SLICE, ByteLevelIds, held, read_vocabulary

WINDOW, GROUP, ITEM, FINE, SLACK = 2048, 32, 512, 16, 16
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_ROWS = 20_000


def differencing(sizes: list[int], m: int) -> list[list[int]]:
    """Indices of `sizes` in m parts of nearly equal sums."""
    if not sizes:
        return [[] for _ in range(m)]
    heap = []
    for i, s in enumerate(sizes):
        # sums above the smallest one, descending, and the members behind each
        heap.append((-s if m > 1 else 0, i, np.array([s if m > 1 else 0] + [0] * (m - 1)), [[i]] + [[] for _ in range(m - 1)]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        c = a + b[::-1]
        order = np.argsort(-c, kind="stable")
        parts = [x[k] + y[m - 1 - k] for k in order.tolist()]
        c = c[order]
        heapq.heappush(heap, (-int(c[0] - c[-1]), i, c - c[-1], parts))
    return heap[0][3]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few near-equal windows as differencing gets within the capacity; no size may exceed it."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, m)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        m += 1


class Packer:
    """Takes documents as uint32 bytes, gives rows of SCHEMA without the sequence's partition."""

    def __init__(self, window: int = WINDOW, group: int = GROUP, item: int = ITEM, fine: int = FINE, slack: int = SLACK):
        self.window, self.goal, self.item, self.slack = window, group * (window - slack), min(item, window), slack
        self.fine, self.coarse = min(fine, item), self.goal - group * fine
        self.items: list[tuple] = []
        self.size = self.sequence = 0

    def _place(self, parts: Iterable[list[tuple]]) -> Iterator[tuple]:
        for part in parts:
            at = 0
            for doc, start, ids, total in part:
                n = len(ids) // 4
                yield doc, start, n, crc(ids), total, self.sequence, at
                at += n
            self.sequence += 1

    def _divide(self) -> Iterator[tuple]:
        items, self.items, self.size = self.items, [], 0
        parts = windows([len(i[2]) // 4 for i in items], self.window)
        yield from self._place([[items[k] for k in sorted(p)] for p in parts])

    def _take(self, item: tuple) -> None:
        self.items.append(item)
        self.size += len(item[2]) // 4

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        total, at = len(ids) // 4, 0
        while total - at >= self.window:
            yield from self._place([[(doc, at, ids[4 * at:4 * (at + self.window)], total)]])
            at += self.window
        while at < total:
            n = min(self.item, total - at, self.coarse - self.size) if self.size < self.coarse else min(self.fine, total - at, self.goal - self.size)
            self._take((doc, at, ids[4 * at:4 * (at + n)], total))
            at += n
            if self.size == self.goal:
                yield from self._divide()

    def end(self) -> Iterator[tuple]:
        """The rest: full windows by differencing, the remainder in lengths that are powers of two."""
        keep = self.size // self.window * (self.window - self.slack)
        rest, self.items, self.size = self.items, [], 0
        over: list[tuple] = []
        for doc, start, ids, total in rest:
            n = min(len(ids) // 4, keep - self.size)
            if n:
                self._take((doc, start, ids[:4 * n], total))
            if 4 * n < len(ids):
                over.append((doc, start + n, ids[4 * n:], total))
        if self.items:
            yield from self._divide()
        left = sum(len(i[2]) // 4 for i in over)
        while left:
            room = min(self.window, 1 << left.bit_length() - 1)
            left -= room
            part = []
            while room:
                doc, start, ids, total = over.pop(0)
                n = min(room, len(ids) // 4)
                part.append((doc, start, ids[:4 * n], total))
                room -= n
                if 4 * n < len(ids):
                    over.insert(0, (doc, start + n, ids[4 * n:], total))
            yield from self._place([part])


def pack_batches(batches, vocabulary: str, end_id: int, packer: Callable[[], Packer] = Packer):
    coder, p, rows = held(ByteLevelIds, vocabulary), packer(), []
    first = TaskContext.get().partitionId() << 36
    end = end_id.to_bytes(4, "little")

    def flush():
        c = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c[:5]] + [pa.array(np.array(c[5]) + first, pa.int64()), pa.array(c[6], pa.int64())],
                                          [f.split()[0] for f in SCHEMA.split(", ")])

    for b in batches:
        doc, (data, off) = b.column(0).to_pylist(), text_bytes(b.column(1))
        for lo, hi in row_groups(off, SLICE):
            ids, cut = coder.rows(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
            for k in range(lo, hi):
                rows.extend(p.add(doc[k], ids[cut[k - lo]:cut[k - lo + 1]].tobytes() + end))
            if len(rows) >= _ROWS:
                yield flush()
    rows.extend(p.end())
    if rows:
        yield flush()


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the checksum of its ids."""
    vocabulary = read_vocabulary(vocabulary_path)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return src.mapInArrow(lambda batches: pack_batches(batches, vocabulary, end_id), SCHEMA)
