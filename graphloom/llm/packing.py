"""Packing by Karmarkar-Karp multiway differencing.

A document's ids fill whole windows of `capacity` first; the rest, cut into pieces of at most `piece`, is packed
with the rests of the next documents of the same task, GROUP pieces at a time. Differencing starts from one partial
partition a piece, (piece, 0, ... 0) over k windows, and merges again and again the two of the largest imbalance
with opposing order, largest sums onto smallest, until one is left. k starts at the least count that could hold the
group and rises while a window is over capacity. No shuffle: windows never cross tasks.

Defined cases: null text is empty and gives its end id alone; null or repeated doc_ids are packed like any other;
an empty table gives no pieces; texts longer than a window are cut; extra columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from graphloom.llm.common import as_bytes, slices, texts
from graphloom.llm.word_ids import word_ids

GROUP = 640
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: list[int], k: int) -> tuple[np.ndarray, list[list[int]]]:
    """Sums of the k windows and the indices of the pieces in each."""
    left, right = [-1] * (len(sizes) + 1), [-1] * (len(sizes) + 1)  # a forest: node i + 1 is piece i, later nodes join two
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[0], nodes[0] = size, i + 1
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    made = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        nodes, both = np.maximum(x, y), np.flatnonzero((x > 0) & (y > 0))
        if len(both):
            nodes[both] = np.arange(len(left), len(left) + len(both))
            left.extend(x[both].tolist())
            right.extend(y[both].tolist())
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums, nodes))
        made += 1
    windows = []
    for node in heap[0][3].tolist():
        held, todo = [], [node] if node else []
        while todo:
            if (at := todo.pop()) <= len(sizes):
                held.append(at - 1)
            else:
                todo += (left[at], right[at])
        windows.append(sorted(held))
    return heap[0][2], windows


def near_equal(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most capacity; their count rises until all hold."""
    k = -(-sum(sizes) // capacity)
    while True:
        sums, windows = differencing(sizes, k)
        if sums.max() <= capacity:
            return [w for w in windows if w]
        k += 1


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024, piece: int = 256) -> DataFrame:
    """A row for each piece of a document; sequence ids are unique, not gapless."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = word_ids(vocabulary).ids, TaskContext.get().partitionId()
        end, sequence = np.array([end_id], "<u4").tobytes(), part << 36
        rests: list[tuple] = []

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        def close(some: list[tuple]) -> list[tuple]:
            nonlocal sequence
            out = []
            for window in near_equal([len(p[2]) // 4 for p in some], capacity):
                offset = 0
                for i in window:
                    doc_id, start, ids, n = some[i]
                    out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset, ids))
                    offset += len(ids) // 4
                sequence += 1
            return out

        for batch in batches:
            out: list[tuple] = []
            for doc_id, ids in ((d, x.tobytes() + end) for some in slices(batch) for d, x in zip(some.column("doc_id").to_pylist(), ids_of(as_bytes(some.column("text"))), strict=True)):
                n = len(ids) // 4
                full = n - n % capacity
                for start in range(0, full, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    out.append((doc_id, start, capacity, zlib.crc32(own), n, sequence, 0, own))
                    sequence += 1
                rests += [(doc_id, start, ids[4 * start : 4 * min(n, start + piece)], n) for start in range(full, n, piece)]
                while len(rests) >= GROUP:
                    out += close(rests[:GROUP])
                    del rests[:GROUP]
                if len(out) >= 4096:
                    yield rows(out)
                    out = []
            if out:
                yield rows(out)
        if rests:
            yield rows(close(rests))

    return texts(docs).mapInArrow(run, SCHEMA)
