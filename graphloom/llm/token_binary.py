"""Token ids in Simple-8b: 64-bit words of a 4-bit selector and 60 bits that hold as many ids as fit.

Format of a segment ("S8B1"): a header, then document ids, token counts and null flags of its documents, the word
offset of every block of BLOCK ids, and the words. A block starts in a word of its own and its last word may be
part full, so blocks decode independently of each other, each selector's words at once. An id of over 30 bits takes
an escape word (selector 15), alone in its 60 bits.

A file set is a Parquet table (part, seq, start, n_ids, image) of such segments: parts ascend by doc_id, as do
segments in a part; start counts the part's ids before the segment. Spark's commit keeps a set whole if tasks rerun.

Defined cases: null text is empty and gives the end id alone; null doc_ids come first; equal doc_ids are ordered by
text hash; an empty table gives a set without segments; extra columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, slices, texts
from graphloom.llm.word_ids import word_ids

MAGIC, BLOCK, SEGMENT = b"S8B1", 1024, 1 << 19
#: Ids in a word and bits of each, by selector.
PACKS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30)]
ESCAPE = 15
HEAD = struct.Struct("<4sIQQI")


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words, and each block's first word. All blocks advance together, a word at a step."""
    n = len(ids)
    if not n:
        return np.zeros(0, "<u8"), np.zeros(0, "<u4")
    if int(ids.max()) >= 1 << 60:
        raise ValueError("an id of over 60 bits")
    blocks, tail = -(-n // BLOCK), PACKS[0][0]
    grid = np.zeros((blocks, BLOCK + tail), np.uint64)
    grid[:, :BLOCK] = np.pad(ids.astype(np.uint64), (0, blocks * BLOCK - n)).reshape(blocks, BLOCK)
    ends = np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    best = np.full((blocks, BLOCK), ESCAPE, np.int8)
    width = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # bits of each id; rounding up from 2^53 on keeps it an escape
    for s in range(len(PACKS) - 1, -1, -1):
        count, bits = PACKS[s]
        wide = width > bits
        if wide[:, :BLOCK].all():
            break
        seen = np.zeros((blocks, BLOCK + tail + 1), np.int32)
        np.cumsum(wide, axis=1, out=seen[:, 1:])
        best[seen[:, count : count + BLOCK] == seen[:, :BLOCK]] = s
    counts = np.ones(16, np.int64)
    counts[: len(PACKS)] = [c for c, _ in PACKS]
    rows, at, taken = np.arange(blocks), np.zeros(blocks, np.int64), []
    while len(rows):
        taken.append((rows, at))
        at = at + counts[best[rows, at]]
        live = at < ends[rows]
        rows, at = rows[live], at[live]
    row, at = np.concatenate([r for r, _ in taken]), np.concatenate([a for _, a in taken])
    order = np.lexsort((at, row))
    row, at = row[order], at[order]
    chosen = best[row, at]
    words = chosen.astype(np.uint64)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        count, bits = PACKS[s] if s < len(PACKS) else (1, 60)
        ids_of = grid[row[mine, None], at[mine, None] + np.arange(count)]
        words[mine] |= np.bitwise_or.reduce(ids_of << (4 + bits * np.arange(count)).astype(np.uint64), axis=1)
    return words.astype("<u8"), np.searchsorted(row, np.arange(blocks)).astype("<u4")


def unpack(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    out, chosen = np.zeros(n, np.uint64), (words & np.uint64(15)).astype(np.int64)
    counts = np.ones(16, np.int64)
    counts[: len(PACKS)] = [c for c, _ in PACKS]
    held = counts[chosen]
    before = np.cumsum(held) - held
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first.astype(np.int64), len(words))))
    at = before - before[first][block] + block * BLOCK
    ends = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        count, bits = PACKS[s] if s < len(PACKS) else (1, 60)
        ids_of = (words[mine, None] >> (4 + bits * np.arange(count)).astype(np.uint64)) & np.uint64((1 << bits) - 1)
        places = at[mine, None] + np.arange(count)
        inside = places < ends[mine, None]
        out[places[inside]] = ids_of[inside]
    return out


def to_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, first = pack(ids)
    known = np.array([x is not None for x in doc_ids], "u1")
    return b"".join((HEAD.pack(MAGIC, len(doc_ids), len(ids), len(words), len(first)), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array(lengths, "<u8").tobytes(), known.tobytes(), first.tobytes(), words.tobytes()))


def from_image(image: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    magic, docs, n, n_words, blocks = HEAD.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a Simple-8b segment")
    at, parts = HEAD.size, []
    for kind, count in (("<i8", docs), ("<u8", docs), ("u1", docs), ("<u4", blocks), ("<u8", n_words)):
        parts.append(np.frombuffer(image, kind, count, at))
        at += parts[-1].nbytes
    doc_ids, lengths, known, first, words = parts
    return [int(d) if k else None for d, k in zip(doc_ids, known, strict=True)], lengths.astype(np.int64), unpack(words, first, n)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Writes the file set of docs (doc_id, text) to path."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = word_ids(vocabulary).ids, TaskContext.get().partitionId()
        end = np.array([end_id], "<u4")
        seq = start = held = 0
        doc_ids, lengths, pieces = [], [], []

        def segment() -> pa.RecordBatch:
            image = to_image(doc_ids, lengths, np.concatenate(pieces))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "start": [start], "n_ids": [held], "image": pa.array([image], pa.binary())})

        for batch in batches:
            for some in slices(batch):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), ids_of(as_bytes(some.column("text"))), strict=True):
                    doc_ids.append(doc_id)
                    lengths.append(len(ids) + 1)
                    pieces += (ids, end)
                    held += lengths[-1]
                    if held >= SEGMENT:
                        yield segment()
                        seq, start, held, doc_ids, lengths, pieces = seq + 1, start + held, 0, [], [], []
        if doc_ids:
            yield segment()

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.select("doc_id", "text").mapInArrow(encode, "part int, seq int, start long, n_ids long, image binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (packed little-endian) from a file set."""
    segments = spark.read.schema("part int, seq int, start long, n_ids long, image binary").parquet(path)
    totals = {r["part"]: r["n"] for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row for each partition of the writer
    bases, base = {}, 0
    for part in sorted(totals):
        bases[part], base = base, base + totals[part]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, image in zip(*(batch.column(c).to_pylist() for c in ("part", "start", "image")), strict=True):
                doc_ids, lengths, ids = from_image(image)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths)
                own = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(ends - lengths + start + bases[part], pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in own], pa.int64()), "ids": pa.array(own, pa.binary())})

    return segments.select("part", "start", "image").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
